"""Range coder and token files: exact round trips, damage, awkward documents."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from usagelens.llm import range_coder, token_store
from usagelens.llm.queries import vocabulary
from usagelens.llm.tables import new_path
from usagelens.llm.tokens import ByteTokenizer

from .test_operators import AWKWARD, clash

VOCABULARY = vocabulary("byte_bpe_50k.json")


def blocks_of_all_kinds():
    r = np.random.default_rng(5)
    top = range_coder.LARGEST_ID
    yield np.zeros(range_coder.BLOCK, np.uint16)
    yield np.full(3000, top, np.uint16)
    yield r.integers(0, top + 1, range_coder.BLOCK).astype(np.uint16)
    yield np.tile(r.integers(0, 50_000, 37), 60).astype(np.uint16)
    yield (r.zipf(1.3, range_coder.BLOCK) % 50_000).astype(np.uint16)
    for n in (1, 2, 3, 777):
        yield (r.zipf(1.1, n) % top).astype(np.uint16)


def test_round_trip_of_blocks():
    blocks = sorted(blocks_of_all_kinds(), key=len, reverse=True)
    words = range_coder.encode(blocks)
    assert all((a == b).all() for a, b in zip(range_coder.decode(words, [len(b) for b in blocks]), blocks))
    # A block does not depend on those coded beside it.
    for block, coded in zip(blocks, words):
        assert (range_coder.encode([block])[0] == coded).all()
        assert (range_coder.decode([coded], [len(block)])[0] == block).all()
    bits = {len(b): 32 * len(w) / len(b) for b, w in zip(blocks, words)}
    assert bits[3000] < 0.5 and bits[2220] < 2 and bits[range_coder.BLOCK] < 20
    assert range_coder.encode([]) == []
    with pytest.raises(ValueError):
        range_coder.encode([np.array([range_coder.LARGEST_ID + 1], np.uint16)])


def test_coded_words_stay_as_they_were():
    """Files that were written before can be read."""
    words = range_coder.encode(sorted(blocks_of_all_kinds(), key=len, reverse=True))
    assert zlib.crc32(np.concatenate(words).astype("<u4").tobytes()) == 2119303459


def test_halved_weights():
    r = random.Random(7)
    for _ in range(300):
        weights = [r.choice([1, 2, 3, r.randrange(1, 101)]) for _ in range(range_coder.PREDICTORS)]
        found = range_coder._halved(np.array([range_coder._packed(tuple(weights))], np.uint64))
        assert found.tolist() == [range_coder._packed(tuple((w + 1) // 2 for w in weights))], weights


def test_predictions_shorten_a_text():
    text = " ".join(random.Random(2).choice(["the river", "of stone", "a field of", "and light"]) for _ in range(2000))
    ids = np.frombuffer(ByteTokenizer(VOCABULARY).encode(text), "<u2")[: range_coder.BLOCK]
    (words,) = range_coder.encode([ids])
    assert 32 * len(words) / len(ids) < 4


def group_file():
    docs = [([1, None, 3], [np.arange(5000, dtype=np.uint16), np.zeros(1, np.uint16), np.array([7, 0], np.uint16)])]
    docs.append(([4], [np.arange(10, dtype=np.uint16)]))
    return docs, b"".join(x + b"\n" for x in token_store.pack_groups(docs, 6, 2))


def test_groups_and_damage():
    docs, content = group_file()
    found = list(token_store.unpack_file(content))
    assert [(p, n, i) for p, n, i, *_ in found] == [(6, 2, [1, None, 3]), (6, 3, [4])]
    for (_, tokens), (*_, counts, ids) in zip(docs, found):
        assert counts.tolist() == [len(t) for t in tokens] and (ids == np.concatenate(tokens)).all()
    assert list(token_store.unpack_file(b"")) == []
    for at in range(0, len(content), 701):
        damaged = bytearray(content)
        damaged[at] ^= 0x10
        with pytest.raises(token_store.FormatError):
            list(token_store.unpack_file(bytes(damaged)))
    for end in (1, 40, len(content) - 1):
        with pytest.raises(token_store.FormatError):
            list(token_store.unpack_file(content[:end]))


def test_byte_tokenizer_is_the_tokenizer():
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(VOCABULARY), ByteTokenizer(VOCABULARY)
    r = random.Random(3)
    letters = "abcXYZ éÉßœ.,!?'\t\n\r\x1c\x85　 Kµª012-_你🙂 \n  s"
    texts = [t for _, t in AWKWARD if t] + ["".join(r.choice(letters) for _ in range(40)) for _ in range(3000)]
    for text in [*texts, "a <|endoftext|> b", " a", "a ", "a  b", "a\n\n b", "\na", "I'm\nwe'll, é.\nÀ!?"]:
        assert np.frombuffer(own.encode(text), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids, text


class Counted:
    """A tokenizer, or its model, that counts the calls for ids."""

    calls = 0

    def __init__(self, inner):
        object.__setattr__(self, "inner", inner)

    def __setattr__(self, name, value):
        setattr(self.inner, name, value)

    def __getattr__(self, name):
        found = getattr(self.inner, name)
        if name == "model":
            return Counted(found)

        def call(*values, **named):
            Counted.calls += 1
            return found(*values, **named)

        return call if name.startswith(("encode", "tokenize")) else found


def test_new_words_are_asked_about_together(monkeypatch):
    import tokenizers

    whole = tokenizers.Tokenizer
    monkeypatch.setattr(tokenizers, "Tokenizer", type("", (), {"from_file": lambda path: Counted(whole.from_file(path))}))
    r, own = random.Random(4), ByteTokenizer(VOCABULARY)
    words = ["".join(r.choices("abdeilnorstué", k=9)) + r.choice(["", ".", "7", ",\n"]) for _ in range(4000)]
    text, Counted.calls = " ".join(words).replace("\n ", "\n").strip(), 0
    found = np.frombuffer(own.encode(text), "<u2").tolist()
    assert Counted.calls < 20
    assert found == whole.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("together, asked, cached", [(1, 1, 1), (300, 3, 40), (1 << 24, 1 << 10, 700_000)])
def test_many_texts_together(monkeypatch, together, asked, cached):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from usagelens.llm import tokens

    for name, value in (("TOGETHER", together), ("ASKED", asked), ("CACHE_WORDS", cached)):
        monkeypatch.setattr(tokens, name, value)
    whole, own = Tokenizer.from_file(VOCABULARY), ByteTokenizer(VOCABULARY)
    r = random.Random(6)
    pieces = ["the", "The", "rivière", "naïve,", "a.b", "42", "\nstone", "\nétat!", "x  y", "\n\n", " ", "\t", "don't", "日本",
              "<|endoftext|>", "\n<|endoftext|>", "a<|endoftext|>", "\u00a0é", "end ", "\r\n", "?!", "ªº", "×÷", "Ġ", "Ċ"]
    texts = [" ".join(r.choices(pieces[: r.choice([8, len(pieces)])], k=r.randrange(12))) for _ in range(600)]
    texts += ["", " ", "\n", *(t for _, t in AWKWARD if t), "", "\n\n", ""]
    for end in (b"", b"\0\0"):
        found = list(own.encode_all(pa.array(["unread", *texts])[1:], end))
        ids, counts = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        every = np.split(ids, np.cumsum(counts)[:-1])
        for text, got in zip(texts, every, strict=True):
            assert got.tolist() == whole.encode(text, add_special_tokens=False).ids + [0] * (len(end) // 2), text
    assert list(own.encode_all(pa.array([], pa.string()))) == []
    assert own.encode("") == ByteTokenizer(VOCABULARY).encode("") == b""


def test_awkward_documents(spark, table, monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    path = new_path(spark, "awkward-tokens")
    rows = token_store.round_trip(clash(table(AWKWARD), "id", "value", "spread"), path, VOCABULARY).collect()
    ids = lambda t: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
    expected = [(-1 if i is None else i, len(ids(t)), zlib.crc32(ids(t).tobytes())) for i, t in AWKWARD]
    in_order = sorted(rows, key=lambda r: r.start)
    key = [-1 if r.doc_id is None else r.doc_id for r in in_order]
    assert key == sorted(key)
    assert sorted((k, r.n_tokens, r.ids_crc32) for k, r in zip(key, in_order)) == sorted(expected)
    assert [r.start for r in in_order] == list(np.cumsum([0] + [r.n_tokens for r in in_order[:-1]]))
    assert token_store.round_trip(table([]), new_path(spark, "no-tokens"), VOCABULARY).count() == 0


def test_documents_over_many_groups_and_files(spark, table, monkeypatch):
    """Groups of a few ids, so that a part holds many; order and starts run through them."""
    rows = [(i, "word " * (i % 7)) for i in range(400)]
    monkeypatch.setattr(token_store, "GROUPS_PER_FILE", 2)
    path = new_path(spark, "many-groups")
    token_store.write_tokens(table(rows), path, VOCABULARY)
    found = token_store.read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in found] == list(range(400))
    assert [r.start for r in found] == list(np.cumsum([0] + [r.n_tokens for r in found[:-1]]))
    assert spark.read.format("binaryFile").load(path).where(F.col("length") > 0).count() >= 1
