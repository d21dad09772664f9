"""Token ids of texts by a public tokenizer, with a word cache."""

from __future__ import annotations

import codecs
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries a task's cache may hold before it starts anew.
CACHE_WORDS = 700_000

_SIMPLE = re.compile(r"([a-zß-öø-ÿ]+)([.,;:!?]?)").fullmatch


def _byte_spelling() -> str:
    """The letter of each byte in a byte-level vocabulary.

    Bytes that print stand for themselves; the others, in order, for the characters from 256 on.
    """
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printing]
    return "".join(chr(b) if b in printing else chr(256 + others.index(b)) for b in range(256))


_SPELLING = _byte_spelling()


def _byte_letters() -> dict[str, str]:
    """Latin-1 letters over 127 as a byte-level vocabulary spells them."""
    return {chr(c): "".join(_SPELLING[b] for b in chr(c).encode()) for c in range(128, 256)}


class WordTokenizer:
    """Ids as 4-byte little-endian numbers.

    For a vocabulary that drops white space and never joins across it, the ids of a text are those of
    its words, one after the other.  Words repeat, so each is encoded once.  A word of Latin letters,
    perhaps with a full stop or comma after it, is what the tokenizer's own preparation would leave
    but for its case, so its model is asked directly; any other word takes the whole way.

    Where a text spells a special token, its id comes out, as the library has it.  With ``plain`` such
    a text is ordinary text, so that no text can give a special id.
    """

    def __init__(self, path: str, plain: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = plain
        self._model = self._tokenizer.model
        self._letters = str.maketrans(_byte_letters())
        self._cache: dict[str, bytes] = {}

    def _ids(self, word: str) -> bytes:
        found = _SIMPLE(word.lower())
        if found is None:
            ids = self._tokenizer.encode(word, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        core, mark = found.groups()
        packed = self._cache.get(core)
        if packed is None:
            ids = [t.id for t in self._model.tokenize(core if core.isascii() else core.translate(self._letters))]
            packed = self._cache[core] = struct.pack(f"<{len(ids)}I", *ids)
        if not mark:
            return packed
        tail = self._cache.get(mark)
        if tail is None:
            ids = self._tokenizer.encode(mark, add_special_tokens=False).ids
            tail = self._cache[mark] = struct.pack(f"<{len(ids)}I", *ids)
        return packed + tail

    def encode(self, text: str) -> bytes:
        """The ids of a whole text."""
        cache = self._cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        try:
            return b"".join([cache[w] for w in words])
        except KeyError:
            pass
        for word in words:
            if word not in cache:
                cache[word] = self._ids(word)
        return b"".join([cache[w] for w in words])


_loaded: dict[tuple[str, bool], WordTokenizer] = {}


def tokenizer(path: str, plain: bool = False) -> WordTokenizer:
    """The tokenizer of this Python worker."""
    if (path, plain) not in _loaded:
        _loaded[path, plain] = WordTokenizer(path, plain)
    return _loaded[path, plain]


#: A word of Latin letters, perhaps on a new line, and punctuation after it.
_LATIN = r"^\n?[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?]*$"
_LATIN_LETTERS = [chr(c) for c in range(256) if re.match(_LATIN, chr(c))]
#: What Latin letters are spelt with.
_LETTERS = "".join(sorted({_SPELLING[b] for c in _LATIN_LETTERS for b in c.encode()}))
#: An entry of their letters and marks that reaches from a word to its marks, or over a space or new line.
_OVER_PARTS = re.compile(
    f"(?=[{_LETTERS}.,;:!?ĠĊ]*$).*(?:[{_LETTERS}][.,;:!?]|[^ĠĊ][ĠĊ]|Ċ[{_LETTERS}])"
).match
#: Bytes of text that are encoded together; bounds the memory of a task.
TOGETHER = 1 << 24
#: New words that the library is asked about at once.
ASKED = 1 << 10
#: Bytes of words from which a task's cache of them starts anew, if it has not by their number.
CACHE_BYTES = 1 << 26


class ByteTokenizer:
    """Ids of a byte-level vocabulary as 2-byte little-endian numbers.

    Such a vocabulary never joins across a space between two characters that are none, and neither across
    a new line there.  So texts are cut before each of them, and words are encoded once, with their space
    or new line: Arrow numbers the words of many texts and puts their ids in place.  The library is given
    many new words as one text; their ids part where an id begins with a space or a new line.  Words of
    Latin letters skip its own preparation, if no entry of the vocabulary reaches over what that would part;
    they are spelt in the vocabulary's letters.  Where white space meets white space, or ends a text, the
    pieces are joined again.  Special tokens in a text give their ids, as the library has it.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        if self._tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit in two bytes")
        vocabulary = self._tokenizer.get_vocab()
        self._begins = np.zeros(1 << 16, bool)
        self._begins[[i for token, i in vocabulary.items() if token[0] in "ĠĊ"]] = True
        self._unprepared = None
        if not any(map(_OVER_PARTS, vocabulary)):
            self._unprepared = Tokenizer.from_file(path)
            self._unprepared.pre_tokenizer = None
        # Words follow a space unless they start with a new line; first words follow nothing.
        self._words, self._word_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}H", *ids) for ids in (f.ids for f in found)]

    def _ask(self, words: pa.Array, latin: bool) -> pa.Array:
        """Ids of words that neither begin nor end with white space."""
        starts = [*range(0, len(words), ASKED), len(words)]
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), words.cast(pa.string()))
        tokenizer = self._unprepared if latin else self._tokenizer
        begins, ids, n_ids = [], [np.zeros(0, "<u2")], 0
        for n, joined in zip(np.diff(starts), pc.binary_join(lists, " ")):
            text = f" {joined.as_py()}".replace(" \n", "\n")
            if latin:
                text, _ = codecs.charmap_decode(text.encode(), "strict", _SPELLING)
            (found,) = tokenizer.encode_batch_fast([text], add_special_tokens=False)
            ids.append(np.array(found.ids, "<u2"))
            begins.append(self._begins[ids[-1]].nonzero()[0] + n_ids)
            if len(begins[-1]) != n:
                raise ValueError("the vocabulary joins across words")
            n_ids += len(ids[-1])
        offsets = 2 * np.concatenate([*begins, [n_ids]]).astype("<i8")
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(ids))]
        return pa.Array.from_buffers(pa.large_binary(), len(words), buffers)

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Take new words in and give their numbers; those that begin or end with white space get NULL for ids."""
        latin = pc.match_substring_regex(words, _LATIN).to_numpy(zero_copy_only=False) & (self._unprepared is not None)
        others = (~latin).nonzero()[0]
        apart = [
            not w.lstrip("\n") or w[w[0] == "\n"].isspace() or w[-1].isspace()
            for w in words.take(pa.array(others)).to_pylist()
        ]
        apart = np.array(apart, bool)
        order = [latin.nonzero()[0], others[~apart], others[apart]]
        numbers = np.empty(len(words), np.int64)
        numbers[np.concatenate(order)] = len(self._words) + np.arange(len(words))
        plain, mixed, odd = (words.take(pa.array(places)) for places in order)
        ids = [self._ask(plain, True), self._ask(mixed, False), pa.nulls(len(odd), pa.large_binary())]
        self._words = pa.concat_arrays([self._words, plain, mixed, odd])
        self._word_ids = pa.concat_arrays([self._word_ids, *ids])
        return numbers

    def encode(self, text: str) -> bytes:
        """The ids of a whole text."""
        ((ids, _),) = self.encode_all(pa.array([text]))
        return ids.tobytes()

    def encode_all(self, texts: pa.Array, end: bytes = b"") -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of texts, one after the other, each with ``end``, and how many each has; some texts at a time."""
        texts = texts.cast(pa.large_string())
        before = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            limit = (before[at - 1] if at else 0) + TOGETHER
            stop = max(at + 1, int(np.searchsorted(before, limit, side="right")))
            yield self._together(texts[at:stop], end)
            at = stop

    def _together(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        if len(self._words) > CACHE_WORDS or self._words.nbytes > CACHE_BYTES:
            self._words, self._word_ids = self._words[:0], self._word_ids[:0]
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        firsts = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
        words = split.flatten()
        heads = words.take(pa.array(firsts)).to_pylist()
        follows = np.ones(len(words), bool)
        follows[firsts] = False
        coded = words.filter(pa.array(follows)).dictionary_encode()
        known = pc.index_in(coded.dictionary, self._words)
        new, known = known.is_null().to_numpy(zero_copy_only=False), known.fill_null(0).to_numpy().astype(np.int64)
        known[new] = self._learn(coded.dictionary.filter(pa.array(new)))
        # The words of these texts alone, in the order in which they appear, lie close together.
        entries = self._word_ids.take(pa.array(known))
        numbers = np.empty(len(words), np.int64)
        numbers[follows] = coded.indices.to_numpy()
        # Texts apart are one entry instead of their words.
        counts = np.diff(firsts, append=len(words))
        apart = np.zeros(len(texts), bool)
        if entries.null_count:
            odd = entries.is_null().to_numpy(zero_copy_only=False)
            places = follows.nonzero()[0][odd[coded.indices.to_numpy()]]
            apart[np.searchsorted(firsts, places, side="right") - 1] = True
        apart |= (counts > 1) & np.array([not head or head[-1].isspace() for head in heads], bool)
        own = self._encode(heads)
        for i in apart.nonzero()[0].tolist():
            own[i] = self._apart(texts[i].as_py())
        numbers[firsts] = len(entries) + np.arange(len(texts))
        if apart.any():
            numbers, counts = numbers[~(np.repeat(apart, counts) & follows)], np.where(apart, 1, counts)
        numbers = np.insert(numbers, np.cumsum(counts), len(entries) + len(texts))
        entries = pa.concat_arrays([entries, pa.array([*own, end], pa.large_binary())])
        placed = entries.take(pa.array(numbers))
        offsets, data = placed.buffers()[1:]
        reached = np.frombuffer(offsets, np.int64)[np.cumsum(counts + 1)] // 2
        return np.frombuffer(data or b"", "<u2", reached[-1]), np.diff(reached, prepend=0)

    def _apart(self, text: str) -> bytes:
        """Ids of a text in which white space meets white space."""
        first, *rest = _BETWEEN_WORDS(text)
        return b"".join(self._encode([first, *(f" {part}" for part in rest)]))


_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)").split
_byte_tokenizers: dict[str, ByteTokenizer] = {}


def byte_tokenizer(path: str) -> ByteTokenizer:
    """The byte-level tokenizer of this Python worker."""
    if path not in _byte_tokenizers:
        _byte_tokenizers[path] = ByteTokenizer(path)
    return _byte_tokenizers[path]
