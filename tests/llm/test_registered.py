"""Every registered query on its whole table at sf0.01, against SQL or the plain way."""

from __future__ import annotations

import duckdb
import pytest

from check_oracle import differences
from corpus_pipeline import STAGES
from usagelens.llm import queries
from usagelens.llm.queries import CAPACITY, END_OF_TEXT, QUERIES, vocabulary

from . import brute

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM read_parquet('{SF_DIR}/documents.parquet')").fetchall()


def rows_of(spark, name, *columns):
    return {row[0]: tuple(row[1:]) for row in QUERIES[name](spark, SF_DIR).select(*columns).collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, duck, name):
    rows, difference = differences(QUERIES[name](spark, SF_DIR), duck, queries.ORACLE_SQL[name])
    assert difference is None
    assert rows > 0


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    expected = sorted((i, *p) for i, t in texts for p in brute.pieces(t, tokenizer, CAPACITY, END_OF_TEXT))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= CAPACITY
    total = sum(r.length for r in rows)
    # The lower bound, or one sequence more in fifty.
    assert len(ends) <= -(-total // CAPACITY) * 1.02 + 1


def test_packing(spark, documents):
    rows = QUERIES["op1_best_fit_packing"](spark, SF_DIR).collect()
    check_packing(rows, [(d[0], d[1]) for d in documents])


def test_mixing(spark, documents):
    rows = QUERIES["op2_temperature_mixing"](spark, SF_DIR).collect()
    size = {d[0]: len(brute.words(d[1])) for d in documents}
    source = {d[0]: d[3] for d in documents}
    assert {r.doc_id for r in rows} == set(size)
    epochs = {r.source: r.epochs for r in rows}
    natural = {s: sum(size[i] for i in size if source[i] == s) for s in epochs}
    emitted = {s: sum(r.n_words for r in rows if r.source == s) for s in epochs}
    for s in epochs:
        # The budget is met with the document that reaches it.
        most = max(size[i] for i in size if source[i] == s)
        assert epochs[s] * natural[s] - 1e-3 <= emitted[s] < epochs[s] * natural[s] + most
    assert min(epochs.values()) == pytest.approx(1.0)
    assert max(epochs.values()) <= queries.REPETITION + 1e-6
    assert all(r.block / r.epochs <= r.position <= (r.block + 1) / r.epochs for r in rows)
    assert len({(r.doc_id, r.block) for r in rows}) == len(rows)


def test_quality(spark, documents):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    found = rows_of(spark, "op3_quality_rules", "doc_id", *columns, "kept")
    assert {i: r[:-1] for i, r in found.items()} == {d[0]: brute.quality_measures(d[1]) for d in documents}
    assert not any(r[-1] and r[-2] for r in found.values())
    labels = duckdb.sql(f"SELECT doc_id, quality FROM read_parquet('{SF_DIR}/labels.parquet')").fetchall()
    judged = [(q, found[i][-1]) for i, q in labels if not found[i][-2]]
    assert all(kept for q, kept in judged if q == 1)
    assert not any(kept for q, kept in judged if q == 0)


def test_near_dedup(spark, documents):
    found = rows_of(spark, "op4_circulant_minhash", "doc_id", "n_shingles", "component_id")
    assert found == brute.near_groups([d[:2] for d in documents], 4)


def test_language(spark, documents):
    found = rows_of(spark, "op5_kneser_ney_language", "doc_id", "held_out", "lang_pred", "score")
    assert len(found) == len(documents)
    import zlib

    assert all(found[d[0]][0] == (zlib.crc32(str(d[0]).encode()) % 4 == 2) for d in documents)
    held = [(d[2], found[d[0]][1]) for d in documents if found[d[0]][0]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r[2] <= 1 for r in found.values())


def test_byte_repeats(spark, documents):
    found = rows_of(spark, "op6_suffix_groups", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == brute.byte_repeats([d[:2] for d in documents])


def test_secrets(spark, documents):
    found = rows_of(spark, "op7_entropy_secrets", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    for d in documents:
        *expected, written = brute.secret_spans(d[1])
        assert found[d[0]][:4] == tuple(expected)
        assert set(written.split(",")) - {""} <= set(found[d[0]][4].split(","))


def test_token_counts(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    tokenizer.encode_special_tokens = True
    found = QUERIES["op10_separator_scan"](spark, SF_DIR).collect()
    assert sorted(r.n_tokens for r in found) == sorted(
        len(tokenizer.encode(d[1] or "", add_special_tokens=False).ids) for d in documents
    )
    assert all(r.complete for r in found)
    begun = {}
    for r in sorted(found, key=lambda r: (r.token_file, r.document)):
        assert r.start == begun.get(r.token_file, 0)
        begun[r.token_file] = r.start + r.n_tokens + 1


def test_pipeline(spark, tmp_path):
    """Stage by stage against the plain way, each on what the stage before kept."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = docs.collect()
    columns = docs.columns
    for n, (name, stage) in enumerate(STAGES):
        path = str(tmp_path / str(n))
        stage(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.collect()
        if name == "quality rules":
            passed = {r.doc_id for r in before if not brute.quality_measures(r.text)[-1]}
            assert {r.doc_id for r in after} <= passed
            labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM read_parquet('{SF_DIR}/labels.parquet')").fetchall())
            assert {i for i in passed if labels.get(i) == 1} <= {r.doc_id for r in after}
        elif name == "exact dedup":
            best = {}
            for r in before:
                key = "".join(brute.words(r.text))
                if key not in best or (-len(r.text), r.doc_id) < (-len(best[key].text), best[key].doc_id):
                    best[key] = r
            assert sorted(after) == sorted(best.values())
        elif name == "near dedup":
            groups = brute.near_groups([(r.doc_id, r.text) for r in before], 5)
            assert sorted(r.doc_id for r in after) == sorted(i for i, (_, c) in groups.items() if i == c)
        elif name == "source mixing":
            assert set(after) == set(before)
            assert len(after) > len(before)
        else:
            check_packing(after, [(r.doc_id, r.text) for r in before])
        if n < len(STAGES) - 1:
            assert docs.columns == columns
        before = after


def test_token_store(spark, documents):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    expected, start = {}, 0
    for i, text, *_ in sorted(documents):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        expected[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert rows_of(spark, "op13_range_coder", "doc_id", "start", "n_tokens", "ids_crc32") == expected


def test_whitening(spark):
    import numpy as np

    vectors = duckdb.sql(f"SELECT vec_id, embedding FROM read_parquet('{SF_DIR}/embeddings.parquet')").fetchall()
    expected = brute.whitened([v for _, v in vectors], 4)
    found = QUERIES["op11_chebyshev_whitening"](spark, SF_DIR).collect()
    assert len(found) == 4 * len(vectors)
    by_row = {(r.vec_id, r.component): r for r in found}
    n, deviation, projected, explained = expected
    for c in range(4):
        own = np.array([by_row[i, c + 1].whitened for i, _ in vectors])
        assert min(np.abs(own - projected[:, c]).max(), np.abs(own + projected[:, c]).max()) < 1e-9
        assert all(abs(by_row[i, c + 1].explained - explained[c]) < 1e-12 for i, _ in vectors)
    assert [by_row[i, 1].deviation for i, _ in vectors] == deviation
    assert {r.n for r in found} == {n} and {r.identity_error for r in found}.pop() < 1e-9


def test_conversations(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM read_parquet('{SF_DIR}/conversations.parquet')").fetchall()
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert rows_of(spark, "op12_branch_and_bound_repair", "conv_id", *columns) == brute.repaired_conversations(rows)
