"""Removal of repeated byte strings across documents, by suffix arrays of the places that may repeat.

A string of ``LENGTH`` bytes is bound to its anchor: the sub-string of ``ANCHOR`` bytes in it with the
least hash.  Equal strings have equal anchors, so only starts with an anchor that occurs again can
repeat, and equal strings meet in the group of their anchor.  In a group, equal contexts (all starts
that one anchor is bound to) are one; the suffixes of the different ones are sorted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffix_groups import suffix_arrays
from .tables import discard, map_batches, stored, text_of

LENGTH = 100
ANCHOR = 32
#: Contexts of one anchor that are sorted together; larger groups are split and their strings merged.
CONTEXTS = 64
#: Bytes sorted in one batch.
BATCH_BYTES = 1 << 21
#: Starts of a very long text that are taken at a time.
SLICE = 1 << 22
#: A run of starts is packed as its first start times 128, plus its length (at most 69).
RUN_BITS = 7
#: Keys of documents without an id: behind all ids, by their text.
NO_ID = 1 << 62


def anchored(text: np.ndarray, slice_: int = SLICE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the anchors of a text (bytes), and first start and number of the starts bound to each."""
    count = len(text) - LENGTH + 1
    hashes, starts, sizes = [], [], []
    for low in range(0, max(count, 0), slice_):
        part = text[low : min(low + slice_, count) + LENGTH - 1]
        x = (part.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        factor, size = 0x9E3779B97F4A7C15, 1
        while size < ANCHOR:  # hashes of 2, 4, ... bytes
            x = x[:-size] * np.uint64(factor) + x[size:]
            factor, size = factor * factor % (1 << 64), 2 * size
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) >> np.uint64(16)
        # The least in a window, the leftmost of equal ones: hash above, place below.
        least = ((x >> np.uint64(8)) << np.uint64(24)) | np.arange(len(x), dtype=np.uint64)
        width, done = LENGTH - ANCHOR + 1, 1
        while done < width:
            step = min(done, width - done)
            least = np.minimum(least[:-step], least[step:])
            done += step
        at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        hashes.append(x[at[first]])
        starts.append(first + low)
        sizes.append(np.diff(np.append(first, len(at))))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(sizes)


def _anchor_hashes(batches):
    for batch in batches:
        for begin in range(0, batch.num_rows, 500):
            found = [anchored(np.frombuffer(t.as_py(), np.uint8))[0] for t in batch.column(1).slice(begin, 500)]
            hashes = np.concatenate([np.zeros(0, np.uint64), *found])
            if len(hashes):
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["h"])


def _anchor_rows(batches):
    """Anchors with the hash of their context."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        for begin in range(0, batch.num_rows, 500):
            columns = [[], [], [], []]
            for key, text in zip(batch.column(0).slice(begin, 500).to_pylist(), batch.column(1).slice(begin, 500)):
                text = text.as_py()
                h, starts, sizes = anchored(np.frombuffer(text, np.uint8))
                view = memoryview(text)
                ends = starts + sizes + (LENGTH - 1)
                c = [digest(view[s:e]) >> 16 for s, e in zip(starts.tolist(), ends.tolist())]
                columns[0].append(h.view(np.int64))
                columns[1].append(np.array(c, np.int64))
                columns[2].append(np.full(len(h), key, np.int64))
                columns[3].append((starts << RUN_BITS) | sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["h", "c", "doc", "run"])


def _contexts(batches):
    """The bytes of the contexts asked for: ``wanted`` lists anchor, size of its group, and run."""
    for batch in batches:
        rows = []
        size = 0
        for key, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            text = text.as_py()
            for w in wanted.as_py():
                start, n = w["run"] >> RUN_BITS, w["run"] & ((1 << RUN_BITS) - 1)
                rows.append((w["h"], w["kinds"], key, w["run"], text[start : start + n + LENGTH - 1]))
                size += 150
            if size > 1 << 23:
                yield _context_batch(rows)
                rows, size = [], 0
        if rows:
            yield _context_batch(rows)


def _context_batch(rows):
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["h", "kinds", "doc", "run", "context"])


def _sorted_runs(batches):
    """Runs of starts that repeat an earlier one, from the suffix arrays of whole groups of contexts.

    Rows come ordered by group (``h``, ``part``).  ``single`` rows are runs to remove.  Of a group that
    was split, the first of every string is put out as well, for the other parts to be compared with.
    """
    held, size, last = [], 0, None
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for h, part, split, doc, run, context in zip(*columns[:3], columns[3], batch.column(4).to_pylist(), batch.column(5).to_pylist()):
            if size > BATCH_BYTES and (h, part) != last:
                yield from _removed(held)
                held, size = [], 0
            held.append((h, part, split, doc, run, context))
            size += len(context)
            last = (h, part)
    if held:
        yield from _removed(held)


def _removed(rows):
    h = np.array([r[0] for r in rows], np.int64)
    part = np.array([r[1] for r in rows], np.int64)
    split = np.array([r[2] for r in rows], bool)
    doc = np.array([r[3] for r in rows], np.int64)
    run = np.array([r[4] for r in rows], np.int64)
    lengths = np.array([len(r[5]) + 1 for r in rows], np.int64)
    # Contexts, each ended by 1, the last of a group by 0.
    flat = np.frombuffer(b"\0".join([*(r[5] for r in rows), b""]), np.uint8).astype(np.int16) + 2
    ends = np.cumsum(lengths)
    begins = ends - lengths
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (part[1:] != part[:-1])
    flat[ends - 1] = 1
    final = np.append(np.flatnonzero(fresh)[1:], len(rows)) - 1
    flat[ends[final] - 1] = 0
    order = suffix_arrays(flat, np.append(begins[fresh], len(flat)))
    # Only starts that the context is about.
    own = np.repeat(np.arange(len(rows)), lengths)
    inside = np.arange(len(flat)) - begins[own]
    starts = order[inside[order] < (run[own[order]] & ((1 << RUN_BITS) - 1))]
    raw = flat.astype(np.uint8)  # the same for equal strings, which hold no end of a context
    same = np.zeros(len(starts), bool)
    reach = np.arange(LENGTH)
    for low in range(1, len(starts), 1 << 14):
        now = starts[low : low + (1 << 14)]
        before = starts[low - 1 : low - 1 + len(now)]
        same[low : low + len(now)] = (raw[now[:, None] + reach] == raw[before[:, None] + reach]).all(axis=1)
    group = np.cumsum(~same) - 1
    row = own[starts]
    place = (run[row] >> RUN_BITS) + inside[starts]
    ranked = np.lexsort((place, doc[row], group))
    first = np.zeros(len(starts), bool)
    heads = np.ones(len(starts), bool)
    heads[1:] = group[ranked][1:] != group[ranked][:-1]
    first[ranked[heads]] = True
    again = np.flatnonzero(~first)
    again = again[np.lexsort((place[again], row[again]))]
    if len(again):
        r, p = row[again], place[again]
        new = np.ones(len(again), bool)
        new[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(again)))
        yield _run_batch(np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64), doc[r[heads]], (p[heads] << RUN_BITS) | sizes, True)
    open_ = np.flatnonzero(first & split[row])
    if len(open_):
        raw_bytes = raw.tobytes()
        digest = xxhash.xxh3_64_intdigest
        w = np.array([digest(raw_bytes[s : s + LENGTH]) >> 1 for s in starts[open_].tolist()], np.int64)
        r = row[open_]
        yield _run_batch(h[r], w, doc[r], (place[open_] << RUN_BITS) | 1, False)


def _run_batch(h, w, doc, run, single):
    return pa.RecordBatch.from_arrays(
        [pa.array(h), pa.array(w), pa.array(doc), pa.array(run), pa.array(np.full(len(h), single))],
        ["h", "w", "doc", "run", "single"],
    )


def _cut(batches):
    """Length, removed bytes, number of removed spans and hash of what is kept, per document."""
    for batch in batches:
        lengths, removed, spans, kept = [], [], [], []
        for text, runs in zip(batch.column(1), batch.column(2)):
            text = text.as_py()
            runs = np.array(runs.as_py() or [], np.int64)
            lengths.append(len(text))
            if not len(runs):
                removed.append(0)
                spans.append(0)
                kept.append(hashlib.sha256(text).hexdigest())
                continue
            starts = runs >> RUN_BITS
            ends = starts + (runs & ((1 << RUN_BITS) - 1)) + (LENGTH - 1)
            order = np.argsort(starts, kind="stable")
            starts, reach = starts[order], np.maximum.accumulate(ends[order])
            new = np.ones(len(starts), bool)
            new[1:] = starts[1:] > reach[:-1]
            heads = np.flatnonzero(new)
            begin, end = starts[heads], reach[np.append(heads[1:], len(starts)) - 1]
            hasher, view = hashlib.sha256(), memoryview(text)
            for s, e in zip([0, *end.tolist()], [*begin.tolist(), len(text)]):
                hasher.update(view[s:e])
            removed.append(int((end - begin).sum()))
            spans.append(len(heads))
            kept.append(hasher.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(lengths, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())],
            ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def repeated_runs(texts: DataFrame, together: int = CONTEXTS) -> DataFrame:
    """Runs of starts (``doc``, ``run``) whose ``LENGTH``-byte string starts earlier as well.

    ``texts`` holds ``key`` (order of the documents) and ``text`` (binary); up to ``together`` contexts
    of an anchor are sorted together.
    """
    hashes = map_batches(texts, _anchor_hashes, "h long")
    again = stored(hashes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "anchors")
    found = map_batches(texts, _anchor_rows, "h long, c long, doc long, run long").join(again, "h")
    found = stored(found.select("h", "c", "doc", "run"), "anchor-places")
    discard(again)
    contexts = stored(
        found.groupBy("h", "c")
        .agg(F.min(F.struct("doc", "run")).alias("first"), F.count("*").alias("n"))
        .select("h", "c", F.col("first.doc").alias("doc"), F.col("first.run").alias("run"), "n"),
        "contexts",
    )
    # Later places of a context repeat all of the first.
    firsts = contexts.where("n > 1").select("h", "c", F.col("doc").alias("first_doc"), F.col("run").alias("first_run"))
    later = found.join(firsts, ["h", "c"]).where("doc <> first_doc OR run <> first_run").select("doc", "run")
    later = stored(later, "later-places")
    discard(found)
    mixed = stored(
        contexts.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), "mixed-anchors"
    )
    wanted = contexts.join(mixed, "h").groupBy("doc").agg(F.collect_list(F.struct("h", "kinds", "run")).alias("wanted"))
    spelt = texts.join(wanted, F.col("key") == F.col("doc")).select("key", "text", "wanted")
    spelt = map_batches(spelt, _contexts, "h long, kinds long, doc long, run long, context binary")
    # A large group is split by a hash of the place.
    parts = F.ceil(F.col("kinds") / F.lit(together))
    spelt = spelt.withColumn("part", F.pmod(F.xxhash64("doc", "run"), parts))
    dealt = spelt.repartition("h", "part").sortWithinPartitions("h", "part")
    dealt = dealt.select("h", "part", (F.col("kinds") > together).alias("split"), "doc", "run", "context")
    runs = stored(map_batches(dealt, _sorted_runs, "h long, w long, doc long, run long, single boolean"), "runs")
    discard(contexts, mixed)
    # Strings of split groups: all but the first over the parts.
    strings = runs.where("NOT single").select("h", "w", "doc", "run")
    least = strings.groupBy("h", "w").agg(F.min(F.struct("doc", "run")).alias("first"), F.count("*").alias("n"))
    least = stored(
        least.where("n > 1").select("h", "w", F.col("first.doc").alias("first_doc"), F.col("first.run").alias("first_run")),
        "first-strings",
    )
    across = strings.join(least, ["h", "w"]).where("doc <> first_doc OR run <> first_run").select("doc", "run")
    return later.unionByName(runs.where("single").select("doc", "run")).unionByName(across)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   together: int = CONTEXTS) -> DataFrame:
    """One row per document: ``id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    Removed is every byte covered by a string of ``LENGTH`` bytes that also starts earlier: in a
    document of a smaller id, or earlier in the same one.  Strings are judged on the input.  NULL and
    empty texts have nothing to remove.  Rows that share an id have to share their text; they are one
    document, and each gets its result.  Rows without an id come after all others, those of equal
    text as one document.  An empty table gives an empty result.
    """
    text = text_of(text_column)
    id_ = F.col(id_column).cast("long")
    key = F.coalesce(id_, F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(text), 2))
    rows = docs.select(id_.alias("id"), key.alias("key"), text.cast("binary").alias("text"))
    runs = repeated_runs(rows.select("key", "text"), together).groupBy("doc").agg(F.collect_list("run").alias("runs"))
    joined = rows.join(runs, F.col("key") == F.col("doc"), "left").select("id", "text", "runs")
    return map_batches(joined, _cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
