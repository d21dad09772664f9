"""Near-duplicate detection by circulant MinHash, banding and exact verification.

All coordinates of a signature come from two permutations: the first places a shingle, the second is
read at that place shifted by the coordinate's number.  Documents whose signatures agree in a band
share a bucket.  Buckets are resolved without forming the pairs of their members: members are compared
with pivots, and what is left between different components of a bucket is compared in blocks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import map_batches, stored, text_of

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: Shingles of a batch that are hashed at a time: their coordinates stay in the processor's cache.
BLOCK = 1 << 15
#: Documents in a block of the last comparison; a task holds two blocks.
TOGETHER = 256
#: Shingles of two blocks that are compared by a matrix product; beyond, pairs are merged one by one.
MATRIX_SHINGLES = 1 << 21
COLUMNS = 1 << 13


@dataclass(frozen=True)
class Settings:
    """Words per shingle, the least similarity in percent, and the banding.

    A pair at 80 percent shares a band of six rows with probability 0.26, and none of 44 with
    probability 2e-6.
    """

    words: int = 5
    percent: int = 80
    bands: int = 44
    rows: int = 6


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``k`` words.

    Words are separated by ASCII white space; A to Z count as lower case.  Fewer than ``k`` words are
    one shingle, none are none.
    """
    digest = xxhash.xxh3_64_intdigest
    words = np.array([digest(w) for w in text.translate(_LOWER).split()], np.uint64)
    n = len(words)
    if n == 0:
        return words
    size = min(n, k)
    h = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        h = h * _ODD[0] + _mixed(words[i : n - size + 1 + i] + _ODD[1])
    return np.unique(_mixed(h))


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash of non-empty shingle sets, a row per set.

    A shingle's place is the upper half of its hash.  The second permutation is a bijection of 32-bit
    numbers; coordinate ``c`` reads it ``c`` places on, around the end.
    """
    result = np.empty((len(sets), coordinates), np.uint32)
    begin = 0
    while begin < len(sets):
        end, size = begin, 0
        while end < len(sets) and (size == 0 or size + len(sets[end]) <= BLOCK):
            size += len(sets[end])
            end += 1
        places = (np.concatenate(sets[begin:end]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in sets[begin : end - 1])])
        # A very long set is taken in blocks as well.
        for low in range(0, len(places), 4 * BLOCK):
            part = places[low : low + 4 * BLOCK]
            own = starts if len(part) == len(places) else np.zeros(1, np.int64)
            for c in range(coordinates):
                x = part + np.uint32(c)
                x ^= x >> np.uint32(16)
                x *= np.uint32(0x85EBCA6B)
                x ^= x >> np.uint32(13)
                x *= np.uint32(0xC2B2AE35)
                x ^= x >> np.uint32(16)
                least = np.minimum.reduceat(x, own)
                result[begin:end, c] = least if low == 0 else np.minimum(result[begin:end, c], least)
        begin = end
    return result


def band_keys(signature: np.ndarray, settings: Settings) -> np.ndarray:
    """A 64-bit key per set and band, of the band's number and coordinates."""
    parts = signature.reshape(len(signature), settings.bands, settings.rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(settings.bands, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(settings.rows):
        h = _mixed(h * _ODD[0] + parts[:, :, r] + _ODD[2])
    return h


def _signed(docs: DataFrame, settings: Settings, id_column: str, text_column: str) -> DataFrame:
    """``id``, ``n_shingles``, ``print`` (of the whole set) and ``bands``; the last two NULL for empty sets."""

    def sign(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                sets = [shingles(t.as_py(), settings.words) for t in part.column(1)]
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(signatures(full, settings.bands * settings.rows), settings).view(np.int64)) if full else iter(())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    ["id", "n_shingles", "print", "bands"],
                )

    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).cast("binary").alias("text"))
    return map_batches(rows, sign, "id long, n_shingles long, print binary, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose whole shingle sets are similar enough.

    The pairs meet their texts in two joins of plain tables, so that a node of very many pairs is
    split by the skew join.
    """
    with_b = pairs.join(texts.selectExpr("node AS b", "text AS text_b"), "b")
    both = with_b.join(texts.selectExpr("node AS a", "text AS text_a"), "a").select("a", "b", "text_a", "text_b")

    def compare(batches):
        last, own = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            linked = []
            for i, (x, left, right) in enumerate(zip(a, batch.column(2), batch.column(3))):
                left = left.as_py()
                if left != last:  # pairs of one node come together
                    last, own = left, shingles(left, settings.words)
                other = shingles(right.as_py(), settings.words)
                if settings.percent * max(len(own), len(other)) > 100 * min(len(own), len(other)):
                    continue
                if _similar(own, other, settings):
                    linked.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in linked], pa.int64()), pa.array([b[i] for i in linked], pa.int64())], ["a", "b"]
            )

    return map_batches(both, compare, "a long, b long")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (``node``, ``component``) after the components that ``links`` join are merged."""
    of = lambda end: labels.selectExpr(f"node AS {end}", f"component AS {end}_component")
    if links.isEmpty():
        return labels
    between = links.join(of("a"), "a").join(of("b"), "b").selectExpr("a_component AS a", "b_component AS b").distinct()
    merged = components(between).selectExpr("node AS old", "component AS new")
    renamed = labels.join(merged, F.col("component") == F.col("old"), "left")
    return stored(renamed.select("node", F.coalesce("new", "component").alias("component")), "components")


def _open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component: ``key``, ``node``, ``component``."""
    labelled = stored(members.join(labels, "node").select("key", "node", "component"), "labelled")
    mixed = (
        labelled.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high")
        .select("key")
    )
    return stored(labelled.join(stored(mixed, "mixed"), "key"), "open-members")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over blocks of shingles."""
    n = len(sets)
    result = np.zeros((n, n), np.float32)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    owner, column = owner[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    if len(column):
        column = np.cumsum(np.append(False, column[1:] != column[:-1]))
        for low in range(0, int(column[-1]) + 1, COLUMNS):
            begin, end = np.searchsorted(column, [low, low + COLUMNS])
            block = np.zeros((n, COLUMNS), np.float32)
            block[owner[begin:end], column[begin:end] - low] = 1
            result += block @ block.T
    sizes = [len(s) for s in sets]
    result[np.arange(n), np.arange(n)] = sizes
    return result.astype(np.int64)


def _links_within(rows: list[tuple], settings: Settings) -> list[tuple[int, int]]:
    """Links between different components among the documents of two blocks, one for each that joins two.

    ``rows`` holds block, node, component and text.
    """
    sets = [shingles(r[3], settings.words) for r in rows]
    block, component = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    sizes = np.array([len(s) for s in sets])
    # Of two blocks only pairs across; within a block it has a task of its own.
    apart = component[:, None] != component[None, :]
    if (block != block[0]).any():
        apart &= block[:, None] != block[None, :]
    if sizes.sum() <= MATRIX_SHINGLES:
        common = _overlaps(sets)
        alike = 100 * common >= settings.percent * (sizes[:, None] + sizes[None, :] - common)
        found = np.argwhere(np.triu(apart & alike, 1)).tolist()
    else:
        possible = 100 * np.minimum(sizes[:, None], sizes[None, :]) >= settings.percent * np.maximum(sizes[:, None], sizes[None, :])
        found = [(x, y) for x, y in np.argwhere(np.triu(apart & possible, 1)).tolist() if _similar(sets[x], sets[y], settings)]
    of = {c: c for c in component.tolist()}

    def root(c):
        while of[c] != c:
            of[c] = of[of[c]]
            c = of[c]
        return c

    links = []
    for x, y in found:
        a, b = root(rows[x][2]), root(rows[y][2])
        if a != b:
            of[max(a, b)] = min(a, b)
            links.append((rows[x][1], rows[y][1]))
    return links


def _similar(one: np.ndarray, other: np.ndarray, settings: Settings) -> bool:
    merged = np.concatenate([one, other])
    merged.sort()
    common = int(np.count_nonzero(merged[1:] == merged[:-1]))
    return 100 * common >= settings.percent * (len(merged) - common)


def _remaining_links(opened: DataFrame, texts: DataFrame, settings: Settings, together: int = TOGETHER) -> DataFrame:
    """Links between different components of open buckets.

    Open buckets that share members are one cluster.  A cluster is dealt into blocks, and every two
    blocks meet in a task, which puts out links only; no pair of documents becomes a row.
    """
    hubs = stored(opened.groupBy("key").agg(F.min("node").alias("hub")), "hubs")
    edges = opened.join(hubs, "key").where("node <> hub").selectExpr("node AS a", "hub AS b").distinct()
    clusters = components(edges).withColumnRenamed("component", "cluster")
    members = stored(opened.select("node", "component").distinct().join(clusters, "node"), "clustered")
    sizes = stored(
        members.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(together)).cast("int").alias("blocks")), "clusters"
    )
    dealt = members.join(sizes, "cluster").withColumn("block", F.expr("CAST(pmod(xxhash64(node), blocks) AS INT)"))
    dealt = dealt.join(texts, "node").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "cluster", F.least("block", "with").alias("first"), F.greatest("block", "with").alias("second"),
        "block", "node", "component", "text",
    )
    dealt = dealt.repartition("cluster", "first", "second").sortWithinPartitions("cluster", "first", "second")

    def compare(batches):
        held, last = [], None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            links = []
            for *where, block, node, component, text in zip(*columns):
                if where != last and held:
                    links += _links_within(held, settings)
                    held = []
                last = where
                held.append((block, node, component, text))
            yield _link_batch(links)
        if held:
            yield _link_batch(_links_within(held, settings))

    return map_batches(dealt, compare, "a long, b long")


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"]
    )


def find_groups(docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id",
                text_column: str = "text", pivot_rounds: int = 1) -> DataFrame:
    """One row per document: ``id``, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked if their shingle sets have a similarity of at least ``settings.percent``;
    ``component_id`` is the smallest id that links lead to, and that document is kept.  Documents
    without words are linked with nothing.  NULL ids: such rows take the component of an equal set, or
    NULL, and only the latter are kept.  Rows that share an id are one document.  An empty table gives
    an empty result.

    Equal sets are one node.  In a bucket, members are first compared with the smallest node, then with
    one more pivot that a hash picks in each of ``pivot_rounds``; these only save work.  At the end all
    documents that share a bucket and lie in different components are compared, so no link that
    banding offers is lost.
    """
    signed = stored(_signed(docs, settings, id_column, text_column), "signatures")
    nodes = stored(
        signed.where("n_shingles > 0")
        .groupBy("print")
        .agg(F.min("id").alias("node"), F.first("bands").alias("bands"))
        .where("node IS NOT NULL"),
        "nodes",
    )
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    buckets = stored(
        keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("most")).where("pivot <> most").select("key", "pivot"),
        "buckets",
    )
    members = stored(keyed.join(buckets, "key"), "members")
    found = members.select("node").distinct()
    texts = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).cast("binary").alias("text"))
    texts = stored(texts.join(found, F.col("id") == F.col("node"), "left_semi").selectExpr("id AS node", "text"), "texts")

    labels = stored(found.selectExpr("node", "node AS component"), "components")
    pairs = stored(members.where("node <> pivot").selectExpr("node AS a", "pivot AS b").distinct(), "pairs")
    members = members.select("key", "node")
    for attempt in range(pivot_rounds + 1):
        labels = _relabelled(labels, stored(_verified(pairs, texts, settings), "links"))
        opened = _open_buckets(members, labels)
        if attempt < pivot_rounds:
            pairs = stored(_pairs_with_pivots(opened, attempt), "pairs")
    labels = _relabelled(labels, stored(_remaining_links(opened, texts, settings), "links"))

    grouped = stored(
        nodes.select("print", "node").join(labels, "node", "left").select("print", F.coalesce("component", "node").alias("component_id")),
        "set-components",
    )
    result = signed.select("id", "n_shingles", "print").join(grouped, "print", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return result.select("id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("id").eqNullSafe(F.col("component_id"))
    )


def _pairs_with_pivots(opened: DataFrame, attempt: int) -> DataFrame:
    """Members (``a`` over ``b``) of open buckets with one pivot each that lies in another component."""
    chance = F.xxhash64(F.lit(attempt), "key", "node")
    pivots = opened.groupBy("key").agg(F.min(F.struct(chance.alias("chance"), "node", "component")).alias("pivot"))
    pivots = stored(pivots.selectExpr("key", "pivot.node AS other", "pivot.component AS its"), "pivots")
    pairs = opened.join(pivots, "key").where("component <> its")
    return pairs.selectExpr("greatest(node, other) AS a", "least(node, other) AS b").distinct()


def drop_near_duplicates(docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id",
                         text_column: str = "text") -> DataFrame:
    """The documents of which one per group stays, with all their columns."""
    dropped = stored(
        find_groups(docs, settings, id_column, text_column).where("NOT kept AND id IS NOT NULL").select("id").distinct(),
        "near-copies",
    ).withColumnRenamed("id", "__dropped_id")
    return docs.join(dropped, F.col(id_column) == F.col("__dropped_id"), "left_anti")
