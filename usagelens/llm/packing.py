"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Only the lengths of the pieces matter for a packing, and there are no more different lengths than
tokens in a sequence.  So the instance is the histogram of lengths: the driver reduces and packs it,
whatever the number of documents, and the pieces look their places up by their rank among the pieces
of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import map_batches, stored, text_of
from .tokens import tokenizer

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass
class Pattern:
    """``count`` sequences that all hold ``items``: (length, how many of it)."""

    count: int
    items: list[tuple[int, int]]


def reduce_by_dominance(counts: list[int], capacity: int) -> list[Pattern]:
    """Fix sequences that some optimal packing must be free to hold (Martello and Toth's reduction).

    ``counts[w]`` is the number of pieces of length ``w``; fixed pieces are taken out of it.  For a
    piece of length ``w``, a set of at most three pieces with it dominates every other set with it if
    the others' pieces fit, group by group, into its own; then nothing is lost by making it a
    sequence.  With ``best`` the longest piece that fits beside ``w``:

    * nothing fits: ``{w}``;
    * at most one piece fits, or ``best`` fills the sequence: ``{w, best}``;
    * at most two fit: ``{w, best}`` if no pair is longer than ``best``; else the longest pair that
      fits, if it holds ``best`` and no two pieces longer than its smaller one fit together instead.

    All conditions outlast the removal of pieces, so a whole class of equal sets is fixed at a time.
    """
    fixed: list[Pattern] = []
    for w in range(capacity, 0, -1):
        while counts[w]:
            chosen = _dominating(counts, capacity, w)
            if chosen is None:
                break
            need = {x: chosen.count(x) for x in chosen}
            times = min(counts[x] // n for x, n in need.items())
            for x, n in need.items():
                counts[x] -= n * times
            fixed.append(Pattern(times, sorted(need.items(), reverse=True)))
    return fixed


def _dominating(counts: list[int], capacity: int, w: int) -> list[int] | None:
    room = capacity - w
    counts[w] -= 1
    try:
        best = _longest(counts, room)
        if best is None:
            return [w]
        if best == room:
            return [w, best]
        smallest = _smallest(counts, room, 3)
        fit = 0
        total = 0
        for x in smallest:
            total += x
            if total > room:
                break
            fit += 1
        if fit <= 1:
            return [w, best]
        if fit == 2:
            longer, shorter = _longest_pair(counts, room)
            if best >= longer + shorter:
                return [w, best]
            # Two pieces above the shorter one, besides ``longer``, that fit together?
            counts[longer] -= 1
            above = _smallest(counts, room, 2, over=shorter, upto=longer)
            counts[longer] += 1
            if longer == best and (len(above) < 2 or sum(above) > room):
                return [w, longer, shorter]
        return None
    finally:
        counts[w] += 1


def _longest(counts: list[int], room: int) -> int | None:
    for x in range(min(room, len(counts) - 1), 0, -1):
        if counts[x]:
            return x
    return None


def _smallest(counts: list[int], room: int, number: int, over: int = 0, upto: int | None = None) -> list[int]:
    """The ``number`` shortest lengths (with repetition) over ``over`` and up to ``upto`` or ``room``."""
    found: list[int] = []
    for x in range(over + 1, min(room if upto is None else upto, len(counts) - 1) + 1):
        found += [x] * min(counts[x], number - len(found))
        if len(found) == number:
            break
    return found


def _longest_pair(counts: list[int], room: int) -> tuple[int, int]:
    """The two pieces with the largest sum within ``room``; of equal sums the one with the longest piece."""
    present = [x for x in range(1, min(room, len(counts) - 1) + 1) if counts[x]]
    best = (0, 0)
    low, high = 0, len(present) - 1
    while low <= high:
        a, b = present[high], present[low]
        if a + b > room:
            high -= 1
            continue
        if (low < high or counts[a] >= 2) and a + b > sum(best):
            best = (a, b)
        low += 1
    return best


def best_fit(counts: list[int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over the histogram; equal sequences are handled together."""
    by_room: dict[int, list[Pattern]] = {}
    rooms: list[int] = []
    done: list[Pattern] = []

    def put(pattern: Pattern, room: int) -> None:
        if room == 0:
            done.append(pattern)
            return
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append(pattern)

    for w in range(capacity, 0, -1):
        left = counts[w]
        while left:
            at = bisect_left(rooms, w)
            room = rooms[at] if at < len(rooms) else capacity
            each = room // w
            if at < len(rooms):
                open_ = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
            else:
                open_ = Pattern(-(-left // each), [])
            full = min(open_.count, left // each)
            if full:
                put(Pattern(full, [*open_.items, (w, each)]), room - each * w)
                left -= full * each
            rest = open_.count - full
            if rest and left and left < each:
                put(Pattern(1, [*open_.items, (w, left)]), room - left * w)
                rest -= 1
                left = 0
            if rest:
                put(Pattern(rest, open_.items), room)
    return done + [p for patterns in by_room.values() for p in patterns]


def pack_histogram(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold every counted length exactly as often as it is counted."""
    left = [0] * (capacity + 1)
    for w, n in counts.items():
        if not 1 <= w <= capacity:
            raise ValueError(f"length {w} is not between 1 and {capacity}")
        left[w] = n
    fixed = reduce_by_dominance(left, capacity)
    return fixed + best_fit(left, capacity)


def slots(patterns: list[Pattern]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Rows of the place table: length, first and last rank, first sequence, pieces of it per sequence,
    offset of the first.

    Ranks of a length run through the rows in order.  A sequence holds fewer than sqrt(2 * capacity)
    different lengths and there are at most about two patterns per length, so the table is bounded by
    the capacity alone.  One short length may still have a place in most of the patterns.
    """
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern in patterns:
        offset = 0
        for length, each in pattern.items:
            first = ranks.get(length, 0)
            ranks[length] = first + pattern.count * each
            yield length, first, ranks[length] - 1, sequence, each, offset
            offset += length * each
        sequence += pattern.count


def tokenised_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int,
                     id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every document's ids, then ``end_id``, cut into pieces of at most ``capacity`` ids."""

    def cut(batches):
        encode = tokenizer(vocabulary).encode
        end = end_id.to_bytes(4, "little")
        size = 4 * capacity
        for batch in batches:
            ids, pieces, starts, lengths, sums = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = memoryview(encode(text.as_py()) + end)
                for n, at in enumerate(range(0, len(raw), size)):
                    part = raw[at : at + size]
                    ids.append(doc_id)
                    pieces.append(n)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    return map_batches(texts, cut, PIECES)


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (as ``PIECES``, stored) with ``sequence_id`` and ``offset``.

    A piece's rank among those of its length is counted in two steps, so that a length which most
    pieces have is not ranked in one task: within buckets, and over the buckets' counts.
    """
    spark = pieces.sparkSession
    parts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bucketed = pieces.withColumn("bucket", F.expr(f"pmod(xxhash64(doc_id, piece), {parts})"))
    counts = stored(bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n")), "length-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = list(slots(pack_histogram(histogram, capacity)))
    before = counts.withColumn("before", F.expr("sum(n) OVER (PARTITION BY length ORDER BY bucket) - n")).drop("n")
    ranked = (
        bucketed.withColumn(
            "within",
            F.expr("row_number() OVER (PARTITION BY length, bucket ORDER BY doc_id, piece, start, ids_crc32) - 1"),
        )
        .join(before, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("within"))
    )
    ordered = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return map_batches(ordered, _placed(places), f"{PIECES}, sequence_id long, offset long")


def _placed(places: list[tuple[int, int, int, int, int, int]]):
    """Puts pieces at their places: of the runs of a length, a binary search finds that of a rank."""
    length, first, _, sequence, each, at = np.array(sorted(places), np.int64).reshape(-1, 6).T.copy()
    # Runs of a length follow one another, so one sorted array of (length, rank) serves all lengths.
    starts = np.searchsorted(length, np.arange(length.max(initial=0) + 2))

    def place(batches):
        for batch in batches:
            wanted, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            low, high = starts[wanted], starts[wanted + 1]
            while (open_ := high - low > 1).any():
                middle = (low + high) // 2
                reached = open_ & (first[np.minimum(middle, len(first) - 1)] <= rank)
                low, high = np.where(reached, middle, low), np.where(open_ & ~reached, middle, high)
            inside = rank - first[low]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:5],
                    pa.array(sequence[low] + inside // each[low]),
                    pa.array(at[low] + inside % each[low] * wanted),
                ],
                [*batch.schema.names[:5], "sequence_id", "offset"],
            )

    return place


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1,
         id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pack the documents' tokens into as few sequences of ``capacity`` as the method finds.

    One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``,
    ``offset``.  Pieces lie in their sequence without gaps.  NULL and empty texts are a piece with
    ``end_id`` alone.  Repeated rows are packed as often as they come, so their pieces repeat.  An
    empty table packs to nothing.
    """
    pieces = tokenised_pieces(docs, vocabulary, capacity, end_id, id_column, text_column)
    return pack_pieces(stored(pieces, "pieces"), capacity)
