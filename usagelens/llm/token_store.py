"""Token ids of documents in compressed binary files.

A file is a sequence of groups, each ended by a new line.  A group holds whole documents, and all that
is needed to read it: a header, the documents' ids and numbers of token ids, and blocks of token ids
that are coded each on its own (see ``range_coder``) and carry a checksum.  All numbers are little-endian.

    header    4 bytes   "TKG1"
              u32       part: files are ordered by it
              u32       group: its number within the part
              u32, u32  numbers of documents and of blocks
              u64       bytes from the header to the last word of the blocks
              u32       CRC-32 of the header up to here and of the two tables
    documents i64 each  id; u64 each: number of token ids, and 1 << 63 if the id is NULL
    blocks    u32 x 3   each: number of token ids, number of words, CRC-32 of the ids as 4-byte numbers
    words     u32 each  of all blocks, one after the other
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import range_coder
from .range_coder import BLOCK, LANES
from .tables import map_batches, stored, text_of
from .tokens import byte_tokenizer

MAGIC = b"TKG1"
HEADER = struct.Struct("<4sIIIIQ")
#: Token ids from which a group is full; it ends with the document that reaches it.
GROUP_IDS = 1 << 20
#: Groups per file, so that a file, which is read as one row, stays far below 2 GB.
GROUPS_PER_FILE = 16
NO_ID = 1 << 63

DECODED = "doc_id long, part int, number int, document int, place long, n_tokens long, ids_crc32 long"


class FormatError(ValueError):
    """A file does not hold what its checksums say."""


def _cut(ids: np.ndarray) -> list[np.ndarray]:
    return [ids[at : at + BLOCK] for at in range(0, len(ids), BLOCK)]


def _in_step(blocks: list, length, code) -> list:
    """``code`` of up to ``LANES`` blocks at a time, longest first, in the blocks' own order."""
    order = sorted(range(len(blocks)), key=lambda i: -length(blocks[i]))
    result: list = [None] * len(blocks)
    for at in range(0, len(order), LANES):
        some = order[at : at + LANES]
        for i, coded in zip(some, code([blocks[i] for i in some])):
            result[i] = coded
    return result


def pack_groups(groups: list[tuple[list[int | None], list[np.ndarray]]], part: int, first: int) -> Iterator[bytes]:
    """The bytes of groups of documents (ids, and token ids as arrays of 2-byte numbers)."""
    cut = [_cut(np.concatenate(tokens)) for _, tokens in groups]
    words = _in_step([b for blocks in cut for b in blocks], len, range_coder.encode)
    at = 0
    for number, ((doc_ids, tokens), blocks) in enumerate(zip(groups, cut), start=first):
        coded, at = words[at : at + len(blocks)], at + len(blocks)
        names = np.array([i or 0 for i in doc_ids], "<i8").tobytes()
        counts = np.array([len(t) + (NO_ID if i is None else 0) for i, t in zip(doc_ids, tokens)], "<u8").tobytes()
        table = np.array(
            [(len(b), len(w), zlib.crc32(b.astype("<u4").tobytes())) for b, w in zip(blocks, coded)], "<u4"
        ).tobytes()
        payload = b"".join([w.astype("<u4").tobytes() for w in coded])
        size = HEADER.size + 4 + len(names) + len(counts) + len(table) + len(payload)
        header = HEADER.pack(MAGIC, part, number, len(doc_ids), len(blocks), size)
        checked = zlib.crc32(b"".join((header, names, counts, table)))
        yield b"".join((header, struct.pack("<I", checked), names, counts, table, payload))


def unpack_file(content: bytes) -> Iterator[tuple[int, int, list[int | None], np.ndarray, np.ndarray]]:
    """Part, number, document ids, numbers of token ids, and the token ids of every group of a file.

    Raises ``FormatError`` where a checksum, a length or a mark does not hold.
    """
    data, at, found = memoryview(content), 0, []
    while at < len(data):
        if len(data) - at < HEADER.size + 4:
            raise FormatError("a group is cut off")
        magic, part, number, n_docs, n_blocks, size = HEADER.unpack_from(data, at)
        tables = at + HEADER.size + 4
        words = tables + 16 * n_docs + 12 * n_blocks
        if magic != MAGIC or at + size + 1 > len(data) or words > at + size or data[at + size] != 10:
            raise FormatError("no group begins here, or it is cut off")
        (expected,) = struct.unpack_from("<I", data, tables - 4)
        if zlib.crc32(data[tables:words], zlib.crc32(data[at : tables - 4])) != expected:
            raise FormatError("the tables of a group are damaged")
        names = np.frombuffer(data, "<i8", n_docs, tables)
        counts = np.frombuffer(data, "<u8", n_docs, tables + 8 * n_docs)
        blocks = np.frombuffer(data, "<u4", 3 * n_blocks, tables + 16 * n_docs).reshape(-1, 3)
        if 4 * int(blocks[:, 1].sum()) != at + size - words:
            raise FormatError("the blocks of a group are cut off")
        ends = np.cumsum(blocks[:, 1]).tolist()
        payload = np.frombuffer(data, "<u4", ends[-1] if ends else 0, words)
        coded = [(payload[e - w : e], n, c) for (n, w, c), e in zip(blocks.tolist(), ends)]
        doc_ids = [None if c >= NO_ID else i for i, c in zip(names.tolist(), counts.tolist())]
        found.append((part, number, doc_ids, (counts & np.uint64(NO_ID - 1)).astype(np.int64), coded))
        at += size + 1
    every = [b for group in found for b in group[-1]]
    ids = _in_step(every, lambda b: b[1], lambda some: range_coder.decode([b[0] for b in some], [b[1] for b in some]))
    for (_, _, crc), block in zip(every, ids):
        if zlib.crc32(block.astype("<u4").tobytes()) != crc:
            raise FormatError("the token ids of a block are damaged")
    at = 0
    for part, number, doc_ids, counts, coded in found:
        tokens, at = ids[at : at + len(coded)], at + len(coded)
        whole = np.concatenate(tokens) if tokens else np.zeros(0, np.uint16)
        if len(whole) != counts.sum():
            raise FormatError("documents and blocks of a group do not agree")
        yield part, number, doc_ids, counts, whole


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0,
                 id_column: str = "doc_id", text_column: str = "text") -> None:
    """Write the token ids of every document, each ended by ``end_id``, in ascending order of ids.

    NULL ids come first; rows of one id are in the order of their texts' hashes, which also spreads an id
    that many rows have over the files.  NULL and empty texts are the end alone.  Other columns are not
    read.  A task holds the ids of ``LANES`` blocks and the texts that are encoded together, or one document
    if it has more.
    """

    def encoded(batches):
        part = TaskContext.get().partitionId()
        tokenizer, end = byte_tokenizer(vocabulary), end_id.to_bytes(2, "little")
        groups: list[tuple[list[int | None], list[np.ndarray]]] = []
        size, written = GROUP_IDS, 0

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(pack_groups(groups, part, written)), pa.binary())], ["value"]
            )

        for batch in batches:
            doc_ids = iter(batch.column(0).to_pylist())
            for ids, counts in tokenizer.encode_all(batch.column(1), end):
                for count, stop in zip(counts.tolist(), np.cumsum(counts).tolist()):
                    if size >= GROUP_IDS:
                        if len(groups) * GROUP_IDS >= LANES * BLOCK:
                            yield flushed()
                            written += len(groups)
                            groups.clear()
                        groups.append(([], []))
                        size = 0
                    groups[-1][0].append(next(doc_ids))
                    groups[-1][1].append(ids[stop - count : stop])
                    size += count
        if groups:
            yield flushed()

    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("spread"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(partitions, "id", "spread").sortWithinPartitions("id", "spread")
    # The text sink writes the bytes of a row as they are, and the separator of rows after them.
    flat = map_batches(ordered.select("id", "text"), encoded, "value binary").select(F.col("value").cast("string"))
    flat.write.option("lineSep", "\n").option("maxRecordsPerFile", GROUPS_PER_FILE).text(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files under ``path``: ``doc_id``, ``start`` (token ids of all documents
    before it), ``n_tokens`` (with the end), ``ids_crc32`` (of the ids as 4-byte little-endian numbers).

    Every file is decoded and checked on its own; damage fails the job with ``FormatError``.  Starts are
    sums over documents within a group, over groups within a part, and over parts, each a short list.
    No files, or empty ones, give no rows.
    """

    def decoded(batches):
        for batch in batches:
            for content in batch.column(0):
                for part, number, doc_ids, counts, ids in unpack_file(content.as_py()):
                    ends = np.cumsum(counts)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for n, e in zip(counts.tolist(), ends.tolist())]
                    n = len(doc_ids)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(doc_ids, pa.int64()), pa.array(np.full(n, part, np.int32)),
                            pa.array(np.full(n, number, np.int32)), pa.array(np.arange(n, dtype=np.int32)),
                            pa.array(ends - counts), pa.array(counts), pa.array(sums, pa.int64()),
                        ],
                        ["doc_id", "part", "number", "document", "place", "n_tokens", "ids_crc32"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    found = stored(map_batches(files, decoded, DECODED), "decoded-tokens")
    groups = found.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    before = "coalesce(sum(n) OVER ({} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    parts = groups.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.selectExpr("part", f"{before.format('ORDER BY part')} AS part_start")
    groups = groups.selectExpr("part", "number", f"{before.format('PARTITION BY part ORDER BY number')} AS group_start")
    starts = stored(
        groups.join(parts, "part").selectExpr("part", "number", "part_start + group_start AS before"), "group-starts"
    )
    return found.join(starts, ["part", "number"]).select(
        "doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Write the documents' token ids under ``path`` and read them back."""
    write_tokens(docs, path, vocabulary, end_id)
    return read_tokens(docs.sparkSession, path)
