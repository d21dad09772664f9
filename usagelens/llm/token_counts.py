"""Token counts of documents in flat token files, by a scan for separators.

A flat file holds the ids of many documents, one after the other, each ended by the same id; there is
no index.  Files are searched block by block, and boundaries that lie in different blocks are stitched
by a prefix scan over the blocks.
"""

from __future__ import annotations

import gzip
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import map_batches, text_of
from .tokens import tokenizer

#: Ids per block of the scan.
BLOCK = 1 << 20


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int,
                      text_column: str = "text", per_file: int = 100_000) -> None:
    """Write the documents' ids (4 bytes, little-endian) as flat, gzip-compressed files of at most
    ``per_file`` documents.

    The text sink writes a row's bytes as they are, and after them its line separator: the last two
    bytes of an id below 65,536, which are zero.  So nothing but ids reaches the files.
    """
    if not 0 < end_id < 1 << 16:
        raise ValueError("the end of a document has to be an id of two bytes")

    def encoded(batches):
        encode = tokenizer(vocabulary, plain=True).encode
        head = end_id.to_bytes(2, "little")
        for batch in batches:
            ids = pa.array([encode(text.as_py()) + head for text in batch.column(0)], pa.large_binary())
            yield pa.RecordBatch.from_arrays([ids.cast(pa.binary())], ["ids"])

    texts = docs.select(text_of(text_column).alias("text"))
    flat = map_batches(texts, encoded, "ids binary").select(F.col("ids").cast("string").alias("value"))
    (
        flat.write.option("lineSep", "\0\0")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", per_file)
        .text(path)
    )


def _blocks(end_id: int, block: int):
    """Per file and block: the number of ids and the places of the separators."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int32()), ("n", pa.int64()), ("ends", pa.list_(pa.int32()))])

    def scan(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                data = io.BytesIO(content.as_py())
                name = name.as_py()
                stream = gzip.GzipFile(fileobj=data) if name.endswith(".gz") else data
                number = 0
                while part := stream.read(4 * block):
                    if len(part) % 4:
                        raise ValueError(f"{name} does not hold whole ids")
                    ends = np.flatnonzero(np.frombuffer(part, "<u4") == end_id).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name]), pa.array([number], pa.int32()), pa.array([len(part) // 4], pa.int64()),
                            pa.array([ends], pa.list_(pa.int32())),
                        ],
                        schema=schema,
                    )
                    number += 1

    return scan


def count_tokens(spark: SparkSession, path: str, end_id: int, block: int = BLOCK) -> DataFrame:
    """One row per document of the files under ``path``: ``token_file``, ``document`` (its number in the
    file, from 0), ``start`` (place of its first id in the file), ``n_tokens`` (without the separator)
    and ``complete`` (false for ids after a file's last separator).

    A document may span any number of blocks.  Empty documents count 0; files without ids give no row.
    A task holds one compressed file and one block.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "part-*")
        .load(path)
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    )
    blocks = map_batches(files, _blocks(end_id, block), "file string, block int, n long, ends array<int>")
    return stitch(blocks)


def stitch(blocks: DataFrame) -> DataFrame:
    """Documents from the blocks' separators: what lies before a block shifts its places and numbers,
    and the last separator before it is where its first document begins."""
    before = "OVER (PARTITION BY file ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    last_end: Column = F.when(F.size("ends") > 0, F.col("base") + F.element_at("ends", -1))
    scanned = (
        blocks.withColumn("base", F.expr(f"coalesce(sum(n) {before}, 0)"))
        .withColumn("numbered", F.expr(f"coalesce(sum(size(ends)) {before}, 0)"))
        .withColumn("last_end", last_end)
        .withColumn("previous", F.expr(f"coalesce(max(last_end) {before}, -1)"))
        .withColumn("final", F.expr("block = max(block) OVER (PARTITION BY file)"))
    )
    starts = lambda i: F.when(
        i > 0, F.col("base") + F.get("ends", i - 1) + 1
    ).otherwise(F.col("previous") + 1)
    inside = F.transform(
        "ends",
        lambda e, i: F.struct(
            (F.col("numbered") + i).alias("document"),
            starts(i).alias("start"),
            (F.col("base") + e - starts(i)).alias("n_tokens"),
            F.lit(True).alias("complete"),
        ),
    )
    begun = F.greatest(F.coalesce("last_end", F.lit(-1)), "previous") + 1
    total = F.col("base") + F.col("n")
    rest = F.struct(
        (F.col("numbered") + F.size("ends")).alias("document"),
        begun.alias("start"),
        (total - begun).alias("n_tokens"),
        F.lit(False).alias("complete"),
    )
    documents = F.when(F.col("final") & (begun < total), F.concat(inside, F.array(rest))).otherwise(inside)
    return scanned.select(F.col("file").alias("token_file"), F.inline(documents))
