"""WARC archives: writing pages as segmented records, and reassembling them.

A page's record holds an HTTP message in chunked transfer framing.  A message longer than a segment is
split: the first segment is the ``response`` record itself, the others are ``continuation`` records
that name it.  Of equal payloads only one is stored; the other records are revisits of it.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import map_batches, stored, text_of

CRLF = "\r\n"
VERSION = "WARC/1.1"
#: A payload shorter than this is stored with every record.
REVISIT_BYTES = 1000
SEGMENT_BYTES = 1 << 16
CHUNK_BYTES = 1 << 13
RECORDS_PER_FILE = 20_000

PARSED = (
    "record_id string, page_id long, record_type string, payload_bytes long, payload_digest string, "
    "refers_to long, segment int, total_length long, block binary"
)


def _lines(*lines: Column) -> Column:
    """Header lines; NULL ones are left out."""
    return F.concat_ws(CRLF, *lines)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"))


def _message(headers: Column, body: Column, chunk: int) -> Column:
    """An HTTP message; ``body`` (binary) in chunks, each with its length in hexadecimal."""
    size = F.octet_length(body)
    piece = lambda at: F.substring(body, at + 1, F.lit(chunk))
    framed = F.transform(
        F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(chunk)),
        lambda at: F.concat(
            F.hex(F.octet_length(piece(at)).cast("long")), F.lit(CRLF), piece(at).cast("string"), F.lit(CRLF)
        ),
    )
    chunks = F.when(size > 0, F.array_join(framed, "")).otherwise(F.lit(""))
    return F.concat(headers, F.lit(CRLF + CRLF), chunks, F.lit(f"0{CRLF}{CRLF}"))


def archive_records(pages: DataFrame, segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES,
                    date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The records of ``pages`` (``page_id``, ``url``, ``html``), each as one ``value``.

    Of pages with equal payloads of at least ``REVISIT_BYTES``, the one with the largest id is the
    response.  Which payloads are shared is found from their digests; pages meet only the digests that
    several of them have.
    """
    rows = pages.select("page_id", "url", text_of("html").cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    shared = stored(
        rows.where(F.col("size") >= REVISIT_BYTES)
        .groupBy("sha1")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("newest"))
        .where("n > 1")
        .select("sha1", "newest"),
        "payloads",
    )
    rows = rows.join(shared, "sha1", "left").withColumn("id", F.expr("uuid()"))
    revisit = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    rows = rows.withColumn("revisit", revisit)
    target = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.lit("urn:page:unknown"))
    http = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8")
    full = _message(F.concat(http, F.lit(f"{CRLF}Transfer-Encoding: chunked")), F.col("payload"), chunk)
    bare = F.concat(http, F.lit(CRLF), _line("Content-Length", F.col("size")), F.lit(CRLF + CRLF))
    rows = rows.select(
        "page_id", "id", "sha1", "newest", "revisit", target.alias("target"),
        F.when(F.col("revisit"), bare).otherwise(full).cast("binary").alias("block"),
    ).withColumn("total", F.octet_length("block"))
    starts = F.sequence(F.lit(0), F.greatest(F.col("total") - 1, F.lit(0)), F.lit(segment))
    parts = rows.select("*", F.posexplode(starts).alias("n", "at")).withColumn(
        "part", F.substring(F.col("block"), F.col("at") + 1, F.lit(segment))
    )
    first, several = F.col("n") == 0, F.col("total") > segment
    identity = F.concat(F.lit("<urn:uuid:"), F.col("id"), F.lit(">"))
    kind = F.when(~first, "continuation").when(F.col("revisit"), "revisit").otherwise("response")
    header = _lines(
        F.lit(VERSION),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", F.when(first, identity).otherwise(F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")))),
        F.lit(f"WARC-Date: {date}"),
        _line("WARC-Target-URI", F.col("target")),
        F.when(first, _line("X-Page-Id", F.col("page_id"))),
        F.when(first, _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1")))),
        F.when(first & F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(first & F.col("revisit"), _line("X-Refers-To-Page-Id", F.col("newest"))),
        F.when(~first, _line("WARC-Segment-Origin-ID", identity)),
        F.when(several, _line("WARC-Segment-Number", F.col("n") + 1)),
        F.when(~first & (F.col("at") + segment >= F.col("total")), _line("WARC-Segment-Total-Length", F.col("total"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        _line("Content-Length", F.octet_length("part")),
    )
    return parts.select(F.concat(header, F.lit(CRLF + CRLF), F.col("part").cast("string")).alias("value"))


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES,
                   per_file: int = RECORDS_PER_FILE) -> None:
    """Write pages as gzip-compressed archives of at most ``per_file`` records.

    The text sink writes a record's bytes as they are; its line separator is the two empty lines that
    end a record.
    """
    (
        archive_records(pages, segment, chunk)
        .write.option("lineSep", CRLF + CRLF)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", per_file)
        .text(path)
    )


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record; records are found by their lengths."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('warc-record-id')} is cut or overlong")
        yield headers, block


def payload_of(message: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP headers (names in lower case) and body of a message, chunked framing undone."""
    head, gap, body = message.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no end of the HTTP headers")
    headers = {}
    for line in head.decode("latin-1").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    if headers.get("transfer-encoding", "").lower() != "chunked":
        return headers, body
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return headers, b"".join(parts)
        part = body[end + 2 : end + 2 + size]
        if len(part) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut or overlong")
        parts.append(part)
        at = end + 4 + size


def _checked(record_id: str, digest: str, block: bytes) -> tuple[int, str]:
    """Length and SHA-1 of a response's payload, which must be the digest its record states."""
    payload = payload_of(block)[1]
    found = hashlib.sha1(payload).hexdigest()
    if digest and found != digest:
        raise ValueError(f"record {record_id}: payload has digest {found}, not {digest}")
    return len(payload), found


def _parse(batches):
    schema = pa.schema(
        [
            ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()),
            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
            ("segment", pa.int32()), ("total_length", pa.int64()), ("block", pa.binary()),
        ]
    )
    number = lambda headers, name: int(headers[name]) if name in headers else None
    for batch in batches:
        for name, content in zip(batch.column(0), batch.column(1)):
            data = io.BytesIO(content.as_py())
            stream = io.BufferedReader(gzip.GzipFile(fileobj=data)) if name.as_py().endswith(".gz") else data
            rows, size = [], 0
            for headers, block in parse_records(stream):
                kind, segment = headers["warc-type"], number(headers, "warc-segment-number")
                if kind not in ("response", "revisit", "continuation"):
                    continue
                record = headers["warc-segment-origin-id" if kind == "continuation" else "warc-record-id"]
                digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
                length = None
                if kind == "revisit":
                    length = int(payload_of(block)[0]["content-length"])
                elif segment is None:
                    length, digest = _checked(record, digest, block)
                rows.append(
                    (
                        record, number(headers, "x-page-id"), kind, length, digest, number(headers, "x-refers-to-page-id"),
                        segment, number(headers, "warc-segment-total-length"), block if segment else None,
                    )
                )
                size += len(block) if segment else 0
                if len(rows) >= 5000 or size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _reassembled(batches):
    """Payload length and digest of the records put together from their segments."""
    for batch in batches:
        rows = []
        for record, page, digest, segments in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)):
                raise ValueError(f"record {record}: a segment is missing or repeated")
            block = b"".join(s["block"] for s in segments)
            if segments[-1]["total_length"] != len(block):
                raise ValueError(f"record {record}: {len(block)} bytes, not {segments[-1]['total_length']}")
            rows.append((page, *_checked(record, digest, block)))
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))],
            ["page_id", "payload_bytes", "payload_digest"],
        )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page record of the archives under ``path``: ``page_id``, ``payload_bytes``,
    ``payload_digest``, ``record_type``, ``refers_to``.

    A task parses one archive; whole records are settled at once.  Segments are grouped by the id of
    the record they continue, put in order, checked against the total length and unframed; a gap, a
    wrong length or a wrong digest is an error.  Only segmented records are shuffled.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "part-*")
        .load(path)
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    )
    parsed = stored(map_batches(files, _parse, PARSED), "warc-records")
    result = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    whole = parsed.where("segment IS NULL").select(*result)
    segments = F.array_sort(F.collect_list(F.struct("segment", "total_length", "block")))
    gathered = (
        parsed.where("segment IS NOT NULL")
        .groupBy("record_id")
        .agg(F.max("page_id").alias("page_id"), F.max("payload_digest").alias("payload_digest"), segments.alias("segments"))
    )
    joined = (
        map_batches(gathered, _reassembled, "page_id long, payload_bytes long, payload_digest string")
        .withColumn("record_type", F.lit("response"))
        .withColumn("refers_to", F.lit(None).cast("long"))
    )
    return whole.unionByName(joined.select(*result))


def round_trip(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES) -> DataFrame:
    """Write ``pages`` as archives under ``path`` and read them back.

    NULL and empty payloads are stored as empty.  Pages without an id are stored and come back without
    one; of equal payloads they are never the response unless no page of the group has an id.  Rows
    that share the largest id of a group are all responses.  White space in addresses is escaped.  An
    empty table gives an empty result.
    """
    write_archives(pages, path, segment, chunk)
    return read_archives(pages.sparkSession, path)
