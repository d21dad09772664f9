"""Repair of the structure of conversations.

Rows are sorted by conversation and turn over range partitions, so that a conversation of any size is
spread like the rest.  A task repairs the conversations that lie wholly within it.  Those at its edges
are done apart: their rows are reduced to features, sorted again, searched in segments from every
state to every state, and the segments are stitched.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .repair_search import START, Stitched, ended, repair, segment_table
from .tables import map_batches, stored

SPACE = " \t\n\x0b\x0c\r"
#: A conversation with more rows or characters in one task is done in segments.
WHOLE_ROWS, WHOLE_CHARS = 20_000, 1 << 24
LARGEST = (1 << 63) - 1
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
LEGAL = {"su", "ua", "au"}


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with faults dealt out by the hash of ``conv:turn`` (NULL as one space).

    Columns ``conv``, ``turn``, ``role``, ``text`` (NULL as one space) and ``copies``: 0 for a dropped row, 2 for a
    repeated one.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")) % 20
    said = F.coalesce(F.col(text), F.lit(" "))
    return rows.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.when(code == 4, "user").otherwise(F.coalesce(F.col(role), F.lit(" "))).alias("role"),
        F.when((code == 0) | (code == 1), "").when(code == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said).alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"),
    )


def undamaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """As ``damaged``, with the rows as they are."""
    said = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), said(role).alias("role"),
        said(text).alias("text"), F.lit(1).alias("copies"),
    )


def kind_of(role: str, text: str, repeated: bool) -> tuple[str, str]:
    """A row's fault and its letter for the search."""
    bare = text.rstrip(SPACE)
    if not bare:
        return "blank", "x"
    if repeated:
        return "duplicate", "x"
    letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return ("", letter) if bare[-1] in ".!?" else ("truncated", letter.upper())


@dataclass
class Report:
    """What is known of the rows of a conversation, or of a part of it, taken in order."""

    letters: list[str] = field(default_factory=list)
    faults: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("blank", "duplicate", "truncated"), 0))
    illegal: int = 0
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    first: str | None = None
    last: str | None = None

    def add(self, turn: int | None, initial: str, fault: str, letter: str, times: int = 1) -> None:
        self.letters.append(letter)
        if times > 1:
            self.letters.append("x" * (times - 1))
            self.illegal += times - 1
        if fault:
            self.faults[fault] += 1
        if times > 1:
            self.faults["blank" if fault == "blank" else "duplicate"] += times - 1
        self.illegal += self.last is not None and self.last + initial not in LEGAL
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn, self.last_turn = turn if self.first_turn is None else self.first_turn, turn

    def join(self, other: Report) -> None:
        """Take in the report of the rows that follow; their letters are left out."""
        for fault, n in other.faults.items():
            self.faults[fault] += n
        self.illegal += other.illegal
        if self.last is not None and other.first is not None:
            self.illegal += self.last + other.first not in LEGAL
        self.turns += other.turns - (other.first_turn is not None and other.first_turn == self.last_turn)
        if self.first_turn is None:
            self.first_turn = other.first_turn
        if other.last_turn is not None:
            self.last_turn = other.last_turn
        self.first = other.first if self.first is None else self.first
        self.last = self.last if other.last is None else other.last

    @property
    def gaps(self) -> int:
        if self.first_turn is None or self.last_turn is None:
            return 0
        return min(self.last_turn - self.first_turn + 1 - self.turns, LARGEST)

    def row(self, cost: int, audit: str) -> tuple:
        f = self.faults
        return self.gaps, f["blank"], f["duplicate"], f["truncated"], self.illegal, cost, audit


class Rewritten:
    """SHA-256 of the repaired rows, fed in order with the audit."""

    def __init__(self, audit: str) -> None:
        self._audit, self._at = audit, 0
        self._hash, self._lines, self._before = hashlib.sha256(), 0, ""

    def _write(self, role: str, text: str) -> None:
        self._hash.update((f"\n{role}:{text}" if self._lines else f"{role}:{text}").encode())
        self._lines += 1
        self._before = role[:1]

    def _inserted(self) -> None:
        while self._at < len(self._audit) and self._audit[self._at] == "I":
            self._write(self._fitting(), "")
            self._at += 1

    def _fitting(self) -> str:
        return "assistant" if self._before == "u" else "user"

    def add(self, role: str, text: str) -> None:
        self._inserted()
        letter = self._audit[self._at]
        self._at += 1
        if letter == "K":
            self._write(role, text)
        elif letter == "R":
            self._write(self._fitting(), text)

    def hexdigest(self) -> str:
        self._inserted()
        return self._hash.hexdigest()


def _row_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


_RESULT = [
    *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()),
]
#: NULL keys and a place in the order of a conversation; rows that agree in all of it are the same.
ORDER = ("conv", "turn", "role", "digest")


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def _within_tasks(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Repair the conversations that begin and end in this task; the others are named as open."""
    schema = pa.schema([("conv", kind), ("open", pa.bool_()), *_RESULT, ("repaired_sha256", pa.string())])
    nothing = (None,) * (len(schema) - 2)

    def repaired(rows: list[tuple]) -> tuple:
        report, seen = Report(), set()
        for turn, role, text, digest in rows:
            fault, letter = kind_of(role, text, (role, digest) in seen)
            seen.add((role, digest))
            report.add(turn, role[:1], fault, letter)
        cost, audit = repair("".join(report.letters))
        rewritten = Rewritten(audit)
        for _, role, text, _ in rows:
            rewritten.add(role, text)
        return (*report.row(cost, audit), rewritten.hexdigest())

    def solved() -> Iterator[tuple]:
        waiting = None
        for number, (conv, rows) in enumerate(groupby(_row_stream(batches), key=lambda r: r[0])):
            if waiting is not None:
                yield waiting()
            held, chars, is_open = [], 0, number == 0
            for _, turn, role, digest, text, copies in rows:
                if is_open or not copies:
                    continue
                held += [(turn, role, text, digest)] * copies
                chars += len(text)
                if len(held) > WHOLE_ROWS or chars > WHOLE_CHARS:
                    is_open, held = True, []
            if is_open:
                yield (conv, True, *nothing)
                waiting = None
            else:
                # Whether it ends here is known once another one follows.
                waiting = lambda conv=conv, held=held: (conv, False, *repaired(held))
                last = conv
        if waiting is not None:
            yield (last, True, *nothing)

    return _batches(solved(), schema)


def _segments(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """One row per conversation of this task: what its part here says, and the best repairs of it."""
    schema = pa.schema([("conv", kind), ("segment", pa.int32()), ("part", pa.binary())])
    number = TaskContext.get().partitionId()

    def parts() -> Iterator[tuple]:
        for conv, rows in groupby(_row_stream(batches), key=lambda r: r[0]):
            report = Report()
            for _, turn, initial, fault, letter, times in rows:
                report.add(turn, initial, fault, letter, times)
            table = segment_table("".join(report.letters))
            report.letters = []
            yield conv, number, pickle.dumps((report, table))

    return _batches(parts(), schema, 20)


def _stitched(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The best repair of every conversation from its segments, in order."""
    schema = pa.schema([("conv", kind), *_RESULT])

    def whole() -> Iterator[tuple]:
        for conv, rows in groupby(_row_stream(batches), key=lambda r: r[0]):
            report, best = Report(), Stitched(START)
            for _, _, part in rows:
                following, table = pickle.loads(part)
                report.join(following)
                best.add(table)
            yield (conv, *report.row(*ended(best.best())))

    return _batches(whole(), schema, 20)


def _hashed(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Hash every conversation's repaired rows as they stream by, its audit first."""
    schema = pa.schema([("conv", kind), ("repaired_sha256", pa.string())])

    def hashes() -> Iterator[tuple]:
        for conv, rows in groupby(_row_stream(batches), key=lambda r: r[0]):
            rewritten = None
            for _, audit, role, text, copies in rows:
                if rewritten is None:
                    rewritten = Rewritten(audit)
                else:
                    for _ in range(copies):
                        rewritten.add(role, text)
            yield conv, rewritten.hexdigest()

    return _batches(hashes(), schema)


def _sorted(rows: DataFrame, *columns: str) -> DataFrame:
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(partitions, *ORDER).sortWithinPartitions(*ORDER).select(*columns)


def _open_results(rows: DataFrame, kind: pa.DataType, sql_kind: str) -> DataFrame:
    """Results of the conversations of ``rows``, each of any size.

    Equal rows (same turn, role and text) are one row with a number from here on.  Of equal messages the
    one of the first turn is no duplicate, which an aggregate finds; a message that very many turns have
    is split by the skew join.  The repaired text is one hash over one conversation, so one task streams it.
    """
    live = rows.where("copies > 0")
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    features = stored(
        live.groupBy(*ORDER)
        .agg(F.sum("copies").cast("long").alias("times"), F.first(F.struct(
            initial.alias("initial"), (F.length(bare) == 0).alias("blank"),
            F.substring(bare, -1, 1).isin(".", "!", "?").alias("ended"), letter.alias("letter"),
        )).alias("seen"))
        .select(*ORDER, "times", "seen.*"),
        "conversation-features",
    )
    firsts = features.where("NOT blank").groupBy("conv", "role", "digest").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn"))["turn"].alias("first_turn")
    )
    f, g = features.alias("f"), stored(firsts, "first-messages").alias("g")
    matched = f.join(
        g,
        F.col("f.conv").eqNullSafe(F.col("g.conv")) & (F.col("f.role") == F.col("g.role"))
        & (F.col("f.digest") == F.col("g.digest")),
        "left",
    )
    fault = F.when(F.col("f.blank"), "blank").when(
        ~F.col("f.turn").eqNullSafe(F.col("g.first_turn")), "duplicate"
    ).when(~F.col("f.ended"), "truncated").otherwise("")
    told = matched.select(*[F.col(f"f.{c}").alias(c) for c in (*ORDER, "initial", "letter", "times")], fault.alias("fault"))
    shown = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(
        F.col("fault") == "truncated", F.upper("letter")
    ).otherwise(F.col("letter"))
    told = stored(told.withColumn("shown", shown), "conversation-faults")
    ordered = _sorted(told, "conv", "turn", "initial", "fault", "shown", "times")
    segments = stored(
        map_batches(ordered, lambda b: _segments(b, kind), f"conv {sql_kind}, segment int, part binary"), "conversation-segments"
    )
    results = stored(
        map_batches(
            segments.repartition("conv").sortWithinPartitions("conv", "segment"), lambda b: _stitched(b, kind),
            f"conv {sql_kind}, {COUNTS}",
        ),
        "conversation-results",
    )
    none = lambda name, t: F.lit(None).cast(t).alias(name)
    marks = results.select(
        "conv", F.lit(0).alias("place"), none("turn", "long"), none("role", "string"), none("digest", "binary"),
        "audit", none("text", "string"), F.lit(0).alias("copies"),
    )
    texts = live.select(
        "conv", F.lit(1).alias("place"), "turn", "role", "digest", F.lit(None).cast("string").alias("audit"), "text", "copies"
    )
    streamed = marks.union(texts).repartition("conv").sortWithinPartitions("conv", "place", "turn", "role", "digest")
    hashes = map_batches(
        streamed.select("conv", "audit", "role", "text", "copies"), lambda b: _hashed(b, kind),
        f"conv {sql_kind}, repaired_sha256 string",
    )
    r, h = results.alias("r"), hashes.alias("h")
    return r.join(h, F.col("r.conv").eqNullSafe(F.col("h.conv"))).select("r.*", "h.repaired_sha256")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (as ``damaged`` gives them): ``conv``, ``gaps``, ``blank``, ``duplicate``,
    ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.

    Rows come in the order of turn (NULL first), role and MD5 of the text; the copies of a repeated row
    follow it.  Rows with a NULL conversation are one conversation.  A conversation without rows left has
    zeros, an empty audit and the hash of nothing.  Initials are of whatever role a row has: one that is not
    ``s``, ``u`` or ``a`` is rerolled or deleted.  An empty table gives an empty result.
    """
    rows = rows.withColumn("digest", _digest("text"))
    sql_kind = rows.schema["conv"].dataType.simpleString()
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(sql_kind)
    if kind is None:
        raise ValueError(f"conversations are named by whole numbers or texts, not by {sql_kind}")
    first = stored(
        map_batches(
            _sorted(rows, *ORDER, "text", "copies"), lambda b: _within_tasks(b, kind),
            f"conv {sql_kind}, open boolean, {COUNTS}, repaired_sha256 string",
        ),
        "conversations",
    )
    # An open conversation may lie in several tasks.
    names = stored(first.where("open").select("conv").distinct(), "open-conversations")
    a, b = rows.alias("a"), names.alias("b")
    some = stored(
        a.join(b, F.col("a.conv").eqNullSafe(F.col("b.conv")), "left_semi").select("a.*"), "open-rows"
    )
    rest = _open_results(some, kind, sql_kind)
    n, r = names.alias("n"), rest.alias("r")
    nothing = hashlib.sha256().hexdigest()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    apart = n.join(r, F.col("n.conv").eqNullSafe(F.col("r.conv")), "left").select(
        "n.conv",
        *[F.coalesce(f"r.{c}", F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("r.audit", F.lit("")).alias("audit"),
        F.coalesce("r.repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
    # A conversation too long for a task is open there, and may be whole in no other.
    return first.where("NOT open").drop("open").unionByName(apart)
