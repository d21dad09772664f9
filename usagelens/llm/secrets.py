"""Secret scan: fixed patterns, and sliding-window entropy over candidate strings.

Everything is a DataFrame expression over one row's text; nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import text_of

#: Base kinds, in the order that breaks ties: pattern, group whose length counts, its least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {
    "assign": (ASSIGN, 2, 8),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    "hex": ("[0-9a-f]+", 0, 32),
}
#: The same matches, found faster: shorter runs of one class cannot hide longer ones.
FASTER = {"access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}"}

#: Put around matches.  Neither it nor its stand-in is part of any pattern.
MARK, STAND_IN = "\x01", "\x02"


@dataclass(frozen=True)
class CharacterClass:
    """A class of characters whose runs may be secrets, and the entropy from which they are."""

    alphabet: str
    pattern: str
    window: int
    bits: float


#: Kind -> class.  Twenty characters hold at most 4.32 bits each; prose stays below 3.6.
CLASSES = {
    "entropy_hex": CharacterClass("0123456789abcdef", "[0-9a-f]", 20, 3.0),
    "entropy_base64": CharacterClass(
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", "[A-Za-z0-9+/=_-]", 20, 3.75
    ),
}
#: The allow-list of the SQL twin, which drops whole candidates by it.  Here WORD, KNOWN and PLACEHOLDER
#: decide, which keep secrets that are glued to such a text.
ALLOWED = (
    "[A-Za-z]+",  # a word
    "[0-9]+",  # a number
    "[A-Za-z]*([-_/+=]+[A-Za-z]*)+",  # compounds and paths of words
    "[0-9]*([-_/+=]+[0-9]*)+",  # dates, phone numbers, rules of dashes
    "(?i).*(example|sample|placeholder|dummy|changeme|xxxx|abcdef|123456).*",
    "[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
)
#: Spans found by entropy are dropped if their whole text is known to be none, or a word, unless a window
#: holds LETTER_BITS: random letters do, words do not.
WORD = "^[A-Za-z]+$"
KNOWN = "^(" + "|".join(a for a in ALLOWED if a != "[A-Za-z]+" and "example" not in a) + ")$"
LETTER_BITS = 4.0
#: Where a whole part of a candidate is such a word, the pieces between '=' and '/' that hold it are
#: dropped and the others are looked at each by itself.
_EDGE = "[-_+=/]"
PLACEHOLDER = f"(?i)(^|{_EDGE})(example|sample|placeholder|dummy|changeme|x{{4,}}|abcdef|123456)({_EDGE}|$)"
#: Numbers that are summed in one go.
BLOCK = 64
SPAN = "array<struct<start:int,end:int,body:string>>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _ends(lengths: Column) -> Column:
    """Running sums.  An array that grows by one is copied whole, so sums run within blocks, then over blocks."""

    def running(numbers: Column) -> Column:
        grown = lambda a, n: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + n))
        return F.aggregate(numbers, F.array().cast("array<int>"), grown)

    def blocks(numbers: Column) -> Column:
        # By place: a slice would copy all numbers before it takes its own.
        last = F.size(numbers) - 1
        return F.transform(
            F.sequence(F.lit(0), last, F.lit(BLOCK)),
            lambda i: running(F.transform(F.sequence(i, F.least(i + (BLOCK - 1), last)), lambda j: F.get(numbers, j))),
        )

    def joined(b: Column) -> Column:
        def shifted(over: Column) -> Column:
            def shift(block: Column, k: Column) -> Column:
                before = F.when(k == 0, 0).otherwise(F.get(over, k - 1))
                return F.transform(block, lambda x: x + before)

            return F.flatten(F.transform(b, shift))

        return _bound(running(F.transform(b, lambda block: F.element_at(block, F.lit(-1)))), shifted)

    return _bound(_bound(lengths, blocks), joined)


def _matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places, in code points, in order."""
    # A text without a match is one part; so is every text that the first replacement leaves alone.
    parts = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)

    def spans(p: Column) -> Column:
        def odd(e: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)),
                lambda i: F.struct(F.get(e, i - 1).alias("start"), F.get(e, i).alias("end"), F.get(p, i).alias("body")),
            )

        return _bound(_ends(F.transform(p, lambda part: F.length(part))), odd)

    return _bound(parts, lambda p: F.when(F.size(p) == 1, F.array().cast(SPAN)).otherwise(spans(p).cast(SPAN)))


def _base(text: Column, kind: str) -> Column:
    pattern, group, least = BASE[kind]
    found = _matches(text, FASTER.get(kind, pattern))
    if kind in FASTER:
        return found
    return F.filter(found, lambda s: F.length(F.regexp_extract(s["body"], pattern, group)) >= least)


def window_entropy(body: Column, of: CharacterClass) -> Column:
    """First and last place (end exclusive) of the windows of ``body`` with enough entropy, NULL if none.

    Counts per character slide along: one character enters, one leaves, and the sum of c log2 c over
    the counts changes by the terms of these two alone.  The counts are a text of one letter per
    character of the class, in which two places are overlaid per step.
    """
    w = of.window
    terms = F.array(*[F.lit(c * math.log2(c) if c > 1 else 0.0) for c in range(w + 2)])
    levels = "".join(chr(ord("A") + c) for c in range(w + 2))
    level = F.array(*[F.lit(c) for c in levels])
    enough = (math.log2(w) - of.bits) * w + 1e-9

    def count_at(counts: Column, place: Column) -> Column:
        return F.ascii(F.substring(counts, place, F.lit(1))) - ord("A")

    def put(counts: Column, place: Column, count: Column) -> Column:
        return F.overlay(counts, F.get(level, count), place, F.lit(1))

    def slid(places: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            def left(old: Column) -> Column:
                gone = count_at(a["counts"], old)
                return F.when(
                    old > 0,
                    F.struct(
                        put(a["counts"], old, gone - 1).alias("counts"),
                        (a["total"] - F.get(terms, gone) + F.get(terms, gone - 1)).alias("total"),
                    ),
                ).otherwise(F.struct(a["counts"].alias("counts"), a["total"].alias("total")))

            def entered(b: Column) -> Column:
                new = F.get(places, i)
                return _bound(
                    count_at(b["counts"], new),
                    lambda had: F.struct(
                        put(b["counts"], new, had + 1).alias("counts"),
                        (b["total"] - F.get(terms, had) + F.get(terms, had + 1)).alias("total"),
                    ),
                )

            def noted(b: Column) -> Column:
                high = (i >= w - 1) & (b["total"] <= enough)
                return F.struct(
                    b["counts"].alias("counts"),
                    b["total"].alias("total"),
                    F.when(high & a["first"].isNull(), i - (w - 1)).otherwise(a["first"]).alias("first"),
                    F.when(high, i + 1).otherwise(a["last"]).alias("last"),
                )

            old = F.when(i >= w, F.get(places, i - w)).otherwise(F.lit(0))
            return _bound(_bound(_bound(old, left), entered), noted)

        none = F.lit(None).cast("int")
        start = F.struct(
            F.lit("A" * len(of.alphabet)).alias("counts"), F.lit(0.0).alias("total"), none.alias("first"), none.alias("last")
        )
        every = F.sequence(F.lit(0), F.size(places) - 1)
        return F.aggregate(every, start, step, lambda a: F.struct(a["first"], a["last"]))

    # Each character's place in the alphabet, so that none is looked for from the start of the text.
    return _bound(F.transform(F.split(body, ""), lambda c: F.instr(F.lit(of.alphabet), c)), slid)


def _meets(spans: Column, span: Column) -> Column:
    """Whether ``span`` meets one of ``spans``, which are in order and apart: the first that ends behind its start."""

    def halved(a: Column, _: Column) -> Column:
        middle = F.shiftright(a["low"] + a["high"], 1)
        behind = F.get(spans, middle)["end"] > span["start"]
        open_ = a["low"] < a["high"]
        return F.struct(
            F.when(open_ & ~behind, middle + 1).otherwise(a["low"]).alias("low"),
            F.when(open_ & behind, middle).otherwise(a["high"]).alias("high"),
        )

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    bounds = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))
    first = F.get(spans, F.aggregate(steps, bounds, halved, lambda a: a["low"]))
    return F.when(F.size(spans) == 0, False).otherwise(F.coalesce(first["start"] < span["end"], F.lit(False)))


def _entropy_spans(text: Column, kind: str) -> Column:
    """Spans of one class: per candidate string, from the first to the last window with enough entropy."""
    of = CLASSES[kind]
    strict = CharacterClass(of.alphabet, of.pattern, of.window, max(of.bits, LETTER_BITS))

    def pieces(s: Column) -> Column:
        cut = F.transform(
            _matches(s["body"], f"[^=/]{{{of.window},}}"),
            lambda x: F.struct(
                (s["start"] + x["start"]).alias("start"), (s["start"] + x["end"]).alias("end"), x["body"].alias("body")
            ),
        )
        return F.when(
            s["body"].rlike(PLACEHOLDER), F.filter(cut, lambda x: ~x["body"].rlike(PLACEHOLDER))
        ).otherwise(F.array(s))

    candidates = F.filter(
        F.flatten(F.transform(_matches(text, f"{of.pattern}{{{of.window},}}"), pieces)), lambda s: ~s["body"].rlike(KNOWN)
    )

    def narrowed(s: Column) -> Column:
        return _bound(
            window_entropy(s["body"], of),
            lambda e: F.struct(
                (s["start"] + e["first"]).alias("start"),
                (s["start"] + e["last"]).alias("end"),
                F.substring(s["body"], e["first"] + 1, e["last"] - e["first"]).alias("body"),
            ),
        )

    return F.filter(
        F.transform(candidates, narrowed),
        lambda s: s["start"].isNotNull()
        & ~s["body"].rlike(KNOWN)
        & (~s["body"].rlike(WORD) | _bound(window_entropy(s["body"], strict), lambda e: e["first"].isNotNull())),
    )


def _tagged(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")
        ),
    )


def _written(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")),
        ),
        ",",
    )


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: the id, ``base`` and ``found`` (arrays of spans: start, rank, kind, end).

    ``base`` holds the matches of the fixed patterns, ``found`` these and what the windows add: spans
    of high entropy that are not allow-listed, do not meet a base span, and, for the wider class, do
    not meet one of the narrower.  Both are sorted by start, then kind.  NULL and empty texts have no
    spans; rows are scanned one by one, so repeated rows agree.
    """
    kinds = [*BASE, *CLASSES]
    text = F.translate(text_of(text_column), MARK, STAND_IN)
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text"))
    rows = rows.select(
        "id",
        *[_base(F.col("text"), kind).alias(kind) for kind in BASE],
        *[_entropy_spans(F.col("text"), kind).alias(kind) for kind in CLASSES],
    )
    # Of one kind, spans are apart and in order; those of different kinds may meet.
    def apart(kind: str, held: list[str]) -> Column:
        return F.filter(kind, lambda s: ~reduce(or_, [_meets(F.col(k), s) for k in held]))

    for kind in CLASSES:
        rows = rows.withColumn(kind, apart(kind, kinds[: kinds.index(kind)]))
    tagged = {kind: _tagged(F.col(kind), kind, rank) for rank, kind in enumerate(kinds)}
    return rows.select(
        "id",
        F.array_sort(F.concat(*[tagged[k] for k in BASE])).alias("base"),
        F.array_sort(F.concat(*tagged.values())).alias("found"),
    )


def digests(scanned: DataFrame) -> DataFrame:
    """Counts per base kind, the hash of the base spans and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.col("found")).alias("spans"),
    )
