"""Exact statistics and medians of many measures, from one table of counters.

A measure's values are cut into slices: logarithmic ones, cut again at the bounds of its bucket family.
One pass counts every slice of every group: rows, sum, least and largest value, and the sum of another
measure beside it.  Counters can be merged, are bounded in number per group, and are all that totals,
buckets and the ranks of the medians need.  Only the rows in the slices of the middle ranks are read once
more, and reduced to their distinct values.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.fixed_point import LIMB_BITS
from ..session import Settled, settle

#: Slices per power of two: at most 64 * 63 a measure, besides the bounds of its buckets and zero.
SLICES_PER_DOUBLING = 64
#: Buckets a slice number leaves room for.
BUCKETS = 8
#: Distinct values of a group and measure that one window may run over.
DISTINCT_LIMIT = 1 << 16
#: Slices per round while the middle slice still holds more values.
SLICES = 4096
#: Copies of each group's ranges, so that the rows of one group are joined in as many places.
SALTS = 32


@dataclass(frozen=True)
class Measure:
    """A non-negative ``bigint`` expression, its bucket bounds, what is summed beside it, and whether its median is wanted."""

    name: str
    value: str
    bounds: tuple[int, ...] = ()
    beside: str | None = None
    median: bool = True

    def slice_(self) -> str:
        """SQL of the slice number; it never falls as the value grows.  Zero has slice 0."""
        bucket = " + ".join(f"CAST({self.name} > {b}L AS INT)" for b in self.bounds) or "0"
        part = f"CAST(floor(log2({self.name}) * {SLICES_PER_DOUBLING}) AS INT)" if self.median else "0"
        return f"CASE WHEN {self.name} > 0 THEN (1 + {part}) * {BUCKETS} + {bucket} WHEN {self.name} = 0 THEN 0 END"


def _limbs(value: str) -> tuple[str, str]:
    return f"sum(shiftright({value}, {LIMB_BITS}))", f"sum({value} & {(1 << LIMB_BITS) - 1}L)"


def _stacked(rows: DataFrame, keys: Sequence[str], measures: Sequence[tuple[int, Measure]]) -> DataFrame:
    values = rows.selectExpr(*keys, *[f"{m.value} AS {m.name}" for _, m in measures],
                             *[f"{m.beside} AS {m.name}__beside" for _, m in measures if m.beside])
    # Slices are worked out ahead of the generator, whose own expressions compile badly.
    sliced = values.selectExpr("*", *[f"{m.slice_()} AS {m.name}__slice" for _, m in measures])
    parts = ", ".join(
        f"{i}, {m.name}__slice, {m.name}, {f'{m.name}__beside' if m.beside else 'CAST(NULL AS BIGINT)'}" for i, m in measures
    )
    return sliced.selectExpr(*keys, f"stack({len(measures)}, {parts}) AS (measure, slice, value, beside)").where(
        "slice IS NOT NULL"
    )


def count_slices(sources: Sequence[tuple[DataFrame, Sequence[tuple[int, Measure]]]], keys: Sequence[str]) -> DataFrame:
    """Counters of all sources, each scanned once; measures are told apart by their numbers."""
    stacked = [_stacked(rows, keys, measures) for rows, measures in sources]
    union = stacked[0]
    for other in stacked[1:]:
        union = union.union(other)
    (high, low), (beside_high, beside_low) = _limbs("value"), _limbs("beside")
    return union.groupBy(*keys, "measure", "slice").agg(
        F.expr("count(*) AS inside"), F.expr("min(value) AS least"), F.expr("max(value) AS largest"),
        F.expr(f"{high} AS sum_high"), F.expr(f"{low} AS sum_low"),
        F.expr(f"{beside_high} AS beside_high"), F.expr(f"{beside_low} AS beside_low"),
    )


def rows_where(i: int, condition: str = "true") -> str:
    return f"coalesce(sum(CASE WHEN measure = {i} AND {condition} THEN inside END), 0)"


def total_where(i: int, condition: str = "true", of: str = "sum") -> str:
    """Exact sum of a measure, or of what is ``beside`` it, over some slices; NULL without rows."""
    part = f"sum(CASE WHEN measure = {i} AND {condition} THEN {of}_{{}} END)"
    return f"(CAST({part.format('high')} AS DECIMAL(20,0)) * {1 << LIMB_BITS}L + CAST({part.format('low')} AS DECIMAL(20,0)))"


def in_bucket(ordinal: int) -> str:
    """Counters of a bucket: 0 is zero, the others are one more than the number of bounds below."""
    return f"bucket = {ordinal}"


#: What a bucket's slices have together: numbers, sums, and where the middle ranks are.
_PER_BUCKET = (
    "sum(inside) AS inside", "max(largest) AS largest",
    *(f"sum({c}) AS {c}" for c in ("sum_high", "sum_low", "beside_high", "beside_low")),
    "count(CASE WHEN holds_low OR holds_high THEN 1 END) AS parts",
    "min(CASE WHEN holds_low OR holds_high THEN least END) AS held_least",
    "max(CASE WHEN holds_low OR holds_high THEN largest END) AS held_largest",
    # With the two ranks in different slices, they are the last value of the one and the first of the other.
    "max(CASE WHEN holds_low THEN largest END) AS low_edge",
    "min(CASE WHEN holds_high THEN least END) AS high_edge",
    "min(CASE WHEN holds_low OR holds_high THEN low_rank - below END) AS low_rank",
    "min(CASE WHEN holds_low OR holds_high THEN high_rank - below END) AS high_rank",
)


def _middles(i: int) -> list[str]:
    """Fields that tell where the middle ranks of a measure are."""
    of = f"CASE WHEN measure = {i} THEN {{}} END"
    return [
        f"sum({of.format('parts')}) AS parts{i}",
        f"min({of.format('held_least')}) AS least{i}",
        f"max({of.format('held_largest')}) AS largest{i}",
        f"max({of.format('low_edge')}) AS low_edge{i}",
        f"min({of.format('high_edge')}) AS high_edge{i}",
        f"min({of.format('low_rank')}) AS low_rank{i}",
        f"min({of.format('high_rank')}) AS high_rank{i}",
    ]


def _settled(i: int) -> list[str]:
    """The two middle values where the slices tell them, else the range to look into."""
    known = f"parts{i} > 1 OR least{i} = largest{i}"
    return [
        f"CASE WHEN parts{i} > 1 THEN low_edge{i} WHEN least{i} = largest{i} THEN least{i} END AS low_value{i}",
        f"CASE WHEN parts{i} > 1 THEN high_edge{i} WHEN least{i} = largest{i} THEN least{i} END AS high_value{i}",
        f"CASE WHEN NOT ({known}) THEN least{i} END AS low{i}",
        f"CASE WHEN NOT ({known}) THEN largest{i} END AS high{i}",
        f"low_rank{i}", f"high_rank{i}",
    ]


def group_statistics(counters: DataFrame, keys: Sequence[str], aggregates: Sequence[str], wanted: Sequence[int]) -> DataFrame:
    """One row per group: ``aggregates`` of its counters, and where the medians of the measures ``wanted`` are.

    A group has a bounded number of counters, so it fits a task, and one shuffle does.
    """
    group = ", ".join([*keys, "measure"])
    ranked = (
        counters.repartition(*keys)
        .selectExpr("*", f"sum(inside) OVER (PARTITION BY {group}) AS total",
                    f"sum(inside) OVER (PARTITION BY {group} ORDER BY slice ROWS UNBOUNDED PRECEDING) AS upto")
        .selectExpr("*", "upto - inside AS below", "(total + 1) div 2 AS low_rank", "total div 2 + 1 AS high_rank")
        .selectExpr("*", "below < low_rank AND low_rank <= upto AS holds_low", "below < high_rank AND high_rank <= upto AS holds_high")
    )
    fields = [*aggregates, *[f for i in wanted for f in _middles(i)]]
    # Slices are put together per bucket first: the many fields of a group then see a few dozen rows.
    bucketed = ranked.selectExpr("*", f"CASE WHEN slice = 0 THEN 0 ELSE slice % {BUCKETS} + 1 END AS bucket")
    groups = bucketed.groupBy(*keys, "measure", "bucket").agg(*map(F.expr, _PER_BUCKET)).groupBy(*keys).agg(*map(F.expr, fields))
    named = [f.rsplit(" AS ", 1)[1] for f in aggregates]
    return groups.selectExpr(*keys, *named, *[c for i in wanted for c in _settled(i)])


def _inside(rows: DataFrame, keys: Sequence[str], measures: Sequence[tuple[int, Measure]], ranges: DataFrame) -> DataFrame:
    """Values of the rows that lie in their group's open ranges, in long form.

    Rows meet the ranges by key and a salt made of the measures, so that a group with most of the rows is
    joined in many tasks where the ranges are too large to be broadcast.
    """
    names = [m.name for _, m in measures]
    values = rows.selectExpr(*keys, *[f"{m.value} AS {m.name}" for _, m in measures])
    salted = values.selectExpr("*", f"CAST(pmod(xxhash64({', '.join(names)}), {SALTS}) AS INT) AS salt")
    joined = salted.join(ranges, [*keys, "salt"]).selectExpr(
        *keys, *[f"CASE WHEN {m.name} >= low{i} AND {m.name} <= high{i} THEN {m.name} END AS {m.name}" for i, m in measures],
        *[f"{r}{i}" for i, _ in measures for r in ("low_rank", "high_rank")],
    )
    parts = ", ".join(f"{i}, {m.name}, low_rank{i}, high_rank{i}" for i, m in measures)
    return joined.selectExpr(*keys, f"stack({len(measures)}, {parts}) AS (measure, value, low_rank, high_rank)").where(
        "value IS NOT NULL"
    )


def _distinct_values(
    sources: Sequence[tuple[DataFrame, Sequence[tuple[int, Measure]]]], keys: Sequence[str], state: DataFrame
) -> tuple[Settled, int]:
    """Values in the open ranges with their numbers of rows, stored, and how many there are."""
    wanted = [(rows, [(i, m) for i, m in measures if m.median]) for rows, measures in sources]
    every = [i for _, measures in wanted for i, _ in measures]
    is_open = " OR ".join(f"low{i} IS NOT NULL" for i in every)
    ranges = state.where(is_open).selectExpr(
        *keys, *[f"{c}{i}" for i in every for c in ("low", "high", "low_rank", "high_rank")],
        f"explode(sequence(0, {SALTS - 1})) AS salt",
    )
    parts = [_inside(rows, keys, measures, ranges) for rows, measures in wanted]
    union = parts[0]
    for other in parts[1:]:
        union = union.union(other)
    values = union.groupBy(*keys, "measure", "value").agg(
        F.expr("count(*) AS n"), F.expr("max(low_rank) AS low_rank"), F.expr("max(high_rank) AS high_rank")
    )
    seen = Observation(f"values-{uuid.uuid4().hex}")
    kept = settle(values.observe(seen, F.count(F.lit(1)).alias("n")), "median-values")
    return kept, seen.get["n"]


def _narrowed(values: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """``values`` with those of too large groups cut to the even slice of the middle ranks; None if no group is."""
    group = [*keys, "measure"]
    over = ", ".join(group)
    large = settle(
        values.groupBy(*group)
        .agg(F.count("*").alias("c"), F.min("value").alias("first"), F.max("value").alias("last"))
        .where(F.col("c") > limit).drop("c"),
        "large-groups",
    ).df
    if large.isEmpty():
        return None
    sliced = values.join(large, group).selectExpr("*", f"(value - first) div ((last - first) div {SLICES} + 1) AS slice")
    middle = (
        sliced.groupBy(*group, "slice")
        .agg(*map(F.expr, ("sum(n) AS inside", "min(value) AS least", "max(value) AS largest",
                           "max(low_rank) AS low_rank", "max(high_rank) AS high_rank")))
        .selectExpr("*", f"sum(inside) OVER (PARTITION BY {over} ORDER BY slice ROWS UNBOUNDED PRECEDING) AS upto")
        .selectExpr("*", "upto - inside AS below")
        .selectExpr("*", "below < low_rank AND low_rank <= upto AS holds_low", "below < high_rank AND high_rank <= upto AS holds_high")
        .where("holds_low OR holds_high")
        .groupBy(*group)
        .agg(*map(F.expr, ("count(*) > 1 AS parted", "min(least) AS least", "max(largest) AS largest", "min(below) AS below",
                           "max(CASE WHEN holds_low THEN largest END) AS low_edge",
                           "min(CASE WHEN holds_high THEN least END) AS high_edge")))
    )
    cut = values.join(middle, group).selectExpr(
        *group, "value", "CASE WHEN parted THEN 1L ELSE n END AS n",
        "CASE WHEN parted THEN 1L ELSE low_rank - below END AS low_rank",
        "CASE WHEN parted THEN 2L ELSE high_rank - below END AS high_rank",
        "CASE WHEN parted THEN value IN (low_edge, high_edge) ELSE value BETWEEN least AND largest END AS stays",
    )
    small = values.join(large, group, "left_anti").select(*group, "value", "n", "low_rank", "high_rank")
    return small.unionByName(cut.where("stays").drop("stays"))


def with_medians(
    sources: Sequence[tuple[DataFrame, Sequence[tuple[int, Measure]]]], keys: Sequence[str], aggregates: Sequence[str],
    limit: int = DISTINCT_LIMIT,
) -> DataFrame:
    """Statistics of every group, with ``<measure>__twice_median`` (the sum of the two middle values).

    ``keys`` are not NULL.  NULL values are left out; a measure without values has NULL.  Every source is
    scanned twice: for the counters, and for the rows of the middle slices.  Further rounds, of which
    common data need none, run over the distinct values of these.
    """
    keys, measures = list(keys), [m for _, some in sources for m in some]
    wanted = [(i, m) for i, m in measures if m.median]
    counters = settle(count_slices(sources, keys), "slice-counters")
    state = settle(group_statistics(counters.df, keys, aggregates, [i for i, _ in wanted]), "group-statistics")
    counters.drop()
    limit = max(limit, 2)  # two middle values may stay apart
    kept, n = _distinct_values(sources, keys, state.df)
    while n > limit and (smaller := _narrowed(kept.df, keys, limit)) is not None:
        following = settle(smaller, "median-values")
        kept.drop()
        kept = following
    over = ", ".join([*keys, "measure"])
    found = (
        kept.df.repartition(*keys)
        .selectExpr("*", f"sum(n) OVER (PARTITION BY {over} ORDER BY value ROWS UNBOUNDED PRECEDING) AS upto")
        .selectExpr("*", "upto - n AS below")
        .groupBy(*keys)
        .agg(*[
            F.expr(f"max(CASE WHEN measure = {i} AND below < {side}_rank AND {side}_rank <= upto THEN value END) AS {side}_found{i}")
            for i, _ in wanted for side in ("low", "high")
        ])
    )
    value = "CAST(coalesce({0}_value{1}, {0}_found{1}) AS DECIMAL(19,0))"
    named = [f.rsplit(" AS ", 1)[1] for f in aggregates]
    return state.df.join(found, keys, "left").selectExpr(
        *keys, *named, *[f"{value.format('low', i)} + {value.format('high', i)} AS {m.name}__twice_median" for i, m in wanted]
    )


def exact_medians(
    rows: DataFrame, keys: Sequence[str], measures: Sequence[str], limit: int = DISTINCT_LIMIT
) -> DataFrame:
    """Per group, the sum of the two middle values of every measure (twice the median).

    ``rows`` holds ``keys`` (not NULL) and non-negative ``bigint`` ``measures``; NULLs are left out.  A
    measure without values gives NULL, a group without any value gives no row.
    """
    numbered = [(i, Measure(f"m_{m}", m)) for i, m in enumerate(measures)]
    found = with_medians([(rows, numbered)], keys, ["count(*) AS counted"], limit)
    return found.selectExpr(*keys, *[f"m_{m}__twice_median AS {m}" for m in measures])
