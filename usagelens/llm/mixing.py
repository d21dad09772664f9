"""Temperature mixing of sources.

A source with share p of all tokens gets the weight p^a / sum(p^a).  The exponent a is found by
bisection: 1 keeps the natural shares, 0 makes all sources equal.  The weights are then realised within
a token budget: every source is laid out as whole permutations of its documents (blocks), the last one
cut where the budget ends.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored

#: Slices of a permutation whose token counts are summed to find where a budget ends.
SLICE_BITS = 12
ORDER_BITS = 62


@dataclass(frozen=True)
class Target:
    """What to aim for: an entropy of the weights (nats), or the most often a document may repeat.

    With ``entropy``, the exponent nearest to 1 that reaches it; with ``repetition``, the smallest
    exponent that stays within it.  ``budget`` is the number of tokens to emit; None emits enough for
    every document to appear at least once.
    """

    entropy: float | None = None
    repetition: float | None = None
    budget: float | None = None

    def __post_init__(self) -> None:
        if (self.entropy is None) == (self.repetition is None):
            raise ValueError("give an entropy or a repetition limit")


def fit_exponent(shares: DataFrame, target: Target, total: float, points: int = 65, rounds: int = 5) -> float:
    """Bisect the exponent on [0, 1]; ``shares`` holds a share ``p`` over 0 per source.

    Each round is one aggregate that evaluates ``points`` exponents at once, so an interval shrinks to
    1/64 in a round; the number of sources may be large.
    """
    low, high = 0.0, 1.0
    for _ in range(rounds):
        step = (high - low) / (points - 1)
        grid = F.explode(F.array(*[F.lit(low + i * step) for i in range(points)]))
        rows = (
            shares.select("p", grid.alias("a"))
            .groupBy("a")
            .agg(
                F.sum(F.pow("p", "a")).alias("z"),
                F.sum(F.pow("p", "a") * F.log("p")).alias("s"),
                F.max(F.pow(F.col("p"), F.col("a") - 1)).alias("most"),
                F.min(F.pow(F.col("p"), F.col("a") - 1)).alias("least"),
            )
            .select(
                "a",
                (F.log("z") - F.col("a") * F.col("s") / F.col("z")).alias("entropy"),
                F.when(
                    F.lit(target.budget is None), F.col("most") / F.col("least")
                ).otherwise(F.col("most") / F.col("z") * F.lit((target.budget or 0.0) / (total or 1.0))).alias("repetition"),
            )
            .orderBy("a")
            .collect()
        )
        if not rows:
            return 1.0
        # Both figures fall as the exponent grows.
        if target.entropy is not None:
            good = [r.a for r in rows if r.entropy >= target.entropy - 1e-12]
            if not good:
                return low
            low, high = max(good), min(max(good) + step, 1.0)
        else:
            good = [r.a for r in rows if r.repetition <= target.repetition + 1e-12]
            if not good:
                return high
            low, high = max(min(good) - step, 0.0), min(good)
        if low >= high:
            break
    return low if target.entropy is not None else high


def plan(docs: DataFrame, target: Target, tokens, seed: int = 0, id_column: str = "doc_id",
         source_column: str = "source") -> DataFrame:
    """One row per source: ``source``, ``tokens``, ``weight``, ``epochs``, ``blocks`` and ``cut``.

    ``blocks`` is the number of whole permutations; of the next one, the documents whose order is
    below ``cut`` are taken: those before the budget's end and the one that meets it.  Sources without
    tokens have no weight; their documents appear once.  NULL is a source like any other.
    """
    rows = stored(
        docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), tokens.alias("tokens")),
        "mix-documents",
    )
    sources = stored(rows.groupBy("source").agg(F.sum("tokens").cast("double").alias("tokens")), "mix-sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0.0
    shares = sources.where("tokens > 0").select("source", "tokens", (F.col("tokens") / F.lit(total or 1.0)).alias("p"))
    exponent = fit_exponent(shares, target, total)
    powered = shares.withColumn("power", F.pow(F.col("p"), F.lit(exponent)))
    sums = powered.agg(F.sum("power").alias("z"), F.min(F.col("power") / F.col("p")).alias("least")).first()
    z, least = sums["z"] or 1.0, sums["least"] or 1.0
    budget = total * z / least if target.budget is None else float(target.budget)
    epochs = F.col("weight") * F.lit(budget) / F.col("tokens")
    weighted = powered.withColumn("weight", F.col("power") / F.lit(z)).withColumn("epochs", F.round(epochs, 9))
    weighted = weighted.select(
        "source", "tokens", "weight", "epochs", F.floor("epochs").cast("int").alias("blocks"),
        ((F.col("epochs") - F.floor("epochs")) * F.col("tokens")).alias("rest"),
    )
    without = sources.where("tokens = 0 OR tokens IS NULL").select(
        "source", F.lit(0.0).alias("tokens"), F.lit(0.0).alias("weight"), F.lit(1.0).alias("epochs"),
        F.lit(1).alias("blocks"), F.lit(0.0).alias("rest"),
    )
    weighted = stored(weighted.unionByName(without).withColumnRenamed("source", "of"), "mix-weights")

    # Where does the cut permutation end?  Slices of its order first, then the rows of one slice.
    cut = weighted.where("rest > 0").select("of", "blocks", "rest")
    ordered = rows.join(cut, F.col("source").eqNullSafe(F.col("of"))).select(
        "of", "rest", "tokens", _order(F.col("id"), F.col("blocks"), seed).alias("order"),
    )
    ordered = stored(ordered, "mix-order")
    slice_of = F.shiftright("order", ORDER_BITS - SLICE_BITS)
    slices = ordered.groupBy("of", "rest", slice_of.alias("slice")).agg(F.sum("tokens").alias("tokens"))
    upto = F.expr("sum(tokens) OVER (PARTITION BY of ORDER BY slice)")
    last = (
        slices.withColumn("upto", upto)
        .where("upto >= rest AND upto - tokens < rest")
        .groupBy("of")
        .agg(F.min("slice").alias("slice"), F.min(F.col("rest") - (F.col("upto") - F.col("tokens"))).alias("left"))
        .withColumnRenamed("of", "of_last")
    )
    inside = (
        ordered.join(
            last, F.col("of").eqNullSafe(F.col("of_last")) & (slice_of == F.col("slice"))
        )
        .withColumn(
            "before",
            F.coalesce(
                F.expr(
                    "sum(tokens) OVER (PARTITION BY of, slice ORDER BY order "
                    "RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
                ),
                F.lit(0),
            ),
        )
        .where(F.col("before") < F.col("left"))
        .groupBy("of")
        .agg((F.max("order") + 1).alias("cut"))
        .withColumnRenamed("of", "of_cut")
    )
    return stored(
        weighted.join(inside, F.col("of").eqNullSafe(F.col("of_cut")), "left").select(
            F.col("of").alias("source"), "tokens", "weight", "epochs", "blocks",
            F.coalesce(F.col("cut"), F.lit(0)).cast("long").alias("cut"),
        ),
        "mix-plan",
    )


def _order(id_, block, seed: int):
    """A document's place in a block's permutation: uniform below 2^62."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), block.cast("int"), id_), 64 - ORDER_BITS)


def mix(docs: DataFrame, target: Target, tokens, seed: int = 0, id_column: str = "doc_id",
        source_column: str = "source", prefix: str = "mix_") -> DataFrame:
    """``docs``, each row as often as its source's epochs ask for, with its place in the mixture.

    ``tokens`` is the column (expression) that counts a row's tokens.  Adds ``<prefix>block`` (which
    permutation of the source), ``<prefix>position`` (0 to about 1, as the cut falls by chance; sorting
    by it deals the blocks of all sources evenly), ``<prefix>weight`` and ``<prefix>epochs``.  Choose a prefix that no column of
    ``docs`` starts with.

    Rows of no tokens follow their source.  Repeated rows (same id) share a place and stay together.
    An empty table gives an empty result.  A large source is never gathered: its cut is found from
    sums per slice of its order, and rows are only compared with their source's row of the plan, a
    stored table that is broadcast if it is small.
    """
    found = plan(docs, target, tokens, seed, id_column, source_column)
    p = prefix
    found = found.select(*[F.col(c).alias(f"{p}plan_{c}") for c in ("source", "weight", "epochs", "blocks", "cut")])
    joined = docs.join(found, F.col(source_column).eqNullSafe(F.col(f"{p}plan_source")))
    id_, blocks = F.col(id_column), F.col(f"{p}plan_blocks")
    more = (_order(id_, blocks, seed) < F.col(f"{p}plan_cut")).cast("int")
    dealt = joined.withColumn(f"{p}copies", blocks + more).where(F.col(f"{p}copies") > 0)
    dealt = dealt.withColumn(f"{p}block", F.explode(F.sequence(F.lit(0), F.col(f"{p}copies") - 1)))
    place = _order(id_, F.col(f"{p}block"), seed) / F.lit(float(1 << ORDER_BITS))
    return dealt.select(
        *docs.columns,
        f"{p}block",
        ((F.col(f"{p}block") + place) / F.col(f"{p}plan_epochs")).alias(f"{p}position"),
        F.col(f"{p}plan_weight").alias(f"{p}weight"),
        F.col(f"{p}plan_epochs").alias(f"{p}epochs"),
    )
