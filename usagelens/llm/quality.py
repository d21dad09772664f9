"""Quality rules as weak supervision.

Rules vote good (1), bad (-1) or abstain (0).  How far each rule is to be trusted is not set by hand:
expectation-maximisation estimates the share of good documents and every rule's accuracy on good and on
bad ones from the agreement of the votes, and a document stays if its posterior probability of being good
is at least one half.  Everything is DataFrame work; the driver only carries the estimates, two numbers per
rule.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import SPACE, stored, text_of

#: Base limits: fewer words, or a larger share of words in repeated 3-word windows, fail a document.
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
WINDOW = 3

#: Rule -> (votes bad, votes good) as SQL over the measured columns; neither is an abstention.  Every
#: rule votes good on evidence of its own, so bounds need not be so wide that no clean text crosses one:
#: what a vote weighs is estimated.  Bounds hold for any script: combining marks count as letters and
#: word length is in code points.  Scripts without capitals get no vote from that rule.
RULES = {
    "repetition": ("n_repeat_words > 0.2 * n_words", "n_repeat_words <= 0.05 * n_words"),
    "symbols": ("n_symbols > 0.05 * word_chars", "n_symbols <= 0.01 * word_chars"),
    "word_length": (
        "word_chars > 12 * n_words OR word_chars < 2 * n_words",
        "word_chars >= 3 * n_words AND word_chars <= 10 * n_words",
    ),
    "lines": ("n_dup_lines > 0.3 * n_lines", "n_lines > 1 AND n_dup_lines = 0"),
    "letters": ("n_letters < 0.8 * word_chars", "n_letters >= 0.9 * word_chars"),
    "no_letters": ("n_letters < 0.1 * word_chars", "n_letters >= 0.5 * word_chars"),
    "capitals": ("n_capitals > 0.3 * n_letters", "n_capitals > 0 AND n_capitals <= 0.1 * n_letters"),
    "exclamations": ("n_exclamations > 0.1 * n_words", "n_exclamations <= 0.01 * n_words"),
}

#: Where the estimates begin, and what they are drawn to with the weight of PRIOR votes (documents, for
#: the share), whatever the number of documents: the share of good documents, and of the votes on good
#: and on bad documents the share that is bad.  By these alone, one bad vote among good ones rejects nothing.
PRIOR = 10
SHARE, BAD_ON_GOOD, BAD_ON_BAD = 0.8, 0.05, 0.5
ROUNDS = 20

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_letters", "n_capitals", "n_exclamations",
)


def _words(text: Column) -> Column:
    """The words, without the empty parts that white space at either end leaves."""
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def _repeat_words(words: Column) -> Column:
    """Number of words in windows of three that occur twice or more in the text.

    Windows are sorted by hash, packed with their place into one number, which brings equal ones
    together at the cost of sorting numbers.  Windows that meet another of their hash are then
    compared as words, so a collision of hashes changes nothing.
    """
    high = F.lit(-1 << 31)
    last = F.size(words) - WINDOW
    hashes = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    )

    def met(ordered: Column, part) -> Column:
        """The elements of an ordered array that agree in ``part`` with a neighbour."""
        return F.filter(
            ordered,
            lambda x, k: (part(F.get(ordered, k + 1)) == part(x))
            | F.coalesce(part(F.get(ordered, k - 1)) == part(x), F.lit(False)),
        )

    def bound(value: Column, use) -> Column:
        """``use`` of a value that is worked out once."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def covered(ordered: Column) -> Column:
        """Words under the windows at the given places, in order."""
        return F.aggregate(
            ordered,
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("before")),
            lambda a, p: F.struct(
                (a["n"] + F.least(F.lit(WINDOW), p - a["before"])).alias("n"), p.alias("before")
            ),
            lambda a: a["n"].cast("long"),
        )

    def windows(candidates: Column) -> Column:
        spelt = F.transform(
            candidates,
            lambda x: F.struct(
                *[F.get(words, x.bitwiseAND((1 << 31) - 1).cast("int") + k).alias(f"w{k}") for k in range(WINDOW)],
                x.bitwiseAND((1 << 31) - 1).cast("int").alias("place"),
            ),
        )
        alike = lambda x: F.struct(*[x[f"w{k}"] for k in range(WINDOW)])
        return bound(F.array_sort(spelt), lambda s: covered(F.array_sort(F.transform(met(s, alike), lambda x: x["place"]))))

    prefix = lambda x: x.bitwiseAND(high)
    none = F.lit(0).cast("long")

    def counted(h: Column) -> Column:
        packed = F.transform(h, lambda x, i: prefix(x).bitwiseOR(i.cast("long")))
        candidates = bound(F.sort_array(packed), lambda s: met(s, prefix))
        repeated = bound(candidates, lambda c: F.when(F.size(c) == 0, none).otherwise(windows(c)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(repeated)

    return F.when(last < 0, none).otherwise(bound(hashes, counted))


def _dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def measured(docs: DataFrame, text_column: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the measures the rules vote on, each named ``prefix`` + measure."""
    text, words, lines = (f"{prefix}__{x}" for x in ("text", "words", "lines"))
    spelt = docs.withColumn(text, text_of(text_column)).withColumn(words, _words(F.col(text)))
    # A line counts if it holds a word.
    spelt = spelt.withColumn(
        lines, F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(F.translate(x, "\t\x0b\x0c\r", "    "))) > 0)
    )
    t, w, n = F.col(text), F.col(words), F.col(lines)
    count_of = lambda pattern: F.length(F.regexp_replace(t, pattern, "")).cast("long")
    columns = {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": count_of("[^#*$%&|<>]+"),
        "n_dup_lines": _dup_lines(n),
        "n_repeat_words": _repeat_words(w),
        "n_lines": F.size(n).cast("long"),
        "n_letters": count_of(r"[^\p{L}\p{M}]+"),
        "n_capitals": count_of(r"\P{Lu}+"),
        "n_exclamations": count_of("[^!]+"),
    }
    return spelt.select(*docs.columns, *[c.alias(prefix + m) for m, c in columns.items()])


@dataclass
class LabelModel:
    """The share of good documents, and per rule the share of bad votes on good and on bad documents."""

    share: float = SHARE
    on_good: dict[str, float] = field(default_factory=dict)
    on_bad: dict[str, float] = field(default_factory=dict)

    def weights(self, rule: str) -> tuple[float, float]:
        """What a bad and a good vote add to the log odds of a document being good."""
        good, bad = self.on_good.get(rule, BAD_ON_GOOD), self.on_bad.get(rule, BAD_ON_BAD)
        return math.log(good / bad), math.log((1 - good) / (1 - bad))

    def log_odds(self, rules: Iterable[str], prefix: str = "") -> Column:
        """Log odds of a document being good, from its votes; abstentions say nothing."""
        total = F.lit(math.log(self.share / (1 - self.share)))
        for rule in rules:
            vote = F.col(f"{prefix}vote_{rule}")
            against, for_ = self.weights(rule)
            total = total + F.when(vote == -1, F.lit(against)).when(vote == 1, F.lit(for_)).otherwise(F.lit(0.0))
        return total

    def posterior(self, rules: Iterable[str], prefix: str = "") -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.log_odds(rules, prefix)))


def _votes(prefix: str, rules: Mapping[str, tuple[str, str]]) -> list[Column]:
    def vote(bad: str, good: str) -> Column:
        named = lambda sql: " ".join(prefix + t if t in MEASURES else t for t in sql.split(" "))
        return F.expr(f"CASE WHEN {named(bad)} THEN -1 WHEN {named(good)} THEN 1 ELSE 0 END")

    return [vote(*conditions).alias(f"{prefix}vote_{rule}") for rule, conditions in rules.items()]


def fit(votes: DataFrame, rules: Iterable[str] = tuple(RULES), prefix: str = "", rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over the vote patterns of all documents in ``votes``.

    They are reduced to one row per pattern, at most three to the power of the number of rules whatever
    the number of documents.  Each round is one aggregate over these, which estimates the share of good
    documents and every rule's two accuracies.  A rule's vote never counts for the other side: where it
    votes bad at least as often on good documents as on bad ones, both get its overall rate, so that it
    weighs nothing.  Without documents the prior is left.
    """
    rules = list(rules)
    names = [f"{prefix}vote_{rule}" for rule in rules]
    counted = votes.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1)
    patterns = stored(counted.select("n", F.array(*names).alias("votes")), "vote-patterns")
    model = LabelModel()
    good, bad = F.col("n") * F.col("good"), F.col("n") * (1 - F.col("good"))
    sums = {
        f"{side}{vote}_{k}": F.coalesce(F.sum(F.when(F.get("votes", F.lit(k)) == vote, weight)), F.lit(0.0))
        for k in range(len(rules))
        for side, weight in (("good", good), ("bad", bad))
        for vote in (-1, 1)
    }

    def odds() -> Column:
        # Estimates go in as arrays, not as constants of the generated code, which is compiled once then.
        against, for_ = (F.lit(list(w)) for w in zip(*[model.weights(rule) for rule in rules]))
        weighed = F.transform(
            "votes", lambda v, k: F.when(v == -1, F.get(against, k)).when(v == 1, F.get(for_, k)).otherwise(F.lit(0.0))
        )
        return F.aggregate(weighed, F.lit(math.log(model.share / (1 - model.share))), lambda total, w: total + w)

    for _ in range(rounds):
        row = (
            patterns.withColumn("good", F.lit(1.0) / (F.lit(1.0) + F.exp(-odds())))
            .agg(F.sum("n").alias("n"), F.sum(good).alias("n_good"), *[c.alias(n) for n, c in sums.items()])
            .first()
        )
        if not row["n"]:
            break
        on_good, on_bad = {}, {}
        for k, rule in enumerate(rules):
            g, b = row[f"good-1_{k}"] + PRIOR * BAD_ON_GOOD, row[f"bad-1_{k}"] + PRIOR * BAD_ON_BAD
            n_good = row[f"good-1_{k}"] + row[f"good1_{k}"] + PRIOR
            n_bad = row[f"bad-1_{k}"] + row[f"bad1_{k}"] + PRIOR
            worse = b / n_bad < g / n_good
            on_good[rule] = (g + b) / (n_good + n_bad) if worse else g / n_good
            on_bad[rule] = on_good[rule] if worse else b / n_bad
        model = LabelModel((row["n_good"] + PRIOR * SHARE) / (row["n"] + PRIOR), on_good, on_bad)
    return model


def judged(
    docs: DataFrame,
    text_column: str = "text",
    prefix: str = "",
    keep: list[str] | None = None,
    rules: Mapping[str, tuple[str, str]] = RULES,
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with measures, votes, ``base_failed``, ``quality`` and ``kept``.

    The added columns carry ``prefix``; choose one that no column of ``docs`` starts with.  NULL and
    empty texts have no words and fail the base limits, as do all texts under 50 words.  Any other
    document stays if the rules, weighted by their estimated accuracies, make it good with a
    probability of at least one half.  Accuracies are estimated from all documents that the base limits
    leave to be judged: the others are decided, and would make short texts the bad class.  Repeated rows
    count and are judged one by one; an empty table gives an empty result.  A column of ``docs`` that has
    the name of an added one raises.

    Measures and votes are worked out once and stored with the columns to keep.
    """
    columns = docs.columns if keep is None else keep
    p = prefix
    added = {p + m for m in MEASURES} | {f"{p}vote_{r}" for r in rules} | {p + c for c in ("base_failed", "quality", "kept")}
    if clashing := added & set(columns):
        raise ValueError(f"columns {sorted(clashing)} exist; choose another prefix")
    rows = measured(docs, text_column, prefix)
    failed = (F.col(f"{p}n_words") < MIN_WORDS) | (
        100 * F.col(f"{p}n_repeat_words") > MAX_REPEATED_PERCENT * F.col(f"{p}n_words")
    )
    rows = rows.select(*columns, *[p + m for m in MEASURES], failed.alias(f"{p}base_failed"), *_votes(prefix, rules))
    rows = stored(rows, "quality")
    model = fit(rows.where(~F.col(f"{p}base_failed")), rules, prefix)
    return rows.withColumn(f"{p}quality", F.round(model.posterior(rules, prefix), 6)).withColumn(
        f"{p}kept", ~F.col(f"{p}base_failed") & (F.col(f"{p}quality") >= 0.5)
    )
