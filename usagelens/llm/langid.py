"""Language identification by interpolated Kneser-Ney character models.

One model of order four per language, over letters in lower case with single spaces between words.
Counts, continuation counts and probabilities are DataFrames over all training text.  For scoring, every
sequence that occurs in the documents is resolved once to its log probability in each language.  The
most frequent ones, up to a number of bytes, are looked up within the tasks; documents meet all others
in a join.  Sequences are 64-bit numbers that hold their four UTF-16 units, so none is mistaken for
another, and log probabilities are whole numbers, so sums depend neither on order nor on the way.
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import map_batches, stored, text_of

ORDER = 4
#: Bytes of the most frequent sequences that every task gets.  The others are joined: the figure
#: decides how much is shuffled and not what comes out.
HEAD_BYTES = 1 << 26
#: Unit of log probabilities as whole numbers.
UNIT = float(1 << 20)
UNDETERMINED = "und"
SPACE = 32
#: Characters of a batch that are worked on at a time.
SLICE = 1 << 19


def _fold_table() -> np.ndarray:
    """UTF-16 unit -> lower-case letter or mark, or a space for all that is neither."""
    table = np.full(1 << 16, SPACE, np.uint16)
    for c in range(1 << 16):
        if unicodedata.category(chr(c))[0] in "LM" or 0xD800 <= c < 0xE000:
            low = chr(c).lower() if not 0xD800 <= c < 0xE000 else chr(c)
            table[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    return table


_tables: list[np.ndarray] = []


def _fold() -> np.ndarray:
    if not _tables:
        _tables.append(_fold_table())
    return _tables[0]


def sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All sequences of four units as 64-bit numbers, and where each text's begin (one more at the end).

    A text is taken with three spaces before and one after it, so every unit has a whole context.
    """
    fold = _fold()
    parts, sizes = [], []
    pad = np.full(ORDER - 1, SPACE, np.uint16)
    end = np.full(1, SPACE, np.uint16)
    for text in texts:
        units = fold[np.frombuffer(text.encode("utf-16-le", "replace"), "<u2")]
        if len(units):
            space = units == SPACE
            keep = ~space
            keep[1:] |= ~space[:-1]
            units = units[keep]
        parts += [pad, units, end]
        sizes.append(len(units) + 1)
    flat = np.concatenate(parts).astype(np.uint64) if parts else np.zeros(0, np.uint64)
    n = len(flat) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    keys = flat[:n].copy()
    for k in range(1, ORDER):
        keys <<= np.uint64(16)
        keys |= flat[k : n + k]
    starts = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    # A text's sequences are as many as its units and its end; those that reach over into the next
    # text's padding are left out.
    at = np.arange(len(sizes)) * (ORDER - 1) + starts[:-1]
    index = np.arange(starts[-1]) + np.repeat(at - starts[:-1], sizes)
    return keys[index], starts


def _slices(texts: list[str], limit: int = SLICE):
    """Runs of whole texts of about ``limit`` characters."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def count_sequences(training: DataFrame) -> DataFrame:
    """``lang``, ``key``, ``n`` over all of ``training`` (``lang``, ``text``); NULL counts as a language.

    Counts are added up within a batch before they are shuffled.
    """

    def count(batches):
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(langs, texts):
                by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                for begin, end in _slices(own, 4 * SLICE):
                    keys, n = np.unique(sequences(own[begin:end])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n, pa.int64())],
                        ["lang", "key", "n"],
                    )

    counted = map_batches(training, count, "lang string, key long, n long")
    return counted.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def probabilities(counts: DataFrame) -> DataFrame:
    """Interpolated Kneser-Ney probabilities of every order: ``lang``, ``order``, ``key``, ``p``, ``back``.

    ``p`` is the probability of the last unit after the others; ``back`` is the weight that the
    sequence, taken as a context, gives to the shorter one (NULL where it is no context).  The highest
    order uses counts, the lower ones the number of different units before a sequence.
    """
    tables = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        mask = (1 << (16 * order)) - 1
        tables[order] = stored(
            tables[order + 1].groupBy("lang", F.col("key").bitwiseAND(mask).alias("key")).agg(F.count("*").alias("n")),
            f"continuations-{order}",
        )
    lower = None
    levels = []
    for order in range(1, ORDER + 1):
        counted = tables[order].withColumn("context", F.shiftrightunsigned("key", 16))
        # One discount per language and order, from the sequences seen once and twice.
        discount = counted.groupBy("lang").agg(
            F.expr("(count_if(n = 1) + 0.5D) / (count_if(n = 1) + 2 * count_if(n = 2) + 1D)").alias("d")
        )
        contexts = (
            counted.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
            .join(discount, "lang")
            .select("lang", "context", "total", "d", (F.col("d") * F.col("kinds") / F.col("total")).alias("back"))
        )
        contexts = stored(contexts, f"contexts-{order}")
        own = counted.join(contexts, ["lang", "context"]).withColumn(
            "share", (F.col("n") - F.col("d")) / F.col("total")
        )
        if lower is None:
            below = F.col("back") / float(1 << 16)
            level = own.select("lang", "key", (F.col("share") + below).alias("p"))
        else:
            mask = (1 << (16 * (order - 1))) - 1
            suffix = own.withColumn("suffix", F.col("key").bitwiseAND(mask))
            under = lower.select("lang", F.col("key").alias("suffix"), F.col("p").alias("q"))
            level = suffix.join(under, ["lang", "suffix"]).select(
                "lang", "key", (F.col("share") + F.col("back") * F.col("q")).alias("p")
            )
        level = stored(level, f"level-{order}")
        lower = level
        levels.append(level.select("lang", F.lit(order).alias("order"), "key", "p", F.lit(False).alias("context")))
        levels.append(
            contexts.select(
                "lang", F.lit(order - 1).alias("order"), F.col("context").alias("key"), F.col("back").alias("p"),
                F.lit(True).alias("context"),
            )
        )
    union = levels[0]
    for level in levels[1:]:
        union = union.unionByName(level)
    return union


def resolved(counts: DataFrame, table: DataFrame, langs: list[str]) -> DataFrame:
    """Every sequence of ``counts`` with its frequency and its log probability in each of ``langs``.

    ``key``, ``slice`` (binary digits of the frequency) and ``v``, in units of 1 / ``UNIT``.  A sequence
    that a language has not seen is backed off to the next shorter one.  Shorter sequences are resolved
    first; as many rows share one as there are different units, however long the text.
    """
    spark = counts.sparkSession
    numbers = spark.createDataFrame(list(enumerate(langs)), "lang_no int, lang string")
    wide = (
        table.join(F.broadcast(numbers), "lang")
        .groupBy("context", "order", "key")
        .pivot("lang_no", list(range(len(langs))))
        .agg(F.max(F.log("p")))
    )
    wide = stored(
        wide.select("context", "order", "key", F.array(*[F.col(f"`{i}`") for i in range(len(langs))]).alias("v")),
        "models",
    )
    keys = {ORDER: counts.groupBy("key").agg(F.sum("n").alias("n"))}
    for order in range(ORDER - 1, 0, -1):
        mask = (1 << (16 * order)) - 1
        keys[order] = stored(keys[order + 1].select(F.col("key").bitwiseAND(mask).alias("key")).distinct(), f"keys-{order}")
    under = None
    for order in range(1, ORDER + 1):
        own = wide.where(~F.col("context") & (F.col("order") == order)).select("key", F.col("v").alias("p"))
        back = wide.where(F.col("context") & (F.col("order") == order - 1)).select(
            F.col("key").alias("before"), F.col("v").alias("back")
        )
        rows = keys[order].join(own, "key", "left").withColumn("before", F.shiftrightunsigned("key", 16))
        if under is None:
            # The empty context is one row.
            rows = rows.join(F.broadcast(back), "before", "left").withColumn(
                "under", F.array_repeat(F.lit(-math.log(1 << 16)), len(langs))
            )
        else:
            mask = (1 << (16 * (order - 1))) - 1
            rows = rows.join(back, "before", "left").withColumn("after", F.col("key").bitwiseAND(mask))
            rows = rows.join(under.select(F.col("key").alias("after"), F.col("v").alias("under")), "after")
        value = F.transform(
            "under", lambda u, i: F.coalesce(F.get("p", i), F.coalesce(F.get("back", i), F.lit(0.0)) + u)
        )
        if order < ORDER:
            under = stored(rows.select("key", value.alias("v")), f"resolved-{order}")
    whole = F.transform(value, lambda x: F.round(x * UNIT).cast("int"))
    return stored(rows.select("key", F.length(F.bin("n")).alias("slice"), whole.alias("v")), f"resolved-{ORDER}")


@dataclass
class Head:
    """The most frequent sequences, sorted, with their log probabilities, a column per language."""

    keys: np.ndarray
    values: np.ndarray

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the keys, zero where they are not held, and which these are."""
        if not len(self.keys):
            return np.zeros((len(keys), self.values.shape[1]), np.int32), np.ones(len(keys), bool)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        missing = self.keys[at] != keys
        found = self.values[at]
        found[missing] = 0
        return found, missing


def collect_head(table: DataFrame, width: int, head_bytes: int) -> tuple[Head, DataFrame | None]:
    """The slices of highest frequency that fit ``head_bytes``, and the rest (None if there is none)."""
    room = head_bytes // (8 + 4 * width)
    # At most 64 rows.
    slices = sorted(((r["slice"], r["count"]) for r in table.groupBy("slice").count().collect()), reverse=True)
    taken = 0
    for least, n in slices:
        room -= n
        if room < 0:
            break
        taken += 1
    held = [s for s, _ in slices[:taken]]
    frame = table.where(F.col("slice").isin(held)).select("key", "v").toArrow()
    keys = frame["key"].to_numpy().astype(np.int64).view(np.uint64)
    values = frame["v"].combine_chunks().flatten().to_numpy().astype(np.int32).reshape(len(keys), width)
    order = np.argsort(keys)
    rest = table.where(~F.col("slice").isin(held)) if taken < len(slices) else None
    return Head(keys[order], values[order]), rest


def _counted(keys: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys of each of ``n`` owners with their counts, and where each owner's begin."""
    order = np.lexsort((keys, owners))
    keys, owners = keys[order], owners[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    at = np.flatnonzero(fresh)
    counts = np.diff(np.append(at, len(keys)))
    return keys[at], counts, np.searchsorted(owners[at], np.arange(n + 1))


def score(docs: DataFrame, head: Head, rest: DataFrame | None, langs: list[str], id_column: str = "doc_id",
          text_column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: ``id``, ``lang_pred``, ``entropy`` (nats per unit) and ``score``, with the columns ``carry``.

    The language with the lowest cross-entropy per unit is chosen, the first by name on a tie.
    ``score`` is its share when every language counts with the exponential of its mean log probability.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(head)  # bounded, see HEAD_BYTES
    width = len(langs)

    def add_up(batches):
        held = shared.value
        # A slice meets all languages at once, so with many of them it is shorter.
        step = max(1, 8 * SLICE // max(8, width))
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sizes, sums, left = [], [], []
            for begin, end in _slices(texts):
                keys, starts = sequences(texts[begin:end])
                total = np.zeros((end - begin, width), np.int64)
                absent, owners = [], []
                for low in range(0, len(keys), step):
                    part = keys[low : low + step]
                    values, missing = held.look_up(part)
                    cut = np.clip(starts - low, 0, len(part))
                    own = np.flatnonzero(cut[1:] > cut[:-1])
                    total[own] += np.add.reduceat(values, cut[own], axis=0, dtype=np.int64)
                    at = np.flatnonzero(missing)
                    absent.append(part[at])
                    owners.append(np.searchsorted(starts, at + low, "right") - 1)
                lettered = np.array([any(map(str.isalpha, t)) for t in texts[begin:end]])
                found = np.concatenate(absent), np.concatenate(owners)
                wanted = lettered[found[1]]
                sizes.append(np.where(lettered, np.diff(starts), 0))
                sums.append(total)
                left.append(_counted(found[0][wanted], found[1][wanted], end - begin))
            base, offsets = 0, [np.zeros(1, np.int64)]
            for keys, _, ends in left:
                offsets.append(ends[1:] + base)
                base += len(keys)
            offsets = pa.array(np.concatenate(offsets).astype(np.int32))
            joined = lambda parts: np.concatenate([np.zeros(0, np.int64), *[p.astype(np.int64) for p in parts]])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(joined(sizes)),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(texts) + 1, dtype=np.int32) * width), pa.array(joined([t.ravel() for t in sums]))
                    ),
                    pa.ListArray.from_arrays(offsets, pa.array(joined([k.view(np.int64) for k, _, _ in left]))),
                    pa.ListArray.from_arrays(offsets, pa.array(joined([n for _, n, _ in left]))),
                    *batch.columns[3:],
                ],
                ["row", "id", "size", "sums", "keys", "counts", *carry],
            )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"),
        text_of(text_column).alias("text"), *carry,
    )
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    extra = "".join(f", {c} {types[c]}" for c in carry)
    added = map_batches(
        rows, add_up, f"row long, id long, size long, sums array<long>, keys array<long>, counts array<long>{extra}"
    )
    if rest is not None:
        added = stored(added, "sums")
        # A sequence of the rest is rarer than all that the head holds, so no key is hot.
        pairs = added.select("row", F.explode(F.arrays_zip("keys", "counts")).alias("x"))
        pairs = pairs.select("row", F.col("x.keys").alias("key"), F.col("x.counts").alias("n"))
        others = (
            pairs.join(rest.select("key", "v"), "key")
            .groupBy("row")
            .agg(F.array(*[F.sum(F.col("n") * F.get("v", F.lit(i))) for i in range(width)]).alias("others"))
        )
        both = F.transform("sums", lambda x, i: x + F.coalesce(F.get("others", i), F.lit(0)))
        added = added.join(others, "row", "left").withColumn("sums", both)
    best = F.array_max("sums")
    share = F.aggregate(
        F.transform("sums", lambda x: F.exp((x - best) / F.col("size") / UNIT)), F.lit(0.0), lambda a, x: a + x
    )
    lettered = F.col("size") > 0
    names = F.array(*[F.lit(x) for x in langs])
    return added.select(
        "id",
        F.when(lettered, F.get(names, (F.array_position("sums", best) - 1).cast("int"))).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(lettered, -best / F.col("size") / UNIT).alias("entropy"),
        F.when(lettered, 1 / share).otherwise(0.0).alias("score"),
        *carry,
    )


def identify(docs: DataFrame, training: Column, id_column: str = "doc_id", text_column: str = "text",
             lang_column: str = "lang", deviations: float = 4.0, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """Learn from the rows for which ``training`` holds, and predict all rows.

    Returns ``id``, ``lang_pred``, ``score``, ``entropy`` and ``rejected``.  A prediction is rejected if
    its cross-entropy lies more than ``deviations`` standard deviations over the mean of the training
    documents of that language; with fewer than two of these nothing is rejected.  Texts that are
    NULL, empty or without a letter are undetermined with score 0, as is everything if there is
    nothing to learn from.  Rows of NULL language are never learnt from.  Repeated rows count and are
    scored one by one; an empty table gives an empty result.
    """
    own = F.when(F.coalesce(training, F.lit(False)), F.col(lang_column))
    marked = docs.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"), own.alias("own_lang")
    )
    texts = marked.where(F.col("text").isNotNull()).select(F.col("own_lang").alias("lang"), "text")
    counts = stored(count_sequences(texts), "sequences")
    learnt = counts.where("lang IS NOT NULL")
    langs = sorted(r["lang"] for r in learnt.select("lang").distinct().collect())
    if langs:
        known = resolved(counts, probabilities(learnt), langs)
        head, rest = collect_head(known, len(langs), head_bytes)
        scored = score(marked, head, rest, langs, "id", "text", ("own_lang",))
    else:
        scored = marked.select(
            F.col("id").cast("long").alias("id"), F.lit(UNDETERMINED).alias("lang_pred"),
            F.lit(None).cast("double").alias("entropy"), F.lit(0.0).alias("score"), "own_lang",
        )
    scored = stored(scored, "languages")
    usual = (
        scored.where("own_lang = lang_pred")
        .groupBy("lang_pred")
        .agg((F.avg("entropy") + deviations * F.stddev_samp("entropy")).alias("most"))
    )
    # One row per learnt language.
    return scored.join(F.broadcast(usual), "lang_pred", "left").select(
        "id", "lang_pred", "score", "entropy",
        F.coalesce(F.col("entropy") > F.col("most"), F.lit(False)).alias("rejected"),
    )
