"""Whitening of embeddings: principal components by Chebyshev-filtered subspace iteration.

Vectors are turned into whole numbers, so that sums, means and deviations are exact.  The components are
found without the covariance matrix itself: every pass over the distinct vectors multiplies their
centred X by a block of a few columns Q, giving X'XQ as one small table, and a polynomial of such passes
damps the part of the spectrum that is not wanted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import map_batches, stored

#: Entries become floor(SCALE * c).
SCALE = 256
#: Entries beyond it are brought to it, so that they fit a long.
LARGEST = 1 << 62
#: Rows of a pass that are multiplied at a time.
ROWS = 4096


@dataclass(frozen=True)
class Settings:
    """``components`` are looked for with ``guard`` more columns: the filter then damps what lies below the
    last of them, which is further from the wanted ones than the next eigenvalue, so fewer passes do.

    ``degree`` is the highest degree of the filter, i.e. the most passes of a round.  Rounds go on until the residuals
    are under ``tolerance`` times the largest eigenvalue and no longer halve; after ``rounds`` rounds
    without that the fit fails.
    """

    components: int = 4
    guard: int = 28
    degree: int = 32
    tolerance: float = 1e-11
    rounds: int = 60


@dataclass(frozen=True)
class Fit:
    """What the rows are projected with; all but ``vectors`` (d x k) are exact or small."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    rounds: int

    @property
    def scales(self) -> np.ndarray:
        """Roots of the eigenvalues; NaN where one cannot be told from zero."""
        floor = 1e-13 * max(self.trace, 0.0)
        return np.sqrt(np.where(self.values > floor, self.values, np.nan))


def usable(column: str) -> Column:
    """True for a vector without NULL, NaN and infinite entries."""
    entry = lambda c: c.cast("double").isNotNull() & (F.abs(c.cast("double")) < float("inf"))
    return F.coalesce(F.forall(column, entry), F.lit(False))


def whole_numbers(entries: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) of every entry, within ``LARGEST``."""
    return np.clip(np.floor(SCALE * entries.astype(np.float64)), -float(LARGEST), float(LARGEST)).astype(np.int64)


def _rows_of(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix; a vector shorter than the longest ends in zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    matrix = np.zeros((len(lengths), width), values.dtype)
    for row, part in zip(matrix, np.split(values, np.cumsum(lengths)[:-1])):
        row[: len(part)] = part
    return matrix


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, exactly: as longs if they fit, else as Python's own numbers."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most < 1 << 63:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return deviations(x, n, sums).astype(np.float64) / n


def _squares(deviation: np.ndarray) -> list[int]:
    """Sums of squares of rows, exactly."""
    width = max(deviation.shape[1], 1)
    most = int(np.abs(deviation).max(initial=0))
    if deviation.dtype == object or most * most * width >= 1 << 63:
        return [sum(int(y) * int(y) for y in row) for row in deviation]
    return (deviation * deviation).sum(axis=1).tolist()


def fit_list(vectors: DataFrame, column: str) -> tuple[DataFrame, int]:
    """Every distinct whole-number vector once (``x``, stored), and the length of the longest.

    Vectors are made distinct as arrays of whole numbers, combined before the shuffle, so that one that
    very many rows have is not a hot key.
    """
    width = vectors.agg(F.max(F.size(column)).alias("width")).first()["width"] or 0
    bound = float(LARGEST)
    scaled = F.transform(
        column, lambda c: F.greatest(F.least(F.floor(c.cast("double") * SCALE).cast("double"), F.lit(bound)), F.lit(-bound)).cast("long")
    )
    padded = F.concat(scaled, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(width) - F.size(column), F.lit(0))))
    return stored(vectors.select(padded.alias("x")).distinct(), "whole-vectors"), width


def _counted(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number and sums per dimension of the fit list, exactly."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for batch in batches:
            x = _rows_of(batch.column(0), width)
            n += len(x)
            safe = len(x) * int(np.abs(x).max(initial=0)) < 1 << 63
            part = x.sum(axis=0).tolist() if safe else x.astype(object).sum(axis=0).tolist()
            sums = [a + b for a, b in zip(sums, part)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(-1, width), pa.int32()),
                    pa.array([str(s) for s in [n, *sums]], pa.string()),
                ],
                ["dimension", "total"],
            )

    found = map_batches(rows, partial, "dimension int, total string")
    totals = found.groupBy("dimension").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    by_dimension = {r["dimension"]: int(r["total"]) for r in totals}
    return by_dimension.get(-1, 0), [by_dimension.get(i, 0) for i in range(width)]


def _product(rows: DataFrame, n: int, sums: list[int]) -> Callable[[np.ndarray], tuple[np.ndarray, float]]:
    """One pass: the covariance times a block of columns, and the trace of the covariance.

    Every task gives one row per dimension; Spark adds them up, so the driver gets no more than the
    block, whatever the number of tasks.
    """
    width = len(sums)

    def multiply(q: np.ndarray) -> tuple[np.ndarray, float]:
        k = q.shape[1]
        names = [f"v{j}" for j in range(k)]

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, trace, some = np.zeros((width, k)), 0.0, False
            for batch in batches:
                x = _rows_of(batch.column(0), width)
                for at in range(0, len(x), ROWS):
                    y = _centred(x[at : at + ROWS], n, sums)
                    total += y.T @ (y @ q)
                    trace += float((y * y).sum())
                    some = True
            if some:
                traces = np.zeros(width)
                traces[:1] = trace
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(width), pa.int32()), pa.array(traces), *[pa.array(total[:, j].copy()) for j in range(k)]],
                    ["dimension", "trace", *names],
                )

        schema = ", ".join(["dimension int", "trace double", *[f"{v} double" for v in names]])
        found = map_batches(rows, partial, schema).groupBy("dimension")
        result, trace = np.zeros((width, k)), 0.0
        for row in found.agg(*[F.sum(v).alias(v) for v in ["trace", *names]]).collect():
            result[row["dimension"]] = [row[v] for v in names]
            trace += row["trace"]
        return result / n, trace / n

    return multiply


def _degree(largest: float, last: float, half: float, most: int) -> int:
    """Degree of the next filter: what lifts the last wanted eigenvalue well above the damped ones, as far
    as the largest does not drown it.  The filter grows with the hyperbolic cosine of degree times rate."""
    rate = np.arccosh(max(last / half - 1, 1 + 1e-9))
    ahead = np.arccosh(max(largest / half - 1, 1 + 1e-9)) - rate
    return int(max(4, min(np.ceil(5 / rate), 18 / max(ahead, 1e-9), most)))


def filtered_components(multiply: Callable[[np.ndarray], tuple[np.ndarray, float]], width: int,
                        settings: Settings) -> tuple[np.ndarray, np.ndarray, float, float, int]:
    """Leading eigenvectors, eigenvalues, trace, identity error and rounds of a covariance given by its products.

    In each round a Chebyshev polynomial, scaled to be bounded on the interval from 0 to the smallest
    Ritz value of the block and to grow fast above it, is applied to the block by its three-term recurrence; a QR
    decomposition makes the block orthonormal again, and Rayleigh-Ritz turns it to the eigenvectors.
    The product that Rayleigh-Ritz needs also starts the next recurrence and gives the residuals, which
    bound the errors of the eigenvalues and, over the gaps, the vectors'.
    """
    k = min(width, settings.components + settings.guard)
    wanted = min(width, settings.components)
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((width, k)))[0]
    best, done = np.inf, 0
    while True:
        product, trace = multiply(q)
        values, turn = np.linalg.eigh(q.T @ product + (q.T @ product).T)
        values, turn = values[::-1] / 2, turn[:, ::-1]
        q, product = q @ turn, product @ turn
        largest = max(float(values[0]), 0.0) if k else 0.0
        worst = float(np.linalg.norm(product - q * values, axis=0)[:wanted].max(initial=0.0))
        settled = worst <= settings.tolerance * largest
        if k == width or largest == 0.0 or (settled and worst > best / 2) or worst <= 1e-15 * largest:
            break
        best = min(best, worst)
        if done == settings.rounds:
            if settled:
                break
            raise ArithmeticError(f"residual {worst} of {largest} after {done} rounds")
        upper = max(float(values[-1]), 1e-12 * largest)
        half = upper / 2
        degree = _degree(largest, float(values[wanted - 1]), half, settings.degree)
        sigma = first = half / (largest - half) if largest > upper else 1.0
        before, now = q, (product - half * q) * (sigma / half)
        for _ in range(degree - 1):
            following = 1 / (2 / first - sigma)
            image, _ = multiply(now)
            before, now = now, (image - half * now) * (2 * following / half) - before * (sigma * following)
            sigma = following
        q = np.linalg.qr(now)[0]
        done += 1
    with np.errstate(divide="ignore", invalid="ignore"):
        scales = np.sqrt(np.where(values[:wanted] > 1e-13 * trace, values[:wanted], np.nan))
        gram = (q[:, :wanted].T @ product[:, :wanted]) / np.outer(scales, scales)
    error = np.abs(gram - np.eye(wanted))
    return q[:, :wanted], values[:wanted], trace, float(np.nanmax(error, initial=0.0)), done


def fit(vectors: DataFrame, column: str, settings: Settings = Settings()) -> Fit:
    """Exact sums and certified components of the distinct vectors of ``column`` (all usable)."""
    rows, width = fit_list(vectors, column)
    n, sums = _counted(rows, width)
    if not n or not width:
        return Fit(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0, 0.0, 0)
    return Fit(n, sums, *filtered_components(_product(rows, n, sums), width, settings))


def whiten(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding",
           settings: Settings = Settings()) -> DataFrame:
    """One row per usable row and component: ``vec_id``, ``component`` (from 1, by falling eigenvalue), ``n``
    (distinct vectors), ``deviation``, ``whitened``, ``explained``, ``identity_error``, and
    ``wide_deviation`` (text) where the deviation does not fit a long, which is then NULL.

    Rows whose vector is NULL or holds a NULL, a NaN or an infinite entry are dropped.  Repeated rows and
    NULL ids are kept and agree; a repeated vector counts once in the fit.  A vector shorter than the
    longest ends in zeros; vectors without entries alone give no row, as there is no component.  Where an
    eigenvalue cannot be told from zero, ``whitened`` is NULL.  An empty table gives an empty result.

    ``n`` and the sums are whole numbers; entries beyond 2**62 count as that.
    """
    kept = vectors.select(F.col(id_column).alias("vec_id"), F.col(column).alias("entries")).where(usable("entries"))
    found = fit(kept, "entries", settings)
    n, sums, k = found.n, found.sums, len(found.values)
    turned, scales = found.vectors, found.scales
    explained = found.values / found.trace if found.trace > 0 else np.zeros(k)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not k or not len(batch):
                continue
            x = whole_numbers(_rows_of(batch.column(1), len(sums)))
            deviation = deviations(x, n, sums)
            squares = _squares(deviation)
            fits = [s if s < 1 << 63 else None for s in squares]
            wide = [None if s < 1 << 63 else str(s) for s in squares]
            projected = (deviation.astype(np.float64) / n) @ turned / scales
            rows = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(rows), n)),
                    pa.array(fits, pa.int64()).take(pa.array(rows)),
                    pa.array(projected.reshape(-1), from_pandas=True),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(rows), found.identity_error)),
                    pa.array(wide, pa.string()).take(pa.array(rows)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "wide_deviation"],
            )

    kind = kept.schema["vec_id"].dataType.simpleString()
    return map_batches(
        kept, project,
        f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double, wide_deviation string",
    )
