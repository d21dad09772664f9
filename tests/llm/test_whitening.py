"""Whitening: exact figures, awkward vectors, spectra with small gaps."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from usagelens.llm import whitening
from usagelens.llm.whitening import Settings, filtered_components, whiten

from . import brute
from .test_operators import clash

SCHEMA = "vec_id long, embedding array<float>"


def gaussian(n, width, seed=1):
    r = random.Random(seed)
    return [[r.gauss(0, 1 + j % 5) for j in range(width)] for _ in range(n)]


def by_row(rows):
    return {(r.vec_id, r.component): r for r in rows}


def test_against_the_whole_covariance(spark, table):
    vectors = gaussian(300, 20)
    found = whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id int, embedding array<double>")).collect()
    n, deviation, projected, explained = brute.whitened(vectors, 4)
    rows = by_row(found)
    for c in range(4):
        own = np.array([rows[i, c + 1].whitened for i in range(300)])
        assert min(np.abs(own - projected[:, c]).max(), np.abs(own + projected[:, c]).max()) < 1e-9
        assert rows[0, c + 1].explained == pytest.approx(explained[c], rel=1e-12)
    assert [rows[i, 1].deviation for i in range(300)] == deviation and rows[0, 1].n == n


def test_awkward_vectors(spark, table):
    good = [[1.0, 2.0], [1.0, 2.0], [3.0, -1.0], [-0.001, 5.0], [7.5]]
    bad = [None, [1.0, None], [float("nan"), 1.0], [float("inf"), 0.0], [-float("inf"), 0.0]]
    rows = [(i, v) for i, v in enumerate(good + bad)] + [(None, [3.0, -1.0]), (0, [1.0, 2.0])]
    found = whiten(clash(table(rows, SCHEMA), "component", "n", "entries", "x")).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id) for r in found) == sorted([-1, 0, 0, 1, 2, 3, 4] * 2)
    # The vector that three rows have counts once; the short one ends in a zero.
    assert {r.n for r in found} == {4}
    padded = [v + [0.0] * (2 - len(v)) for v in good]
    _, deviation, projected, _ = brute.whitened(padded, 2)
    own = by_row(found)
    assert [own[i, 1].deviation for i in range(5)] == deviation
    for c in range(2):
        column = np.array([own[i, c + 1].whitened for i in range(5)])
        assert min(np.abs(column - projected[:, c]).max(), np.abs(column + projected[:, c]).max()) < 1e-9
    assert own[None, 1].whitened == own[2, 1].whitened


def test_empty_and_degenerate(spark, table):
    assert whiten(table([], SCHEMA)).count() == 0
    assert whiten(table([(1, None), (2, [])], SCHEMA)).count() == 0
    same = whiten(table([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect()
    assert [(r.whitened, r.explained, r.n, r.deviation) for r in same] == [(None, 0.0, 1, 0)] * 4
    line = whiten(table([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], SCHEMA)).collect()
    assert {r.component for r in line if r.whitened is not None} == {1}
    assert {r.component for r in line} == {1, 2, 3}


def test_huge_entries_stay_exact(spark, table):
    rows = [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 4.0]), (4, [0.0, 1e6])]
    found = whiten(table(rows, SCHEMA)).where("component = 1").collect()
    x = [[max(-(1 << 62), min(1 << 62, math.floor(256 * c))) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    for r in found:
        exact = sum((4 * c - s) ** 2 for c, s in zip(x[r.vec_id - 1], sums))
        assert (r.deviation, r.wide_deviation) == ((exact, None) if exact < 1 << 63 else (None, str(exact)))


@pytest.mark.parametrize("values", [
    [1.0, 1 - 1e-5, 1 - 2e-5, 1 - 3e-5, *[1 - 1e-4 * j for j in range(1, 60)]],
    [100.0, 1.0, 1.0, 1.0, 1.0, *[0.5] * 40],
    [5.0, 3.0, 0.0, 0.0, 0.0],
])
def test_spectra(values):
    r = np.random.default_rng(4)
    turned = np.linalg.qr(r.standard_normal((len(values), len(values))))[0]
    whole = turned @ np.diag(values) @ turned.T
    passes = []

    def multiply(q):
        passes.append(1)
        return whole @ q, float(np.trace(whole))

    vectors, found, _, error, _ = filtered_components(multiply, len(values), Settings())
    wanted = sorted(values, reverse=True)[:4]
    assert np.abs(found - wanted).max() < 1e-12 * wanted[0]
    assert np.abs(whole @ vectors - vectors * found).max() < 1e-10 * wanted[0] and error < 1e-9
    assert len(passes) < 600


def test_a_fit_that_does_not_settle_fails():
    r = np.random.default_rng(4)
    noisy = lambda q: (r.standard_normal(q.shape), 1.0)
    with pytest.raises(ArithmeticError):
        filtered_components(noisy, 80, Settings(rounds=3))


def test_one_vector_of_most_rows_is_combined_before_the_shuffle(spark, table):
    rows = table([(i, [1.0, 2.0] if i % 3 else [float(i), 0.0]) for i in range(90)], SCHEMA)
    found, width = whitening.fit_list(rows.where(whitening.usable("embedding")), "embedding")
    assert (found.count(), width) == (31, 2)
    assert found.agg(F.max(F.size("x"))).first()[0] == 2
