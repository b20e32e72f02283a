import math
import random

import numpy as np
import pytest

from conftest import SMALL
from tilepulse.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, n long, component int, part long, state string"


def exact(vectors):
    """n, per row the deviation in whole numbers, and the eigenvalues of the covariance."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(column) for column in zip(*x)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    gap = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    values, directions = np.linalg.eigh(gap.T @ gap / n)
    return n, deviations, gap, values[::-1], directions[:, ::-1]


def compare(rows, vectors, tol=1e-9):
    """Against a decomposition of the whole covariance."""
    n, deviations, gap, values, directions = exact(vectors.values())
    k = min(8, len(values))
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert got.keys() == vectors.keys()
    white = gap @ directions[:, :k] / np.sqrt(values[:k])
    for i, (vec_id, deviation) in enumerate(zip(vectors, deviations)):
        assert sorted(got[vec_id]) == list(range(1, k + 1))
        for c, r in got[vec_id].items():
            assert (r.n, r.deviation) == (n, deviation)
            assert abs(r.explained - values[c - 1] / values.sum()) < 1e-10
            assert 0 <= r.identity_error < 1e-9
    found = np.array([[got[v][c].whitened for c in range(1, k + 1)] for v in vectors])
    signs = np.sign((found * white).sum(0))
    assert np.abs(found - white * signs).max() < tol


def test_query_11(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    rows = queries.QUERIES["op11_whitening"](spark, SMALL).collect()
    compare(rows, {r.vec_id: r.embedding for r in table})


@pytest.mark.parametrize("seed", range(6))
def test_rank_one_updates(seed):
    """Against decompositions of the whole matrix, with equal eigenvalues and zeros."""
    rng = np.random.default_rng(seed)
    dim = int(rng.integers(1, 12))
    lam, vec = np.zeros(dim), np.eye(dim)
    whole = np.zeros((dim, dim))
    for step in range(40):
        x = rng.normal(size=dim) * 10.0 ** rng.integers(-6, 3)
        if step % 3 == 0:
            x[rng.integers(0, dim, 2)] = 0
        if step % 5 == 0:
            x = np.round(vec[:, rng.integers(0, dim)], 3)
        rho = float(rng.uniform(0, 2))
        lam, vec = whitening.rank_one(lam, vec, rho, x)
        whole += rho * np.outer(x, x)
        scale = max(np.abs(whole).max(), 1e-300)
        assert np.abs(vec.T @ vec - np.eye(dim)).max() < 1e-12
        assert np.abs(vec * lam @ vec.T - whole).max() < 1e-12 * scale
        assert (np.diff(lam) >= 0).all()


def test_spectra_combine():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(300, 7)) * rng.uniform(0.1, 40, 7) + 1000
    parts = [whitening.Spectrum(7) for _ in range(4)]
    for i, row in enumerate(rows):
        parts[i % 3].add(row)  # the fourth stays empty
    whole = whitening.Spectrum(7)
    for part in parts:
        whole.merge(whitening.Spectrum.of(part.packed(), 7))
    gap = rows - rows.mean(0)
    assert whole.n == 300 and np.abs(whole.mean - rows.mean(0)).max() < 1e-9
    assert np.abs(whole.vec * whole.lam @ whole.vec.T / (gap.T @ gap) - 1).max() < 1e-6


def test_a_third_of_all_rows_is_one_vector(spark):
    rng = np.random.default_rng(7)
    rows = {i: rng.normal(size=12).astype(np.float32).tolist() for i in range(200)}
    rows |= {1000 + i: rows[0] for i in range(100)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>")
    compare(whitening.whitened(df.repartition(40)).collect(), rows)  # a tree of two levels


def test_odd_vectors(spark):
    rng = random.Random(2)
    nan, inf = float("nan"), float("inf")
    good = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    odd = [(100, None), (101, []), (102, [nan] * 6), (103, [inf, *[1.0] * 5]), (104, [None, *[1.0] * 5]),
           (105, [1.0, 2.0])]
    rows = [(i, v, 5, 5, 5, "x") for i, v in [*good, *odd, good[0], (None, [0.5] * 6)]]
    found = whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(found) == 62 * 6 and {r.n for r in found} == {62}
    assert {r.vec_id for r in found} == {*range(60), None}
    assert found[0].identity_error < 1e-9


def test_few_rows_and_no_variance(spark):
    def of(vectors):
        df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
        return sorted(whitening.whitened(df).collect(), key=lambda r: (r.vec_id, r.component))

    assert of([]) == []
    one = of([[1.0, 2.0]])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in one] == [(1, 1, 0, None, None), (2, 1, 0, None, None)]
    line = of([[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]])
    assert [r.whitened is None for r in line] == [False, True] * 3 and abs(line[0].explained - 1) < 1e-12
    far = of([[3e38, 0.0], [-3e38, 1.0], [0.0, 0.0]])
    assert all(r.deviation is None for r in far[:4]) and len(far) == 6
