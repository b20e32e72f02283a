import math
import random

import numpy as np
import pytest

from conftest import SMALL
from tilepulse.llm import ann, queries

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v int, tree int, leaf int, score double"


def exact(vectors, query_ids, k=20):
    """(query, rank, id, score) by comparing with every row."""
    out = {}
    for q in query_ids:
        scores = [(-math.fsum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q]
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def recall(rows, want):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = sum(len({v for v, _ in got.get(q, {}).values()} & {v for v, _ in near}) for q, near in want.items())
    for found in got.values():  # ranks are dense, nearest first
        assert sorted(found) == list(range(1, len(found) + 1))
        ordered = [found[i] for i in sorted(found)]
        assert ordered == sorted(ordered, key=lambda x: (-x[1], x[0]))
    return hits / sum(map(len, want.values()))


def test_query_2(spark):
    table = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    rows = queries.QUERIES["op2_ann"](spark, SMALL).collect()
    asked = [i for i in table if i % 20 == 0]
    want = exact(table, asked)
    assert recall(rows, want) >= 0.9 and len(rows) == 20 * len(asked)
    for r in rows:
        assert abs(r.score - math.fsum(a * b for a, b in zip(table[r.query_id], table[r.vec_id]))) < 1e-12


def test_recall_where_leaves_are_few_of_many(spark):
    """Rows of many lengths, far more leaves than are visited."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    rows = centres[rng.integers(0, 40, 6000)] + 0.4 * rng.normal(size=(6000, 24))
    rows *= rng.uniform(0.7, 1.3, size=(6000, 1))
    table = {i: v.astype(np.float32).tolist() for i, v in enumerate(rows)}
    df = spark.createDataFrame(list(table.items()), "vec_id long, embedding array<float>").repartition(5)
    found = ann.nearest(df, df.filter("vec_id % 200 = 0")).collect()
    assert recall(found, exact(table, range(0, 6000, 200))) >= 0.9


def odd_vectors():
    rng = random.Random(2)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 0.0, 0.0, 1.0, 0.0]) for i in range(70)]  # one vector, many ids
    rows += [(20, None), (40, []), (200, [0.0] * 6), (220, [nan] * 6), (240, [inf, *[1.0] * 5]),
             (260, [None, *[1.0] * 5]), (280, [1.0, 2.0]), (None, [1.0] * 6)]
    rows += [rows[0]]  # a repeated row
    return rows


def test_odd_vectors(spark):
    rows = [(i, v, None, 5, 5, 5, 5, 5.0) for i, v in odd_vectors()]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = ann.nearest(df, df.filter("vec_id % 20 = 0"), probes=10_000).collect()
    kept = {i: np.float32(v).tolist() for i, v in odd_vectors()[:130]}
    want = exact(kept, [i for i in kept if i % 20 == 0])
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i, _ in near] for q, near in want.items()}  # ties by id as well


def test_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    found = ann.nearest(df, df.filter("vec_id = 0")).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    assert ann.nearest(df, df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [3, 10])
def test_blocks_change_nothing(spark, monkeypatch, block):
    df = spark.createDataFrame([(i, v) for i, v in odd_vectors() if v], "vec_id long, embedding array<float>")
    asked = df.filter("vec_id % 20 = 0")
    want = sorted(map(tuple, ann.nearest(df, asked, probes=10_000).collect()))
    monkeypatch.setattr(ann, "BLOCK", block)
    assert sorted(map(tuple, ann.nearest(df, asked, probes=10_000).collect())) == want
