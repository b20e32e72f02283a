from collections import Counter

import odd
import pytest
from pyspark.sql import functions as F

from tilepulse.llm import mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Share, cut at the cap, share the excess again: as the words have it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, excess = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while open_ and excess > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += excess * weight[s] / total
        excess = 0.0
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                excess += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


CASES = [
    {"a": 100, "b": 100, "c": 100},
    {"a": 10, "b": 1000, "c": 10, "d": 5},
    {"a": 0, "b": 7, None: 50},
    {"é": 3, "z": 90, "Z": 20, "ａ": 400, "😀": 1},
    {"only": 11},
    {"a": 0},
]


@pytest.mark.parametrize("sizes", CASES)
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "_source string, _source_size long")
    got = {r[0]: r[2] for r in mixing.source_targets(rows).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_odd_documents(spark):
    plan = mixing.mix_plan(odd.documents(spark)).select("row.*", "size", "copies", "target", "source_size")
    assert plan.count() == len(odd.rows())
    rows = mixing.mix_plan(odd.documents(spark)).select("row.doc_id", "row.text", "size", "copies").collect()
    for r in rows:
        assert r["size"] == len((r.text or "").split()) and 0 <= r.copies <= 2
    again = mixing.mix_plan(odd.documents(spark).repartition(7)).select("row.doc_id", "row.text", "size", "copies")
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again.collect()))
    mixed = mixing.mix(odd.documents(spark))
    assert mixed.columns == odd.documents(spark).columns
    assert mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix(odd.none(spark)).count() == 0


def test_sources_come_near_their_targets(spark):
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"),
        F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 40 + 1).cast("int"))).alias("text"),
        F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("source"),
    )
    plan = mixing.mix_plan(docs).groupBy("row.source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")
    )
    for r in plan.collect():
        assert abs(r.taken / r.target - 1) < 0.03


def test_a_large_table_of_sources_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixing, "is_small", lambda *a: False)
    docs = odd.documents(spark)
    plain = mixing.mix_plan(docs).select("row.doc_id", "size", "copies").collect()
    assert len(plain) == len(odd.rows())
