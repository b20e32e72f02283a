import random

import pytest
from models import contains, inside, overlap, random_rect
from pyspark.sql import functions as F

from tilepulse.operators import joins
from tilepulse.operators.skew import salted_join

SIDES = "id int, top_left_lat double, top_left_lng double, bot_right_lat double, bot_right_lng double"
TOP_TO_EAST = ["top_left_lat", "top_left_lng", "bot_right_lat", "bot_right_lng"]

# name, a, b, overlap?  (top, left, bottom, right)
PICTURES = [
    ("self", (2, 1, 1, 2), (2, 1, 1, 2), True),
    ("side by side", (2, 1, 1, 2), (2, 3, 1, 4), False),
    ("above and below", (5, 3, 4, 4), (2, 3, 1, 4), False),
    ("lower left, upper right", (2, 1, 1, 2), (4, 3, 3, 4), False),
    ("nested", (4, 1, 1, 4), (3, 2, 2, 3), True),
    ("touching above", (3, 2, 2, 3), (4, 2, 3, 3), False),
    ("touching left", (3, 2, 2, 3), (3, 1, 2, 2), False),
    ("touching below", (3, 2, 2, 3), (2, 2, 1, 3), False),
    ("touching right", (3, 2, 2, 3), (3, 3, 2, 4), False),
    ("partial", (3, 1, 1, 3), (4, 2, 2, 4), True),
]


def table(spark, rects):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rects)], SIDES)


@pytest.mark.parametrize("limits", [{}, {"broadcast_rows": 0, "hot_rows": 20}])
def test_pictures(spark, limits):
    a, b = table(spark, [p[1] for p in PICTURES]), table(spark, [p[2] for p in PICTURES])
    for left, right in ((a, b), (b, a)):
        pairs = joins.overlap_join(left, right, **limits).filter("a.id = b.id")
        found = {r.a.id for r in pairs.collect()}
        assert found == {i for i, p in enumerate(PICTURES) if p[3]}


INF = float("inf")
ENDLESS = [
    (INF, -INF, -INF, INF),
    (INF, 0.0, 10.0, 5.0),
    (50.0, -INF, 49.0, 3.0),
    (1e300, 0.0, -1e300, 1e300),
    (INF, 1.0, 300.0, 2.0),
    (400.0, 700.0, 300.0, 800.0),
    (52.0, 1.0, 51.0, 2.0),
    (INF, 0.0, INF, 5.0),
]


@pytest.mark.parametrize("limits", [{}, {"broadcast_rows": 0}])
def test_endless_rectangles(spark, limits):
    side = table(spark, ENDLESS)
    assert side.count() == joins._with_home(joins._side(side, "s"), "s").count()
    homed = joins._with_home(joins._side(side, "s"), "s")
    assert joins._cells(homed, "s", F.array("home")).count() <= joins._most_cells(joins._census(homed))
    pairs = joins.overlap_join(side, side, **limits).collect()
    want = [(i, j) for i, x in enumerate(ENDLESS) for j, y in enumerate(ENDLESS) if overlap(x, y)]
    assert sorted((r.a.id, r.b.id) for r in pairs) == want
    pairs = joins.contains_join(side, side, **limits).collect()
    want = [(i, j) for i, x in enumerate(ENDLESS) for j, y in enumerate(ENDLESS) if contains(x, y)]
    assert sorted((r.outer.id, r.inner.id) for r in pairs) == want
    points = [(0, 60.0, 1.0), (1, 49.5, -170.0), (2, 350.0, 1.5)]
    rows = spark.createDataFrame(points, "id int, lat double, lng double")
    found = joins.points_in_regions(rows, side, **limits).collect()
    want = [(p, i) for p, lat, lng in points for i, x in enumerate(ENDLESS) if inside(x, lat, lng)]
    assert sorted((r.point.id, r.region.id) for r in found) == want


@pytest.fixture(scope="module")
def rects():
    """Mixed sizes, from specks to half the world, many of them in one spot."""
    rng = random.Random(3)
    sizes = [0.002, 0.5, 7, 60, 180]
    mixed = [random_rect(rng, rng.choice(sizes)) for _ in range(220)]
    crowd = [
        (51.5 + rng.uniform(0, 0.2), 0.1 + rng.uniform(0, 0.2), 51.4, 0.0 + rng.uniform(0.31, 0.4))
        for _ in range(110)
    ]
    return mixed + crowd


LIMITS = [{}, {"broadcast_rows": 0}, {"broadcast_rows": 0, "hot_rows": 25}]


@pytest.mark.parametrize("limits", LIMITS)
def test_overlap_equals_all_pairs(spark, rects, limits):
    a, b = rects[:270], rects[120:]
    rows = joins.overlap_join(table(spark, a), table(spark, b), **limits).collect()
    got = sorted((r.a.id, r.b.id) for r in rows)
    want = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if overlap(x, y))
    assert got == want and len(want) > 1000


@pytest.mark.parametrize("limits", LIMITS)
def test_contains_equals_all_pairs(spark, rects, limits):
    outer = [*rects[:150], rects[0]]
    rows = joins.contains_join(table(spark, outer), table(spark, rects), **limits).collect()
    got = sorted((r.outer.id, r.inner.id) for r in rows)
    want = sorted((i, j) for i, x in enumerate(outer) for j, y in enumerate(rects) if contains(x, y))
    assert got == want and len(want) > 300


@pytest.mark.parametrize("limits", LIMITS)
def test_points_equal_all_pairs(spark, rects, limits):
    rng = random.Random(8)
    points = [(rng.uniform(-95, 95), rng.uniform(-190, 190)) for _ in range(300)]
    points += [(r[0], r[1]) for r in rects[::5]] + [(r[2], r[3]) for r in rects[::7]]
    points += [(51.45, 0.31)] * 100
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, lat double, lng double")
    rows = joins.points_in_regions(df, table(spark, rects), **limits).collect()
    got = sorted((r.point.id, r.region.id) for r in rows)
    want = sorted(
        (i, j) for i, p in enumerate(points) for j, r in enumerate(rects) if inside(r, *p)
    )
    assert got == want and len(want) > 5000


def test_empty_sides(spark, rects):
    none, some = table(spark, []), table(spark, rects[:5])
    assert joins.overlap_join(none, some).count() == 0
    assert joins.overlap_join(some, none).count() == 0
    assert joins.contains_join(none, some).count() == 0


def test_no_nested_loop_in_a_large_join(spark, rects):
    df = table(spark, rects)
    plan = joins.overlap_join(df, df, broadcast_rows=0)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_salted_join_with_hot_keys_on_both_sides(spark):
    left = spark.range(3000).selectExpr("id as l", "if(id % 3 = 0, 7, id % 40) as k")
    right = spark.range(900).selectExpr("id as r", "if(id % 3 = 0, 7, id % 50) as k")
    plain = left.join(right, "k")
    salted = salted_join(left, right, ["k"], hot_rows=100)
    assert salted.count() == plain.count()
    assert salted.select("l", "r", "k").exceptAll(plain.select("l", "r", "k")).isEmpty()


def test_equal_rows_of_a_hot_key_part(spark):
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    try:
        left = spark.range(4000).selectExpr("7 as k", "1 as same")
        right = spark.range(3).selectExpr("7 as k", "id as r")
        joined = salted_join(left, right, ["k"], hot_rows=200)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(sizes) == 12000 and len(sizes) > 4 and max(sizes) < 6000


def test_salted_join_derives_each_side_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(_):
        calls.add(1)
        return True

    side = spark.range(500).selectExpr("id % 5 as k", "id as v").filter(seen("v"))
    other = spark.range(5).selectExpr("id as k")
    assert salted_join(side, other, ["k"], hot_rows=50).count() == 500
    assert calls.value == 500


@pytest.mark.parametrize("few, many", [(3, 60), (60, 3)])
def test_fields_chosen_from_pairs(spark, tmp_path, rects, few, many):
    """One side within the bound of a broadcast, one beyond, and not all fields read."""
    limits = {"broadcast_rows": 500}
    a, b = rects[:few], rects[40 : 40 + many]
    derived = [F.col("id"), F.lit(8).alias("unread"), *[(F.col(c) + 0.0).alias(c) for c in TOP_TO_EAST]]
    sides = []
    for name, side in (("a", a), ("b", b)):
        table(spark, side).write.parquet(f"{tmp_path}/{name}")
        sides.append(spark.read.parquet(f"{tmp_path}/{name}").select(*derived))
    found = joins.overlap_join(*sides, **limits).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    want = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if overlap(x, y))
    assert sorted(map(tuple, found.collect())) == want and want
    found = joins.contains_join(*sides, **limits).select("outer.id", F.col("inner.id").alias("inner"))
    want = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if contains(x, y))
    assert sorted(map(tuple, found.collect())) == want
    points = sides[1].selectExpr("id", "top_left_lat as lat", "top_left_lng as lng")
    found = joins.points_in_regions(points, sides[0], **limits).select("point.id", F.col("region.id").alias("r"))
    want = sorted((j, i) for i, x in enumerate(a) for j, y in enumerate(b) if inside(x, y[0], y[1]))
    assert sorted(map(tuple, found.collect())) == want
