import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from tilepulse.functions import grid, measures
from tilepulse.functions.grid import COUNTS, TILE
from tilepulse.operators import activity, summary, tiles, viewport
from tilepulse.operators.viewport import Area
from tilepulse.plans import inputs, queries

TILES = "zoom int, row int, col int, device_count long, happy_count long, sad_count long"


@pytest.fixture(scope="module")
def events(spark):
    return inputs.fleet_events(spark, SMALL).cache()


@pytest.fixture(scope="module")
def table(events):
    return summary.summarize_all(events).cache()


def same(a, b):
    columns = [*TILE, *COUNTS]
    a, b = a.select(*columns), b.select(*columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize(
    "event, delta",
    [
        ("DeviceActivated", (1, 1, 0)),
        ("DeviceDeactivatedHappy", (-1, -1, 0)),
        ("DeviceDeactivatedSad", (-1, 0, -1)),
        ("DeviceMadeHappy", (0, 1, -1)),
        ("DeviceMadeSad", (0, -1, 1)),
        ("DevicePinged", (0, 0, 0)),
    ],
)
def test_deltas(spark, event, delta):
    row = summary.with_deltas(spark.createDataFrame([(event,)], "event_type string")).head()
    assert tuple(row[c] for c in COUNTS) == delta


def test_rolled_up_equals_expanded_first(events, table):
    located = tiles.assign_by_centre(summary.with_deltas(events), 18)
    naive = tiles.climb(located.select("row", "col", *COUNTS), 3, 18)
    assert same(table, naive.groupBy(*TILE).agg(*summary.sums()))


def test_single_zooms_agree_with_all_zooms(events, table):
    for zoom in (3, 7, 8, 13, 18):
        assert same(summary.summarize(events, zoom), table.filter(F.col("zoom") == zoom))


def test_counts_add_up(table):
    odd = "device_count <> happy_count + sad_count or happy_count < 0 or sad_count < 0"
    assert table.filter(odd).isEmpty()
    totals = {tuple(r) for r in table.groupBy("zoom").agg(*summary.sums()).drop("zoom").collect()}
    assert len(totals) == 1


def test_parents_are_the_sum_of_their_children(table):
    up = table.filter("zoom > 3").select(
        (F.col("zoom") - 1).alias("zoom"),
        grid.ancestor(F.col("row"), 1).alias("row"),
        grid.ancestor(F.col("col"), 1).alias("col"),
        *COUNTS,
    )
    assert same(up.groupBy(*TILE).agg(*summary.sums()), table.filter("zoom < 18"))


def test_shards_partition_the_whole(events):
    whole = summary.summarize(events, 12)
    for n in (1, 2, 4, 7):
        parts = [summary.summarize(events, 12, n, i) for i in range(n)]
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part)
        assert same(whole, union)


def test_devices_with_centre_off_the_map_are_left_out(spark):
    rect = "zoom int, top_left_lat double, top_left_lng double, bot_right_lat double, bot_right_lng double"
    df = spark.createDataFrame(
        [("DeviceActivated", 5, 99.0, 0.0, 95.0, 5.0), ("DeviceActivated", 5, 5.0, 0.0, 0.0, 5.0)],
        "event_type string, " + rect,
    )
    found = summary.summarize_all(df)
    assert found.count() == 16 and found.agg(F.sum("device_count")).head()[0] == 16


def test_fine_zooms_are_not_shuffled_after_expansion(spark):
    tiles18 = spark.createDataFrame([(5, 9, 1, 1, 0)], TILES.removeprefix("zoom int, "))
    text = summary.roll_up(tiles18)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in text.splitlines() if "Exchange hashpartitioning(" in line]
    by_tile = [line for line in shuffles if "hashpartitioning(zoom#" in line]
    assert len(by_tile) == 1 and len(shuffles) == 3  # by anchor; by zoom-7 tile; coarse zooms


def test_fill_equals_activating_every_device(spark):
    rng = random.Random(2)
    chosen = [(12, 900, 3000), (13, 1801, 6001), (12, 901, 3000), (14, 5, 9), (18, 81, 145)]
    chosen += [(15, rng.randrange(3000), rng.randrange(3000)) for _ in range(4)] + [chosen[0]]
    df = spark.createDataFrame(chosen, "zoom int, row int, col int")
    devices = tiles.expand_to_devices(df).distinct()
    activated = grid.with_edges(devices).withColumn("event_type", F.lit("DeviceActivated"))
    assert same(summary.fill_region(df), summary.summarize_all(activated))


def test_fill_at_zoom_12(spark):
    df = tiles.assign_tile(
        spark.createDataFrame([(48.85, 2.35)], "lat double, lng double"), zoom=12
    )
    per_zoom = {r.zoom: r for r in summary.per_zoom(summary.fill_region(df)).collect()}
    assert {r.device_total for r in per_zoom.values()} == {4096}
    assert [per_zoom[z].tile_total for z in range(3, 19)] == [1] * 10 + [4**n for n in range(1, 7)]


def test_viewport_equals_comparing_edges(table):
    rng = random.Random(4)
    areas = [Area(6, 90.0, -180.0, -90.0, 180.0), queries.VIEW, Area(5, 80.0, -160.0, 20.0, 40.0)]
    areas += [
        Area(rng.randrange(3, 9), rng.uniform(0, 90), rng.uniform(-180, 0), rng.uniform(-90, 0),
             rng.uniform(0, 180))
        for _ in range(5)
    ]
    placed = grid.with_edges(table).collect()
    for area in areas:
        got = {(r.row, r.col) for r in viewport.viewport(table, area).collect()}
        want = {
            (r.row, r.col)
            for r in placed
            if r.zoom == area.zoom
            and r.device_count > 0
            and r.top_left_lat <= area.top_left_lat
            and r.top_left_lng >= area.top_left_lng
            and r.bot_right_lat >= area.bot_right_lat
            and r.bot_right_lng <= area.bot_right_lng
        }
        assert got == want


def test_response_nests_all_tiles_in_bounded_pages(table):
    area = Area(8, 90.0, -180.0, -90.0, 180.0)
    pages = viewport.query_response(table, area).collect()
    listed = [s for p in pages for s in p.region_summaries]
    assert len(listed) == viewport.viewport(table, area).count() > 100
    assert all(len(p.region_summaries) <= 1024 for p in pages)
    totals = viewport.world_totals(table).head()
    assert {(p.device_count, p.happy_count, p.sad_count) for p in pages} == {tuple(totals)}


def test_response_of_an_empty_view(table):
    pages = viewport.query_response(table, Area(8, 0.2, 0.1, 0.1, 0.2)).collect()
    assert len(pages) == 1 and pages[0].region_summaries == [] and pages[0].device_count > 0


def test_totals_of_an_empty_table_are_zero(spark):
    empty = spark.createDataFrame([], TILES)
    assert tuple(viewport.world_totals(empty).head()) == (0, 0, 0)
    assert tuple(viewport.view_totals(empty, queries.VIEW).head()) == (0, 0, 0)


def test_lookup_by_union_keeps_duplicates(table):
    key = tuple(table.filter("zoom = 9").select(*TILE).head())
    assert viewport.lookup_tiles_or(table, [key, key]).count() == 1
    assert viewport.lookup_tiles_union(table, [key, key]).count() == 2


def test_mood_and_density(spark):
    rows = [(17, 0, 0, 2, 2, 0), (17, 0, 1, 1, 0, 1), (17, 0, 2, 4, 2, 2), (17, 0, 3, 0, 0, 0)]
    df = measures.with_density(measures.with_mood(spark.createDataFrame(rows, TILES)))
    got = [(r.mood, r.fill_ratio, r.partial) for r in df.orderBy("col").collect()]
    assert got == [
        ("happy", 0.5, False), ("sad", 0.25, True), ("mixed", 1.0, False), ("mixed", 0.0, True)
    ]


def test_selection_cost(spark):
    rows = [(12, 1000), (8, 100), (7, 1), (18, 2), (18, 3), (18, 0)]
    cost = measures.selection_cost(spark.createDataFrame(rows, "zoom int, rate int")).collect()
    assert [(r.device_total, r.duration_sec, r.allowed) for r in cost] == [
        (4096, 4, True),
        (1_048_576, 10_486, True),
        (4_194_304, 4_194_304, False),
        (1, 1, True),  # half a second rounds up
        (1, 0, True),
        (1, None, True),
    ]


def samples_model(rows, step, keep):
    """Sample the running totals every step, as a clock would."""
    first, last = min(t for t, _ in rows) // step, max(t for t, _ in rows) // step
    out, previous = [], None
    for s in range(first, last + 1):
        totals = tuple(sum(d[i] for t, d in rows if t // step <= s) for i in range(3))
        change = tuple(a - b for a, b in zip(totals, previous)) if previous else (0, 0, 0)
        out.append((s * step, *totals, *change))
        previous = totals
    return out[-keep:]


@pytest.mark.parametrize("keep, step", [(180, 5), (4, 5), (1, 1), (30, 1)])
def test_activity_samples(spark, keep, step):
    rng = random.Random(keep)
    names = list(summary.DELTAS)
    rows = [(1000 + rng.randrange(60), rng.choice(names)) for _ in range(40)]
    df = spark.createDataFrame(rows, "sec long, event_type string").withColumn(
        "ts", F.timestamp_seconds("sec")
    )
    got = [tuple(r) for r in activity.activity(df, step, keep).orderBy("sample_epoch").collect()]
    assert got == samples_model([(t, summary.DELTAS[e]) for t, e in rows], step, keep)


def test_axis_scale_has_at_most_ten_units(spark):
    def bound(delta, sign):
        unit = next(u for u in (sign * 10**n for n in range(1, 9)) if delta / u <= 10)
        return (math.floor(delta / unit) + 1) * unit

    values = [0, 1, 5, 9, 10, 11, 99, 100, 101, 110, 999, 1000, 1001, 9999, 10000, 10001, 123456]
    values += [-v for v in values]
    for low, high in [(min(a, b), max(a, b)) for a in values for b in values[::5]][::7]:
        df = spark.createDataFrame(
            [(low, high, 0), (low, low, high)], "device_delta long, happy_delta long, sad_delta long"
        )
        row = activity.activity_scale(df).head()
        low, high = min(low, 0, high), max(high, 0, low)
        assert (row.min_delta, row.max_delta) == (low, high)
        assert (row.scale_neg, row.scale_pos) == (bound(low, -1), bound(high, 1))


def test_filling_tiles_coarser_than_any_stored(spark):
    df = spark.createDataFrame([(2, 1, 4), (1, 0, 1)], "zoom int, row int, col int")
    filled = summary.fill_region(df).filter("zoom <= 4").collect()
    for zoom, side in ((3, 9), (4, 18)):  # zoom 1 is half the world; the other tile lies in it
        assert sum(r.zoom == zoom for r in filled) == side * side
    assert {r.device_count for r in filled if r.zoom == 3} == {4**15}
