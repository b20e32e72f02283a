import random

from hypothesis import given, settings
from hypothesis import strategies as st
from models import descend, overlap, random_rect, ulp_neighbours
from pyspark.sql import functions as F

from tilepulse.functions import grid
from tilepulse.functions.keys import device_key, parse_key, shard_of, tag_of, text_hash
from tilepulse.operators import tiles

LONDON = (51.50079211, -0.11682093)


def edge_points():
    """Points on tile edges and one ulp beside them, corners of the map included."""
    rng = random.Random(5)
    lats = [90.0, -90.0, 0.0, 30.0, -30.0, 70.0]
    lngs = [180.0, -180.0, 0.0, 60.0, -60.0]
    for zoom in range(3, 19):
        size = 20 / 2 ** (zoom - 3)
        lats += [90 - rng.randrange(grid.n_rows(zoom)) * size for _ in range(3)]
        lngs += [-180 + rng.randrange(grid.n_cols(zoom)) * size for _ in range(3)]
    near_lats = [n for v in lats for n in ulp_neighbours(v)]
    near_lngs = [n for v in lngs for n in ulp_neighbours(v)]
    points = [(lat, rng.choice(near_lngs)) for lat in near_lats for _ in range(2)]
    points += [(rng.choice(near_lats), lng) for lng in near_lngs for _ in range(2)]
    points += [(rng.uniform(-95, 95), rng.uniform(-190, 190)) for _ in range(300)]
    return [*points, LONDON, (float("nan"), 0.0), (0.0, float("nan"))]


def check_points(spark, points):
    df = spark.createDataFrame(points, "lat double, lng double")
    for zoom in range(19):
        for row in tiles.assign_tile(df, zoom=zoom).collect():
            want = descend(zoom, row.lat, row.lng)
            assert (row.row, row.col) == (want or (None, None)), (zoom, row)


def test_point_lands_where_the_tree_walk_leads(spark):
    check_points(spark, edge_points())


@settings(max_examples=5, deadline=None)
@given(
    st.lists(
        st.tuples(st.floats(-90, 90, width=64), st.floats(-180, 180, width=64)),
        min_size=20,
        max_size=60,
    )
)
def test_random_points(spark, points):
    df = spark.createDataFrame(points, "lat double, lng double")
    for row in tiles.assign_all_zooms(df).collect():
        assert (row.row, row.col) == descend(row.zoom, row.lat, row.lng)


def test_sixteen_zooms_per_point_and_none_off_the_map(spark):
    df = spark.createDataFrame([LONDON, (91.0, 0.0)], "lat double, lng double")
    rows = tiles.assign_all_zooms(df).collect()
    assert sorted(r.zoom for r in rows) == list(range(3, 19))


def test_key_of_a_known_device_and_back(spark):
    df = spark.createDataFrame([LONDON], "lat double, lng double")
    placed = grid.with_edges(tiles.assign_tile(df)).withColumn("key", device_key())
    row = placed.select("*", F.struct(*parse_key(F.col("key"))).alias("back")).head()
    assert row.key == "18:51.5008544921875:-0.1171875000000:51.5002441406250:-0.1165771484375"
    assert [row.back[c] for c in grid.RECT] == [row[c] for c in grid.RECT]


def test_negative_zero_has_the_key_of_zero(spark):
    df = spark.createDataFrame([(18, 1.0, -0.0, -0.0, 1.0)], grid_schema())
    assert "-0." not in df.select(device_key()).head()[0]


def grid_schema():
    return "zoom int, top_left_lat double, top_left_lng double, bot_right_lat double, bot_right_lng double"


def test_hash_tags_and_shards(spark):
    def model(text):
        h = 0
        for ch in text:
            h = (h * 31 + ord(ch)) & 0xFFFFFFFF
        return h - (1 << 32) if h >> 31 else h

    texts = ["", "a", "polygenelubricants", *[f"18:{i}.5:{-i}.25" for i in range(200)]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    key = F.col("t")
    rows = df.select("t", text_hash(key), tag_of(key, 7), tag_of(key, 1), shard_of(key, 4)).collect()
    assert model("polygenelubricants") == -(1 << 31)
    for text, h, tag, only, shard in rows:
        assert h == model(text) and tag == str(abs(h) % 7) and only == "0" and shard == h % 4


def test_children_tile_their_parent(spark):
    coarse = spark.createDataFrame([(0, 0, 0)], "zoom int, row int, col int")
    level = coarse
    for zoom in range(1, 6):
        level = tiles.expand_children(level)
        cells = {(r.row, r.col) for r in level.collect()}
        assert len(cells) == grid.n_rows(zoom) * grid.n_cols(zoom) == level.count()
    finest = spark.createDataFrame([(18, 5, 7)], "zoom int, row int, col int")
    assert tiles.expand_children(finest).count() == 0


def test_devices_of_a_tile(spark):
    chosen = spark.createDataFrame([(12, 800, 3000), (18, 1, 2)], "zoom int, row int, col int")
    devices = tiles.expand_to_devices(chosen)
    up = tiles.climb(devices, 12, 12).groupBy("row", "col").count().collect()
    assert {(r.row, r.col): r["count"] for r in up} == {(800, 3000): 4096, (0, 0): 1}


def test_world_expands_to_every_device(spark):
    """Counted by their rows, without making all of them."""
    total = tiles.zoom_levels(spark).filter("zoom = 18").head().tile_count
    assert total == 173_946_175_488 == 294_912 * 589_824


def brute_cover(zoom, rect):
    size_lat, size_lng = 180 / grid.n_rows(zoom), 360 / grid.n_cols(zoom)
    return {
        (r, c)
        for r in range(grid.n_rows(zoom))
        for c in range(grid.n_cols(zoom))
        if overlap(
            rect,
            (
                90 - r * size_lat,
                -180 + c * size_lng,
                90 - (r + 1) * size_lat,
                -180 + (c + 1) * size_lng,
            ),
        )
    }


def test_cover_equals_brute_force(spark):
    rng = random.Random(11)
    rects = [random_rect(rng, 30) for _ in range(25)]
    rects += [(80.0, -160.0, 60.0, -140.0), (90.0, -180.0, -90.0, 180.0), (85.0, -165.0, 60.0, 1.0)]
    near = [n for v in (80.0, 60.0) for n in ulp_neighbours(v)]
    rects += [(t, -160.0, b, -140.0) for t in near for b in near if t > b]
    rows = [(i, z, *r) for i, r in enumerate(rects) for z in (0, 1, 2, 3, 5)]
    covered = tiles.cover_area(spark.createDataFrame(rows, "id int, " + grid_schema()))
    got = {}
    for row in covered.collect():
        got.setdefault((row.id, row.zoom), []).append((row.row, row.col))
    for i, z, *rect in rows:
        found = got.get((i, z), [])
        assert len(found) == len(set(found)) and set(found) == brute_cover(z, rect), (z, rect)


def test_cover_of_a_wide_area(spark):
    area = [(5, 85.24439622732126, -168.04687500000003, -85.24439622732126, 167.87109375000003)]
    assert tiles.cover_area(spark.createDataFrame(area, grid_schema())).count() == 2448


def test_cover_rows_and_columns_inside_a_viewport():
    for zoom in (3, 8, 12):
        size = 20 / 2 ** (zoom - 3)
        for top, bot in [(47.4, 47.0), (80.0, 60.0), (90.0, -90.0), (10.1, 10.0)]:
            lo, hi = grid.rows_inside(zoom, top, bot)
            want = [
                r
                for r in range(grid.n_rows(zoom))
                if 90 - r * size <= top and 90 - (r + 1) * size >= bot
            ]
            assert list(range(max(lo, 0), hi + 1)) == want


def test_selection_traversal_marks_full_and_trims(spark):
    area = spark.createDataFrame([(8, 75.0, -165.0, 45.0, -140.0)], grid_schema())
    steps = tiles.traverse_selection(area, [3, 4]).collect()
    at3 = {(r.row, r.col): r for r in steps if r.tile_zoom == 3}
    assert set(at3) == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1)}
    assert at3[(1, 1)].overlap == "full" and at3[(1, 0)].overlap == "partial"
    corner = at3[(0, 0)]
    assert (corner.trim_top_lat, corner.trim_left_lng) == (75.0, -165.0)
    assert (corner.trim_bot_lat, corner.trim_right_lng) == (70.0, -160.0)


def test_neighbours(spark):
    table = spark.createDataFrame(
        [(5, 1, 1, 4, 3, 1), (5, 1, 2, 2, 2, 0), (5, 2, 1, 9, 9, 0), (5, 1, 4, 1, 1, 0)],
        "zoom int, row int, col int, device_count long, happy_count long, sad_count long",
    )

    def found(direction):
        rows = tiles.neighbours(table, direction).collect()
        return {(r.row, r.col): r.next_device_count for r in rows}

    assert found("right") == {(1, 1): 2, (1, 2): None, (2, 1): None, (1, 4): None}
    assert found("below") == {(1, 1): 9, (1, 2): None, (2, 1): None, (1, 4): None}
