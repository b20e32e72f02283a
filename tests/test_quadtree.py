import random

import pytest
from models import random_rect
from pyspark.sql import functions as F

from tilepulse.functions import grid, quad
from tilepulse.operators import quadtree, tiles

SIDES = "id int, top_left_lat double, top_left_lng double, bot_right_lat double, bot_right_lng double"
INF, NAN = float("inf"), float("nan")
EDGES = ["top_left_lat", "top_left_lng", "bot_right_lat", "bot_right_lng"]


def table(spark, rects):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rects)], SIDES)


def nodes(tree):
    return {(r[0], r[1], r[2], r[3], r[4]) for r in tree.select(
        "selection.id", "tile_zoom", "row", "col", "overlap").collect()}


def test_key_is_the_path_from_the_world(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(grid.n_rows(18)), rng.randrange(grid.n_cols(18))) for _ in range(300)]
    rows += [(0, 0), (grid.n_rows(18) - 1, grid.n_cols(18) - 1)]
    cells = spark.createDataFrame(rows, "row int, col int")
    key = quad.device_number(F.col("row"), F.col("col"))
    for row, col, found, r, c in cells.select("row", "col", key, *quad.device_of(key)).collect():
        assert (r, c) == (row, col)
        want, at = 0, (0, 0)
        for z in range(1, 19):
            size = grid.n_rows(18) // grid.n_rows(z), grid.n_cols(18) // grid.n_cols(z)
            here = row // size[0], col // size[1]
            down, across = {1: (1, 2), 2: (3, 3), 3: (3, 3)}.get(z, (2, 2))
            child = (here[0] - at[0] * down) * across + here[1] - at[1] * across
            want, at = want * down * across + child, here
        assert found == want


def test_a_tile_has_the_keys_of_its_children(spark):
    for zoom in (0, 1, 2, 3, 9, 17):
        at = spark.createDataFrame([(zoom, 0, 0), (zoom, grid.n_rows(zoom) - 1, grid.n_cols(zoom) - 1)],
                                   "zoom int, row int, col int").distinct()
        parts = quad.with_keys(tiles.expand_children(quad.with_keys(at).withColumnsRenamed(
            {"first_key": "first", "last_key": "last"})))
        for first, last in {tuple(r) for r in parts.select("first", "last").collect()}:
            mine = sorted(tuple(r) for r in parts.filter(F.col("first") == first).select(
                "first_key", "last_key").collect())
            assert (mine[0][0], mine[-1][1]) == (first, last)
            assert all(a[1] + 1 == b[0] for a, b in zip(mine, mine[1:]))


@pytest.mark.parametrize("zoom", [4, 7])
def test_expands_to_the_traversal(spark, zoom):
    rng = random.Random(zoom)
    rects = [random_rect(rng, 40.0) for _ in range(40)] + [(0.1, 0.1, -0.1, -0.1), (5.0, 3.0, 4.9, 100.0),
             (90.0, -180.0, -90.0, 180.0), (20.0, -20.0, -20.0, 40.0), (89.0, -179.0, -89.0, 1.0)]
    chosen = table(spark, [tuple(map(float, r)) for r in rects])
    tree = quadtree.cover_tree(chosen, zoom)
    shown = quadtree.expand_tree(tree, zoom).select("selection.id", "row", "col", "overlap")
    want = tiles.traverse_selection(chosen, [zoom]).select("id", "row", "col", "overlap")
    assert sorted(map(tuple, shown.collect())) == sorted(map(tuple, want.collect()))
    # None of the tiles could be replaced by a larger one.
    found = nodes(tree)
    whole = {(i, z, r, c) for i, z, r, c, o in found if o == "full"}
    up = tiles.traverse_selection(chosen, range(zoom)).filter("overlap = 'full'")
    larger = {tuple(r) for r in up.select("id", "tile_zoom", "row", "col").collect()}
    for i, z, r, c in whole:
        if z:
            down, across = {1: (1, 2), 2: (3, 3), 3: (3, 3)}.get(z, (2, 2))
            assert (i, z - 1, r // down, c // across) not in larger


def test_odd_selections(spark):
    rects = [(INF, -INF, -INF, INF), (95.0, 0.0, 92.0, 10.0), (None, 0.0, -1.0, 10.0),
             (NAN, 0.0, -1.0, 10.0), (1.0, 5.0, 1.0, 6.0), (1.0, 6.0, 0.0, 5.0)]
    odd = table(spark, rects).withColumn("row", F.lit("mine")).withColumn("tile_zoom", F.lit(-1))
    tree = quadtree.cover_tree(odd.unionAll(odd), 18)
    assert nodes(tree) == {(0, 0, 0, 0, "full")}
    assert [r.selection.row for r in tree.collect()] == ["mine", "mine"]  # repeated rows stay
    assert quadtree.cover_tree(odd.limit(0), 18).count() == 0
    with pytest.raises(ValueError):
        quadtree.cover_tree(odd, 19)


def test_size_follows_the_edge(spark):
    half = table(spark, [(89.9, -179.9, -89.9, 0.1)])
    sizes = [quadtree.cover_tree(half, z).count() for z in (10, 12, 14)]
    assert all(b < 4.3 * a for a, b in zip(sizes, sizes[1:]))  # two zooms: edge x4, area x16
    assert quadtree.cover_tree(table(spark, [(90.0, -180.0, -90.0, 0.0)])).count() == 1
    tree = quadtree.cover_tree(half, 12)
    keys = sorted(tuple(r) for r in tree.select("first_key", "last_key").collect())
    assert all(a[1] < b[0] for a, b in zip(keys, keys[1:]))


@pytest.mark.parametrize("rows", [0, 1_000_000])
@pytest.mark.parametrize("edge_zoom", [3, 8, 18])
def test_totals_equal_all_pairs(spark, rows, edge_zoom):
    rng = random.Random(7)
    devices = [(rng.randrange(grid.n_rows(18)), rng.randrange(grid.n_cols(18)), 1, i % 2, 1 - i % 2)
               for i in range(300)]
    # Many on one tile, whose neighbours a selection's edge runs along.
    row, col = 100_000, 300_000
    devices += [(row + i, col, 1, 1, 0) for i in range(50)]
    counts = "device_count bigint, happy_count bigint, sad_count bigint"
    at_18 = spark.createDataFrame(devices, "row int, col int, " + counts)
    table_ = tiles.climb(at_18, 3, 18).groupBy("zoom", "row", "col").agg(
        *[F.sum(c).alias(c) for c in grid.COUNTS])
    size = 20 / 32768
    line = 90 - (row + 20) * size
    wide = 30 if edge_zoom < 18 else 0.5  # the tree of a wide area to zoom 18 is large
    rects = [(line + size / 2, col * size - 180, line - wide, col * size - 180 + wide),
             (line, col * size - 180 - wide, line - 0.3, col * size - 180), (line, 1.0, line, 2.0)]
    if edge_zoom < 18:
        rects += [tuple(map(float, random_rect(rng, 40.0))) for _ in range(10)]
    chosen = table(spark, rects)
    got = quadtree.selection_totals(table_, chosen, "id", edge_zoom, rows)
    seen = {r.id: (r.device_count, r.happy_count, r.sad_count) for r in got.collect()}
    want = {}
    for i, (top, left, bot, right) in enumerate(rects):
        if top <= bot or right <= left:
            continue
        hit = [d[2:] for d in devices if 90 - d[0] * size > bot and 90 - (d[0] + 1) * size < top
               and d[1] * size - 180 < right and (d[1] + 1) * size - 180 > left]
        if hit:
            want[i] = tuple(map(sum, zip(*hit)))
    assert seen == want and 0 in want


def test_no_node_of_a_large_tree_is_made(spark, monkeypatch):
    """What is written beside the tile table follows the selections, not their edges."""
    rng = random.Random(8)
    chosen = table(spark, [(60.1 - i / 7, -70.3 + i, -3.3 - i / 5, 50.7 + i) for i in range(20)])
    at_18 = spark.createDataFrame(
        [(rng.randrange(grid.n_rows(18)), rng.randrange(grid.n_cols(18))) for _ in range(200)],
        "row int, col int").select("*", *[F.lit(1).cast("bigint").alias(c) for c in grid.COUNTS])
    stored, rows = tiles.climb(at_18, 3, 18), []

    def counted(df, name):
        out = written(df, name)
        rows.append(out.count())
        return out

    written = quadtree.written
    monkeypatch.setattr(quadtree, "written", counted)
    got = quadtree.selection_totals(stored, chosen, "id", 10, 0)
    assert got.count() == 20 and sum(rows) <= 20


@pytest.mark.parametrize("edge_zoom", [3, 11, 12, 17])
def test_runs_give_what_nodes_give(spark, edge_zoom):
    """Also for repeated and null keys, repeated tiles, null counts, devices all gone, thin
    selections and such with edges on the grid."""
    size, rng = 20 / 32768, random.Random(edge_zoom)
    near = [(147_400 + rng.randrange(500), 294_900 + rng.randrange(500)) for _ in range(400)]
    far = [(rng.randrange(grid.n_rows(18)), rng.randrange(grid.n_cols(18))) for _ in range(400)]
    counts = "device_count bigint, happy_count bigint, sad_count bigint"
    devices = [(*place, i % 3, (i % 3) if i % 4 else None, None if i % 5 else 0)
               for i, place in enumerate([*near, *near[:40], *far])]
    at_18 = spark.createDataFrame([*devices, (1000, 1000, 0, 0, None)], "row int, col int, " + counts)
    stored = tiles.climb(at_18, 3, 18)
    lost = [(None, 1, 1, 1, 1, 1), (18, None, 1, 1, 1, 1), (18, 1, None, 1, 1, 1)]
    stored = stored.unionByName(spark.createDataFrame(lost, "zoom int, row int, col int, " + counts))
    rects = []
    for _ in range(60):  # from a part of a device to some hundred devices wide, at a corner of many tiles
        top, left = 147_456 + rng.randrange(-400, 400), 294_912 + rng.randrange(-400, 400)
        high, wide = rng.choice([0.4, 1, 3, 90, 260]), rng.choice([0.4, 1, 3, 90, 260])
        off = rng.choice([0, 0.3])
        rects.append((90 - (top + off) * size, (left + off) * size - 180,
                      90 - (top + off + high) * size, (left + off + wide) * size - 180))
    if edge_zoom < 17:  # lines around the world, and all of it
        rects += [(0.3, -181.0, 0.3 - size, 179.9), (INF, 0.2, -INF, 0.2 + 2 * size), (INF, -INF, -INF, INF)]
    chosen = table(spark, rects).withColumn("id", F.when(F.col("id") % 7 > 0, F.col("id") % 50))
    alone = table(spark, [(90 - 1000 * size, 1000 * size - 180, 90 - 1001 * size, 1001 * size - 180)])
    chosen = chosen.unionAll(chosen.limit(5)).unionAll(alone.withColumn("id", F.lit(99)))
    found = [quadtree.selection_totals(stored, chosen, "id", edge_zoom, most) for most in (0, 10_000_000)]
    assert found[0].dtypes == found[1].dtypes
    runs, nodes_ = ({r.id: tuple(r) for r in f.collect()} for f in found)
    assert runs == nodes_ and None in runs and len(runs) < 52
    assert runs[99] == (99, 0, 0, None)
