"""Events to signed counts, counts to tiles, tiles to coarser tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grid
from ..functions.grid import COUNTS, MAX_ZOOM, MIN_SUMMARY_ZOOM, TILE
from ..functions.keys import device_key, shard_of, tag_of
from .tiles import assign_by_centre, climb, unroll

# Event -> change of device, happy and sad count.
DELTAS = {
    "DeviceActivated": (1, 1, 0),
    "DeviceDeactivatedHappy": (-1, -1, 0),
    "DeviceDeactivatedSad": (-1, 0, -1),
    "DeviceMadeHappy": (0, 1, -1),
    "DeviceMadeSad": (0, -1, 1),
}

# A zoom-8 tile has at most 4**10 = 1,048,576 zoom-18 tiles: the bound on what
# one task holds when tiles are grouped under their zoom-8 ancestor.
ANCHOR_ZOOM = 8


def sums(names: list[str] = COUNTS) -> list[Column]:
    return [F.sum(name).alias(name) for name in names]


def with_deltas(events: DataFrame) -> DataFrame:
    """Add the three signed counts. Unknown events (a ping, say) count nothing."""
    event = F.col("event_type")

    def delta(i: int) -> Column:
        up = [name for name, d in DELTAS.items() if d[i] == 1]
        down = [name for name, d in DELTAS.items() if d[i] == -1]
        return F.when(event.isin(up), 1).when(event.isin(down), -1).otherwise(0).cast("bigint")

    return events.select("*", *[delta(i).alias(name) for i, name in enumerate(COUNTS)])


def summarize(
    events: DataFrame, zoom: int, shards: int | None = None, shard: int | None = None
) -> DataFrame:
    """Counts per tile at one zoom; with ``shards``, only the tiles of one shard.
    The hash aggregate combines on the map side, so a hot tile is no hot task.
    A rectangle whose centre is off the map has no tile and is left out."""
    there = events.filter(grid.on_map(grid.centre_lat(), grid.centre_lng()))
    tiles = (
        assign_by_centre(with_deltas(there), zoom)
        .groupBy(F.col("tile_zoom").alias("zoom"), "row", "col")
        .agg(*sums())
    )
    if shards is None:
        return tiles
    return with_shard(tiles, shards).filter(F.col("shard") == shard).drop("shard")


def with_shard(tiles: DataFrame, shards: int) -> DataFrame:
    """Add the shard of every tile, from its key. Hashing follows aggregation."""
    return (
        grid.with_edges(tiles)
        .withColumn("shard", shard_of(device_key(), shards))
        .select(*tiles.columns, "shard")
    )


def summarize_all(events: DataFrame) -> DataFrame:
    """Counts per tile at zooms 3..18: aggregated at zoom 18, then rolled up."""
    return roll_up(summarize(events, MAX_ZOOM))


def roll_up(tiles18: DataFrame) -> DataFrame:
    """All zooms from zoom-18 counts.

    The zoom-18 rows are shuffled once, by their zoom-8 ancestor. Every tile of
    zooms 8..18 then lies in one partition, so the sixteen-fold expansion is
    aggregated where it stands and is never shuffled. The coarse zooms come from
    the zoom-7 counts, of which the whole map has 41,472.
    """
    anchored = tiles18.select(
        *_up(MAX_ZOOM - ANCHOR_ZOOM, "anchor_row", "anchor_col"), "row", "col", *COUNTS
    ).repartition("anchor_row", "anchor_col")
    fine = (
        climb(anchored, ANCHOR_ZOOM, MAX_ZOOM)
        .groupBy("anchor_row", "anchor_col", *TILE)
        .agg(*sums())
        .select(*TILE, *COUNTS)
    )
    below = ANCHOR_ZOOM - 1
    coarsest = (
        tiles18.select(*_up(MAX_ZOOM - below, "row", "col"), *COUNTS)
        .groupBy("row", "col")
        .agg(*sums())
    )
    coarse = climb(coarsest, MIN_SUMMARY_ZOOM, below, at=below).groupBy(*TILE).agg(*sums())
    return fine.unionByName(coarse)


def _up(levels: int, row: str, col: str) -> list[Column]:
    return [
        grid.ancestor(F.col("row"), levels).alias(row),
        grid.ancestor(F.col("col"), levels).alias(col),
    ]


def device_key_counts(df: DataFrame) -> DataFrame:
    """Rows per device key. Counted per rectangle first, so that a key is made
    once per device, not once per row."""
    rectangles = df.groupBy(*grid.RECT).agg(F.count("*").alias("n"))
    keyed = rectangles.select(device_key().alias("device_key"), "n")
    return keyed.groupBy("device_key").agg(F.sum("n").alias("command_count"))


def assign_tag(events: DataFrame, tag_count: int) -> DataFrame:
    """Add the event's tag, a hash of its device key."""
    return events.withColumn("tag", tag_of(device_key(), tag_count))


def tag_histogram(devices: DataFrame, tag_count: int) -> DataFrame:
    """Devices per tag, all tags listed."""
    used = assign_tag(devices, tag_count).groupBy("tag").agg(F.count("*").alias("device_total"))
    listed = devices.sparkSession.range(tag_count).select(F.col("id").cast("string").alias("tag"))
    return listed.join(used, "tag", "left").fillna(0, ["device_total"])


def per_zoom(tiles: DataFrame) -> DataFrame:
    """Tiles and devices per zoom."""
    return tiles.groupBy("zoom").agg(
        F.count("*").alias("tile_total"), F.sum("device_count").alias("device_total")
    )


def fill_region(tiles: DataFrame) -> DataFrame:
    """Counts at all zooms after activating every device in the given tiles
    (a tile inside another one adds nothing).

    A filled tile's descendants are all full, so their counts need no devices to
    be made and summed: only the ancestors are aggregated.
    """
    distinct = _stored_zooms(tiles.select(*TILE)).distinct()
    zoom, up_zoom = F.col("zoom"), F.col("up_zoom")
    levels = F.explode(F.sequence(F.lit(MIN_SUMMARY_ZOOM), F.lit(MAX_ZOOM - 1)))
    above = (
        distinct.withColumn("up_zoom", levels)
        .filter(up_zoom < zoom)
        .select(
            *TILE,
            "up_zoom",
            grid.ancestor(F.col("row"), zoom - up_zoom).alias("up_row"),
            grid.ancestor(F.col("col"), zoom - up_zoom).alias("up_col"),
        )
    )
    ups = [F.col(f"up_{name}").alias(name) for name in TILE]
    up_tile = ["up_" + c for c in TILE]
    chosen = distinct.select(*[F.col(c).alias("up_" + c) for c in TILE])
    nested = above.join(chosen, up_tile, "left_semi").select(*TILE)
    roots = distinct.join(nested, TILE, "left_anti")
    full = F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), ((F.lit(MAX_ZOOM) - F.col("zoom")) * 2).cast("int")
    )
    ancestors = (
        above.join(nested, TILE, "left_anti")
        .select(*ups, full.alias("devices"))
        .groupBy(*TILE)
        .agg(F.sum("devices").alias("devices"))
    )
    below = _descendants(roots).withColumn("devices", full)
    return ancestors.unionByName(below).select(
        *TILE,
        F.col("devices").alias("device_count"),
        F.col("devices").alias("happy_count"),
        F.lit(0).cast("bigint").alias("sad_count"),
    )


def _stored_zooms(tiles: DataFrame) -> DataFrame:
    """Tiles coarser than any stored zoom as the tiles of that zoom: 162 at most."""
    zoom = F.col("zoom")

    def spread(index: str, count) -> Column:
        fan = (F.lit(count(MIN_SUMMARY_ZOOM)) / count(zoom)).cast("int")
        return F.explode(F.sequence(F.col(index) * fan, F.col(index) * fan + fan - 1))

    coarse = tiles.filter(zoom < MIN_SUMMARY_ZOOM)
    rows = coarse.withColumn("row", spread("row", _rows_at))
    finer = rows.withColumn("col", spread("col", _cols_at))
    finer = finer.withColumn("zoom", F.lit(MIN_SUMMARY_ZOOM))
    return tiles.filter(zoom >= MIN_SUMMARY_ZOOM).unionByName(finer)


def _rows_at(zoom: int | Column) -> int | Column:
    return grid.n_rows(zoom) if isinstance(zoom, int) else grid.row_count(zoom)


def _cols_at(zoom: int | Column) -> int | Column:
    return grid.n_cols(zoom) if isinstance(zoom, int) else grid.col_count(zoom)


def _descendants(roots: DataFrame) -> DataFrame:
    """The tiles themselves and everything below them, zoom by zoom."""
    levels = F.explode(F.sequence(F.lit(MIN_SUMMARY_ZOOM), F.lit(MAX_ZOOM)))

    def first(index: str, offset: int) -> Column:
        depth = F.col("zoom") - F.col("root_zoom")
        return F.call_function("shiftleft", F.col(index) + offset, depth)

    return unroll(
        roots.withColumnsRenamed({"zoom": "root_zoom", "row": "root_row", "col": "root_col"})
        .withColumn("zoom", levels)
        .filter(F.col("zoom") >= F.col("root_zoom"))
        .select(
            "zoom",
            first("root_row", 0).alias("r0"),
            (first("root_row", 1) - 1).alias("r1"),
            first("root_col", 0).alias("c0"),
            (first("root_col", 1) - 1).alias("c1"),
        )
    )
