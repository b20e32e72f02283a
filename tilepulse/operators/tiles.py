"""Points and rectangles to tiles, tiles to their relatives."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import grid
from ..functions.grid import COUNTS, MAX_ZOOM, MIN_SUMMARY_ZOOM, RECT


def _place(df: DataFrame, lat: Column, lng: Column, zoom: int) -> DataFrame:
    if zoom == 0:  # the world is returned without looking at the point
        return df.withColumns({"row": F.lit(0), "col": F.lit(0)})
    return grid.with_tile(df, lat, lng, zoom)


def assign_tile(
    df: DataFrame, lat: str = "lat", lng: str = "lng", zoom: int = MAX_ZOOM
) -> DataFrame:
    """Tile of every point; null row and col for points off the map."""
    return _place(df.withColumn("zoom", F.lit(zoom)), F.col(lat), F.col(lng), zoom)


def assign_all_zooms(df: DataFrame, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """One row per point and zoom 3..18. The point is placed once, at zoom 18;
    the other zooms are shifts of that. Points off the map have no rows."""
    there = df.filter(grid.on_map(F.col(lat), F.col(lng)))
    return climb(assign_tile(there, lat, lng), MIN_SUMMARY_ZOOM, MAX_ZOOM)


def climb(tiles: DataFrame, lowest: int, highest: int, at: int = MAX_ZOOM) -> DataFrame:
    """One row per input row and zoom ``lowest..highest``: the enclosing tiles of
    a ``(row, col)`` that lies at zoom ``at``."""
    kept = [c for c in tiles.columns if c not in grid.TILE]
    up = F.lit(at) - F.col("zoom")
    return tiles.withColumn("zoom", F.explode(F.sequence(F.lit(lowest), F.lit(highest)))).select(
        *kept,
        "zoom",
        grid.ancestor(F.col("row"), up).alias("row"),
        grid.ancestor(F.col("col"), up).alias("col"),
    )


def assign_by_centre(df: DataFrame, zoom: int = MAX_ZOOM) -> DataFrame:
    """Re-key rectangles by the tile of their centre: ``tile_zoom, row, col``."""
    keyed = df.withColumn("tile_zoom", F.lit(zoom))
    return _place(keyed, grid.centre_lat(), grid.centre_lng(), zoom)


def only_devices(df: DataFrame) -> DataFrame:
    """Rectangles at the finest zoom; a device is one of those."""
    return df.filter(F.col("zoom") == MAX_ZOOM)


def unroll(ranges: DataFrame) -> DataFrame:
    """Every ``(row, col)`` of the ranges ``r0..r1`` and ``c0..c1``, which may be
    empty. Rows come first, then an even shuffle, then columns: one large
    rectangle is thus worked on by many tasks, and no row holds more than a line
    of it. The partition count is given, as a count chosen by the size of the
    few narrow rows in between would be far too low.
    """

    # The bounds are columns of their own on purpose: where a generator refers to
    # a constant column, Spark 4.1's column pruning can drop a carried column once
    # a filter has been pushed below the generator.
    def line(first: str, last: str) -> Column:
        return F.explode(F.when(F.col(first) <= F.col(last), F.sequence(first, last)))

    partitions = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        ranges.withColumn("row", line("r0", "r1"))
        .drop("r0", "r1")
        .repartition(partitions)
        .withColumn("col", line("c0", "c1"))
        .drop("c0", "c1")
    )


def _below(tiles: DataFrame, down: Column, across: Column) -> DataFrame:
    """Replace each tile by the range it covers on a grid finer by two factors."""
    row, col = F.col("row"), F.col("col")
    ranges = {
        "r0": row * down,
        "r1": row * down + down - 1,
        "c0": col * across,
        "c1": col * across + across - 1,
    }
    return tiles.withColumns({k: v.cast("int") for k, v in ranges.items()}).drop("row", "col")


def expand_children(tiles: DataFrame) -> DataFrame:
    """Each tile's children one zoom down: 2 at zoom 0, 9 at zooms 1 and 2, 4
    from there on, none at zoom 18. Other columns are carried along."""
    zoom = F.col("zoom")
    down = F.when(zoom == 0, 1).when(zoom < 3, 3).otherwise(2)
    across = F.when(zoom == 0, 2).when(zoom < 3, 3).otherwise(2)
    parents = _below(tiles.filter(zoom < MAX_ZOOM), down, across)
    return (
        parents.withColumn("row", F.explode(F.sequence("r0", "r1")))
        .withColumn("col", F.explode(F.sequence("c0", "c1")))
        .withColumn("zoom", zoom + 1)
        .drop("r0", "r1", "c0", "c1")
    )


def expand_to_devices(tiles: DataFrame) -> DataFrame:
    """Each tile to all its zoom-18 tiles. Other columns are carried along."""
    zoom = F.col("zoom")
    down = (F.lit(grid.n_rows(MAX_ZOOM)) / grid.row_count(zoom)).cast("int")
    across = (F.lit(grid.n_cols(MAX_ZOOM)) / grid.col_count(zoom)).cast("int")
    devices = unroll(_below(tiles, down, across).drop("zoom"))
    return devices.withColumn("zoom", F.lit(MAX_ZOOM))


def cover_area(areas: DataFrame, zoom: int | None = None) -> DataFrame:
    """Every tile whose interior meets the area, at the area's own zoom or a
    given one, as ``tile_zoom, row, col`` next to the area's columns."""
    level = F.col("zoom") if zoom is None else F.lit(zoom)
    return unroll(grid.with_cover(areas.withColumn("tile_zoom", level), F.col("tile_zoom")))


def selection_commands(selections: DataFrame, order: str) -> DataFrame:
    """An area action as commands to every device in the area: the selected tiles
    (``zoom, row, col``) expanded, each device's command carrying the action and
    the value of the selection's ``order`` column as ``event_id``."""
    chosen = selections.select("action", F.col(order).cast("bigint").alias("event_id"), *grid.TILE)
    return grid.with_edges(expand_to_devices(chosen), MAX_ZOOM).select("event_id", "action", *RECT)


def traverse_selection(selections: DataFrame, zooms: Iterable[int]) -> DataFrame:
    """Per selection and zoom: the tiles it meets, whether it takes them whole
    (``full``) or not (``partial``), and the selection trimmed to the tile."""
    levels = F.explode(F.array(*[F.lit(z) for z in zooms]))
    levelled = selections.withColumn("tile_zoom", levels)
    tiles = unroll(grid.with_cover(levelled, F.col("tile_zoom")))
    top, left, bot, right = grid.edges(F.col("tile_zoom"), F.col("row"), F.col("col"))
    full = (
        (F.col("top_left_lat") >= top)
        & (F.col("bot_right_lat") <= bot)
        & (F.col("top_left_lng") <= left)
        & (F.col("bot_right_lng") >= right)
    )
    return tiles.select(
        "*",
        F.when(full, "full").otherwise("partial").alias("overlap"),
        F.least(F.col("top_left_lat"), top).alias("trim_top_lat"),
        F.greatest(F.col("top_left_lng"), left).alias("trim_left_lng"),
        F.greatest(F.col("bot_right_lat"), bot).alias("trim_bot_lat"),
        F.least(F.col("bot_right_lng"), right).alias("trim_right_lng"),
    )


def neighbours(tiles: DataFrame, direction: str) -> DataFrame:
    """Each tile with the counts of the tile to its ``right`` or ``below`` it,
    null where that tile has no row. One window instead of a self join; a
    window group is a line of tiles, at most 589,824 of them."""
    along, across = ("col", "row") if direction == "right" else ("row", "col")
    line = Window.partitionBy("zoom", across).orderBy(along)
    adjacent = F.lead(along).over(line) == F.col(along) + 1
    return tiles.select(
        "*", *[F.when(adjacent, F.lead(c).over(line)).alias("next_" + c) for c in COUNTS]
    )


def zoom_levels(spark: SparkSession) -> DataFrame:
    """Per zoom: tile size in degrees, tiles in the world, devices in a tile."""
    zoom = F.col("id").cast("int")
    rows, cols = grid.row_count(zoom).cast("bigint"), grid.col_count(zoom).cast("bigint")
    devices_on_map = grid.n_rows(MAX_ZOOM) * grid.n_cols(MAX_ZOOM)
    return spark.range(MAX_ZOOM + 1).select(
        zoom.alias("zoom"),
        grid.lat_size(zoom).alias("lat_degrees"),
        grid.lng_size(zoom).alias("lng_degrees"),
        (rows * cols).alias("tile_count"),
        (F.lit(devices_on_map) / (rows * cols)).cast("bigint").alias("max_devices"),
    )
