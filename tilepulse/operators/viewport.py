"""Questions asked of the tile table."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grid
from ..functions.grid import COUNTS, MIN_SUMMARY_ZOOM
from .joins import contains_join, overlap_join
from .summary import sums

# Levels between a page of a query response and its tiles: 4**5 = 1,024 at most.
PAGE_DEPTH = 5


class Area(NamedTuple):
    """A rectangle and the zoom of the tiles asked for."""

    zoom: int
    top_left_lat: float
    top_left_lng: float
    bot_right_lat: float
    bot_right_lng: float


def map_area(map_zoom: int, top: float, left: float, bot: float, right: float) -> Area:
    """What a map at some zoom asks for: tiles two levels finer than it shows."""
    return Area(min(grid.MAX_ZOOM, map_zoom + 2), top, left, bot, right)


def non_empty(tiles: DataFrame) -> DataFrame:
    """Upserts never delete: a tile whose devices are gone stays, at zero."""
    return tiles.filter("device_count > 0")


def viewport(tiles: DataFrame, area: Area) -> DataFrame:
    """Non-empty tiles of the area's zoom lying fully inside it. The rectangle is
    turned into row and column ranges, which prune partitions and row groups."""
    zoom, top, left, bot, right = area
    return non_empty(
        tiles.filter(
            (F.col("zoom") == zoom)
            & F.col("row").between(*grid.rows_inside(zoom, top, bot))
            & F.col("col").between(*grid.cols_inside(zoom, left, right))
        )
    )


def viewports(tiles: DataFrame, areas: DataFrame) -> DataFrame:
    """The same for a table of areas: structs ``area`` and ``tile``. The zooms
    asked for, nineteen at most, are looked up first: they prune the table."""
    zooms = [row[0] for row in areas.select("zoom").distinct().collect()]
    placed = grid.with_edges(non_empty(tiles.filter(F.col("zoom").isin(zooms))))
    return contains_join(areas, placed, ("area", "tile")).filter("area.zoom = tile.zoom")


def lookup_tiles_or(tiles: DataFrame, keys: list[tuple[int, int, int]]) -> DataFrame:
    """Tiles named one by one, as one scan with a disjunction."""
    return tiles.filter(reduce(lambda a, b: a | b, [_is(key) for key in keys]))


def lookup_tiles_union(tiles: DataFrame, keys: list[tuple[int, int, int]]) -> DataFrame:
    """The same as a union of lookups: a key given twice comes back twice."""
    return reduce(DataFrame.unionAll, [tiles.filter(_is(key)) for key in keys])


def _is(key: tuple[int, int, int]):
    zoom, row, col = key
    return (F.col("zoom") == zoom) & (F.col("row") == row) & (F.col("col") == col)


def world_totals(tiles: DataFrame) -> DataFrame:
    """Totals over the coarsest stored zoom: 162 rows at most; zeros if empty."""
    return tiles.filter(F.col("zoom") == MIN_SUMMARY_ZOOM).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]
    )


def view_totals(tiles: DataFrame, area: Area) -> DataFrame:
    """Totals over what the viewport shows."""
    return viewport(tiles, area).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS])


def counts_in_cell(tiles: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """Per cell (a rectangle with a ``key``): totals of the tiles it overlaps."""
    pairs = overlap_join(cells, grid.with_edges(tiles), ("cell", "tile"))
    return (
        pairs.select(F.col(f"cell.{key}").alias(key), *[F.col(f"tile.{c}") for c in COUNTS])
        .groupBy(key)
        .agg(*sums())
    )


def query_response(tiles: DataFrame, area: Area) -> DataFrame:
    """The answer to a map query: world totals with the viewport's tiles nested.

    It comes in pages, one row per block of at most 1,024 tiles, so that no row
    grows with the area asked for; every page carries the totals. A viewport
    without tiles gives one page with an empty list.
    """
    up = min(PAGE_DEPTH, max(area.zoom - MIN_SUMMARY_ZOOM, 0))
    summary = F.struct(*grid.RECT, *COUNTS)
    shown = grid.with_edges(viewport(tiles, area)).select(
        grid.ancestor(F.col("row"), up).alias("page_row"),
        grid.ancestor(F.col("col"), up).alias("page_col"),
        summary.alias("summary"),
    )
    row, _ = grid.rows_inside(area.zoom, area.top_left_lat, area.bot_right_lat)
    col, _ = grid.cols_inside(area.zoom, area.top_left_lng, area.bot_right_lng)
    empty = shown.limit(1).agg(F.count("*")).scalar() == 0
    first = tiles.sparkSession.range(1).filter(empty).select(
        F.lit(max(row, 0) >> up).alias("page_row"),
        F.lit(max(col, 0) >> up).alias("page_col"),
        F.lit(None).cast(shown.schema["summary"].dataType).alias("summary"),
    )
    pages = (
        shown.unionByName(first)
        .groupBy("page_row", "page_col")
        .agg(F.sort_array(F.collect_list("summary")).alias("region_summaries"))
    )
    totals = world_totals(tiles).select(F.struct(*COUNTS)).scalar()
    return pages.withColumn("totals", totals).select(
        "page_row", "page_col", *[F.col(f"totals.{c}") for c in COUNTS], "region_summaries"
    )
