"""Arithmetic on the world tile grid, as Catalyst expressions.

The grid has zoom levels 0..18. A tile is the triple ``(zoom, row, col)``; row 0
is the northernmost, col 0 the westernmost. Every edge from zoom 3 down is a
multiple of 5 * 2**-13 degrees and therefore an exact double, so edges are
compared without tolerance. A point on a shared edge belongs to the tile north
or west of it.

Functions take a zoom as a Python int (the sizes become literals) or as an
integer column.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the grid: levels, first summarised level, tiles per axis at
# zooms 0..3. Every level after 3 doubles both axes.
MAX_ZOOM = 18
MIN_SUMMARY_ZOOM = 3
ROWS_BELOW_4 = (1, 1, 3, 9)
COLS_BELOW_4 = (1, 2, 6, 18)

RECT = ["zoom", "top_left_lat", "top_left_lng", "bot_right_lat", "bot_right_lng"]
# The same as a key to sort by: first what tells devices apart.
DEVICE = [*RECT[1:], "zoom"]
TILE = ["zoom", "row", "col"]
COUNTS = ["device_count", "happy_count", "sad_count"]


def n_rows(zoom: int) -> int:
    return ROWS_BELOW_4[zoom] if zoom < 4 else 9 << (zoom - 3)


def n_cols(zoom: int) -> int:
    return COLS_BELOW_4[zoom] if zoom < 4 else 18 << (zoom - 3)


def _per_zoom(zoom, value) -> Column:
    """``value(zoom)`` as a literal, or looked up for a column of zooms."""
    if isinstance(zoom, int):
        return F.lit(value(zoom))
    values = [value(z) for z in range(MAX_ZOOM + 1)]
    suffix = "D" if isinstance(values[0], float) else ""
    listed = ", ".join(f"{v!r}{suffix}" for v in values)
    return F.get(F.expr(f"array({listed})"), zoom)


def row_count(zoom) -> Column:
    return _per_zoom(zoom, n_rows)


def col_count(zoom) -> Column:
    return _per_zoom(zoom, n_cols)


def lat_size(zoom) -> Column:
    return _per_zoom(zoom, lambda z: 180.0 / n_rows(z))


def lng_size(zoom) -> Column:
    return _per_zoom(zoom, lambda z: 360.0 / n_cols(z))


def on_map(lat: Column, lng: Column) -> Column:
    return lat.between(-90.0, 90.0) & lng.between(-180.0, 180.0)


def with_tile(df: DataFrame, lat: Column, lng: Column, zoom) -> DataFrame:
    """Add ``row, col`` of a point; null off the map.

    Division rounds, so the quotient may be one off next to an edge; a second
    projection lets the edge itself decide.
    """
    height, width = lat_size(zoom), lng_size(zoom)
    top, left = F.lit(90.0), F.lit(-180.0)
    at_lat, at_lng, row, col = [F.col(c) for c in ("_lat", "_lng", "_row", "_col")]
    guessed = df.withColumns({"_lat": lat, "_lng": lng}).withColumns(
        {
            "_row": F.greatest(F.ceil((top - at_lat) / height) - 1, F.lit(0)),
            "_col": F.greatest(F.ceil((at_lng - left) / width) - 1, F.lit(0)),
        }
    )
    south = at_lat < top - (row + 1) * height
    north = (row > 0) & (at_lat >= top - row * height)
    east = at_lng > left + (col + 1) * width
    west = (col > 0) & (at_lng <= left + col * width)
    inside = on_map(at_lat, at_lng)
    return guessed.withColumns(
        {
            "row": F.when(inside, row + south.cast("int") - north.cast("int")).cast("int"),
            "col": F.when(inside, col + east.cast("int") - west.cast("int")).cast("int"),
        }
    ).drop("_lat", "_lng", "_row", "_col")


def edges(zoom, row: Column, col: Column) -> list[Column]:
    """The four edge columns of a tile, named as in ``RECT``."""
    lat, lng = lat_size(zoom), lng_size(zoom)
    return [
        (F.lit(90.0) - row * lat).alias("top_left_lat"),
        (F.lit(-180.0) + col * lng).alias("top_left_lng"),
        (F.lit(90.0) - (row + 1) * lat).alias("bot_right_lat"),
        (F.lit(-180.0) + (col + 1) * lng).alias("bot_right_lng"),
    ]


def with_edges(tiles: DataFrame, zoom: int | None = None) -> DataFrame:
    """Add the four edge columns to a table of ``(zoom, row, col)``, or to one
    whose tiles all lie at a given zoom."""
    level = F.col("zoom") if zoom is None else zoom
    return tiles.select("*", *edges(level, F.col("row"), F.col("col")))


def ancestor(index: Column, up) -> Column:
    """Row or column of the enclosing tile ``up`` levels higher; tiles nest by
    shifts from zoom 3 on."""
    return F.call_function("shiftright", index, F.lit(up) if isinstance(up, int) else up)


def centre_lat() -> Column:
    top, bot = F.col("top_left_lat"), F.col("bot_right_lat")
    return top - (top - bot) / 2


def centre_lng() -> Column:
    left, right = F.col("top_left_lng"), F.col("bot_right_lng")
    return left + (right - left) / 2


def overlaps(a, b) -> Column:
    """Interiors intersect; touching edges do not count. ``a`` and ``b`` map an
    edge name to a column."""
    return (
        (a("bot_right_lat") < b("top_left_lat"))
        & (a("top_left_lat") > b("bot_right_lat"))
        & (a("bot_right_lng") > b("top_left_lng"))
        & (a("top_left_lng") < b("bot_right_lng"))
    )


def contains_point(region, lat: Column, lng: Column) -> Column:
    """Closed on all four sides."""
    return (
        (region("top_left_lat") >= lat)
        & (region("bot_right_lat") <= lat)
        & (region("top_left_lng") <= lng)
        & (region("bot_right_lng") >= lng)
    )


def contains(outer, inner) -> Column:
    return contains_point(outer, inner("top_left_lat"), inner("top_left_lng")) & contains_point(
        outer, inner("bot_right_lat"), inner("bot_right_lng")
    )


def with_cover(df: DataFrame, zoom) -> DataFrame:
    """Add ``r0, r1, c0, c1``: the first and last row and column whose interior
    meets the rectangle, clipped to the map. Quotients first, edges second."""
    height, width = lat_size(zoom), lng_size(zoom)
    top, left, bot, right = [F.col(c) for c in RECT[1:]]
    quotients = {
        "_r0": F.floor((F.lit(90.0) - top) / height),
        "_r1": F.ceil((F.lit(90.0) - bot) / height) - 1,
        "_c0": F.floor((left + 180.0) / width),
        "_c1": F.ceil((right + 180.0) / width) - 1,
    }
    r0, r1, c0, c1 = [F.col(c) for c in quotients]

    def lat_of(row: Column) -> Column:
        return F.lit(90.0) - row * height

    def lng_of(col: Column) -> Column:
        return F.lit(-180.0) + col * width

    first_row = F.when(lat_of(r0 + 1) >= top, r0 + 1).when(lat_of(r0) < top, r0 - 1).otherwise(r0)
    last_row = F.when(lat_of(r1) <= bot, r1 - 1).when(lat_of(r1 + 1) > bot, r1 + 1).otherwise(r1)
    first_col = F.when(lng_of(c0 + 1) <= left, c0 + 1).when(lng_of(c0) > left, c0 - 1).otherwise(c0)
    last_col = (
        F.when(lng_of(c1) >= right, c1 - 1).when(lng_of(c1 + 1) < right, c1 + 1).otherwise(c1)
    )
    return (
        df.withColumns(quotients)
        .withColumns(
            {
                "r0": F.greatest(first_row, F.lit(0)).cast("int"),
                "r1": F.least(last_row, row_count(zoom) - 1).cast("int"),
                "c0": F.greatest(first_col, F.lit(0)).cast("int"),
                "c1": F.least(last_col, col_count(zoom) - 1).cast("int"),
            }
        )
        .drop(*quotients)
    )


def rows_inside(zoom: int, top: float, bot: float) -> tuple[int, int]:
    """Rows of the tiles lying fully between two latitudes, computed exactly so
    that a viewport becomes an integer range the scan can prune on."""
    size = Fraction(180, n_rows(zoom))
    lo = -((Fraction(top) - 90) // size)
    hi = (90 - Fraction(bot)) // size - 1
    return int(lo), int(hi)


def cols_inside(zoom: int, left: float, right: float) -> tuple[int, int]:
    size = Fraction(360, n_cols(zoom))
    lo = -((-180 - Fraction(left)) // size)
    hi = (Fraction(right) + 180) // size - 1
    return int(lo), int(hi)
