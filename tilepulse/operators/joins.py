"""Joins on the map: rectangles and points matched through grid cells.

A rectangle is filed under the cells it meets at its *home* level, one zoom
finer than the finest whose cells are no smaller than it: few cells, and little
of them outside the rectangle. Matching is an equi-join on
cells followed by the exact predicate, so there is no nested loop, and large and
small rectangles can be mixed: a huge one has a coarse home and few cells.

Cells here are plain ``floor`` bins, clamped at the map's rim. Clamping keeps
their order, so two rectangles that meet always share a cell, also off the map.

Every join returns struct columns, named by the caller, one per side. They are
packed last: Spark's pruning of fields loses some below generators, joins and unions.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grid
from ..functions.grid import MAX_ZOOM, MIN_SUMMARY_ZOOM
from .skew import BROADCAST_ROWS, CHUNK_ROWS, broadcast_if_small, salted_join

# Zooms between the finest cell as large as a rectangle and the rectangle's home.
FINER = 1

CELL = ["cell_zoom", "cell_row", "cell_col"]


def _bin(offset: Column, size: Column, count: Column) -> Column:
    last = (count - 1).cast("bigint")
    return F.greatest(F.least(F.floor(offset / size), last), F.lit(0)).cast("int")


def _bin_row(lat: Column, zoom: Column) -> Column:
    return _bin(F.lit(90.0) - lat, grid.lat_size(zoom), grid.row_count(zoom))


def _bin_col(lng: Column, zoom: Column) -> Column:
    return _bin(lng + 180.0, grid.lng_size(zoom), grid.col_count(zoom))


def _named(side: str, column: str) -> str:
    return f"{side}.{column}"


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _side(df: DataFrame, name: str) -> DataFrame:
    """A table with the side's name before each column, so the two sides' names never clash."""
    return df.select(*[_column(c).alias(_named(name, c)) for c in df.columns])


def _packed(pairs: DataFrame, *sides: tuple[str, DataFrame]) -> DataFrame:
    """The columns of each side, a name and the table it was, as one struct."""

    def struct(name: str, df: DataFrame) -> Column:
        fields = [_column(_named(name, c)).alias(c) for c in df.columns]
        return F.struct(*fields).alias(name)

    return pairs.select(*[struct(*side) for side in sides])


def _edge(name: str):
    return lambda edge: _column(_named(name, edge))


def _with_home(df: DataFrame, name: str) -> DataFrame:
    """Add the home level; drop rectangles with a null or NaN edge, which match
    nothing. Edges beyond the map, infinite ones too, count as far as a whole map
    beyond it: what lies there shares the cells at the rim."""
    side = _edge(name)

    def within(edge: str, reach: float) -> Column:
        return F.greatest(F.least(side(edge), F.lit(reach)), F.lit(-reach))

    extent = F.greatest(
        within("top_left_lat", 270.0) - within("bot_right_lat", 270.0),
        within("bot_right_lng", 540.0) - within("top_left_lng", 540.0),
    )
    whole = F.greatest(
        side("top_left_lat") - side("bot_right_lat"), side("bot_right_lng") - side("top_left_lng")
    )
    # Wholly beyond that reach, a rectangle has no extent in it, and rim cells only.
    extent = F.when((extent <= 0) & (whole > 0), F.lit(360.0)).otherwise(extent)
    known = [side(edge).isNotNull() & ~F.isnan(side(edge)) for edge in grid.RECT[1:]]
    df = df.filter(reduce(lambda x, y: x & y, known))
    fits = F.floor(F.log2(F.lit(20.0) / extent)) + MIN_SUMMARY_ZOOM
    home = F.greatest(F.least(fits + FINER, F.lit(MAX_ZOOM)), F.lit(MIN_SUMMARY_ZOOM)).cast("int")
    return df.filter(extent > 0).withColumn("home", home)


def _census(df: DataFrame) -> dict[int, int]:
    """Rectangles per home level in use: at most sixteen numbers."""
    return dict(sorted(tuple(row) for row in df.groupBy("home").count().collect()))


def _most_cells(census: dict[int, int]) -> int:
    """Upper bound on the home cells of a side: a rectangle is at most 2**FINER
    cells long and may start and end inside one; the coarsest level has 162."""
    whole_map = grid.n_rows(MIN_SUMMARY_ZOOM) * grid.n_cols(MIN_SUMMARY_ZOOM)
    across = 2**FINER + 2
    return sum(
        n * (whole_map if zoom == MIN_SUMMARY_ZOOM else across**2) for zoom, n in census.items()
    )


def _cells(df: DataFrame, name: str, zooms: Column) -> DataFrame:
    """The cells a rectangle meets at each of ``zooms``: at most a few at or
    above its home level."""
    side, zoom = _edge(name), F.col("cell_zoom")
    rows = F.sequence(_bin_row(side("top_left_lat"), zoom), _bin_row(side("bot_right_lat"), zoom))
    cols = F.sequence(_bin_col(side("top_left_lng"), zoom), _bin_col(side("bot_right_lng"), zoom))
    return (
        df.withColumn("cell_zoom", F.explode(zooms))
        .withColumn("cell_row", F.explode(rows))
        .withColumn("cell_col", F.explode(cols))
        .drop("home")
    )


def _listed(levels: Iterable[int]) -> Column:
    return F.array(*[F.lit(z) for z in levels]).cast("array<int>")


def _chosen(levels: Iterable[int], test) -> Column:
    """Array of the levels that pass a test on a column."""
    return F.filter(_listed(levels), test)


def _cell_join(
    homes: DataFrame, visits: DataFrame, most: int, max_rows: int, hot_rows: int
) -> DataFrame:
    """Broadcast the home cells if at most ``max_rows`` can come of them, else a
    shuffled join with hot cells spread over tasks."""
    if most <= max_rows:
        return visits.join(F.broadcast(homes), CELL)
    return salted_join(visits, homes, CELL, hot_rows)


def overlap_join(
    a: DataFrame,
    b: DataFrame,
    names: tuple[str, str] = ("a", "b"),
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Pairs of rectangles whose interiors intersect; touching does not count.

    A pair meets at the coarser of the two home levels: either ``a`` is at home
    there, or ``b`` is and ``a``'s home is finer. Of the cells a pair shares,
    only the one with the north-west corner of the intersection reports it, so
    no pair comes twice and nothing has to be deduplicated.
    """
    left, right = names
    sides = (_with_home(_side(a, left), left), _with_home(_side(b, right), right))
    census = (_census(sides[0]), _census(sides[1]))
    home = F.array("home")
    a_home = _cell_join(
        _cells(sides[0], left, home),
        _cells(sides[1], right, _chosen(census[0], lambda z: z <= F.col("home"))),
        _most_cells(census[0]),
        broadcast_rows,
        hot_rows,
    )
    b_home = _cell_join(
        _cells(sides[1], right, home),
        _cells(sides[0], left, _chosen(census[1], lambda z: z < F.col("home"))),
        _most_cells(census[1]),
        broadcast_rows,
        hot_rows,
    )
    sa, sb, zoom = _edge(left), _edge(right), F.col("cell_zoom")
    top = F.least(sa("top_left_lat"), sb("top_left_lat"))
    west = F.greatest(sa("top_left_lng"), sb("top_left_lng"))
    pairs = a_home.unionByName(b_home).filter(
        grid.overlaps(sa, sb)
        & (_bin_row(top, zoom) == F.col("cell_row"))
        & (_bin_col(west, zoom) == F.col("cell_col"))
    )
    return _packed(pairs, (left, a), (right, b))


def contains_join(
    outer: DataFrame,
    inner: DataFrame,
    names: tuple[str, str] = ("outer", "inner"),
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Pairs where ``outer`` contains both corners of ``inner`` (closed edges).
    ``inner`` is looked up by its north-west corner, which lies in one cell."""
    side = _edge(names[1])
    return _corner_join(
        outer,
        inner,
        names,
        (side("top_left_lat"), side("top_left_lng")),
        grid.contains(_edge(names[0]), side),
        broadcast_rows,
        hot_rows,
    )


def points_in_regions(
    points: DataFrame,
    regions: DataFrame,
    names: tuple[str, str] = ("point", "region"),
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Pairs of a point (``lat, lng``) and a rectangle it lies in or on."""
    point = _edge(names[0])
    lat, lng = point("lat"), point("lng")
    return _corner_join(
        regions,
        points,
        (names[1], names[0]),
        (lat, lng),
        grid.contains_point(_edge(names[1]), lat, lng),
        broadcast_rows,
        hot_rows,
    )


def _corner_join(regions, points, names, at, predicate, broadcast_rows, hot_rows) -> DataFrame:
    region, point = names
    homed = _with_home(_side(regions, region), region)
    named = _side(points, point)
    census = _census(homed)
    lat, lng = at
    zoom = F.col("cell_zoom")
    located = (
        named.filter(~F.isnan(lat) & ~F.isnan(lng))
        .withColumn("cell_zoom", F.explode(_listed(census)))
        .withColumn("cell_row", _bin_row(lat, zoom))
        .withColumn("cell_col", _bin_col(lng, zoom))
    )
    filed = _cells(homed, region, F.array("home"))
    pairs = _cell_join(filed, located, _most_cells(census), broadcast_rows, hot_rows)
    return _packed(pairs.filter(predicate), (region, regions), (point, points))


def lookup_cover(
    tiles: DataFrame, cover: DataFrame, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Tiles listed in the enumerated cover of an area (``cover_area``), with or
    without devices. Keys in the cover may repeat; a tile comes once."""
    keys = cover.select(F.col("tile_zoom").alias("zoom"), "row", "col")
    return tiles.join(broadcast_if_small(keys, broadcast_rows), grid.TILE, "left_semi")
