"""Selections as linear quadtrees: large tiles where they are taken whole, small ones
at the edge only.

A selection's rows and columns at a zoom are ranges, and so are those of the tiles it
takes whole. What a zoom adds to the coarser ones is therefore a frame, the range of
whole tiles less the children of the coarser range: at most four strips, each a few
tiles thick. So no tree is walked, and the size of the result follows the length of the
edge, not the area.

Selections are rectangles with the edges named in ``RECT``; they are clipped to the map.
Those with a null or NaN edge, or without an interior, have no tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import grid, quad
from ..functions.grid import COUNTS, MAX_ZOOM, MIN_SUMMARY_ZOOM, RECT, TILE
from ..sources.workspace import written
from .skew import BROADCAST_ROWS
from .summary import sums
from .tiles import unroll

# Zoom at which the totals of a selection turn from stored sums to devices one by one:
# a tile there has 4**6 = 4,096 of them.
EDGE_ZOOM = 12

# Zooms between the lines in which devices are summed below that: a strip then has at most
# seven lines of a zoom at either end, and a device lies in two lines each way.
LINE_STEP = 3

_RANGE = ["r0", "r1", "c0", "c1"]
LINE = ["lattice", "line"]


def _clipped(selections: DataFrame) -> DataFrame:
    """The selection as one struct, its edges beside it, limited to the map."""
    packed = selections.select(F.struct(*selections.columns).alias("selection"))
    for edge, reach in zip(RECT[1:], (90.0, 180.0, 90.0, 180.0)):
        given = F.col(f"selection.{edge}")
        packed = packed.filter(given.isNotNull() & ~F.isnan(given)).withColumn(
            edge, F.greatest(F.least(given, F.lit(reach)), F.lit(-reach))
        )
    return packed.filter("top_left_lat > bot_right_lat and bot_right_lng > top_left_lng")


def _with_ranges(df: DataFrame, zoom: Column, prefix: str) -> DataFrame:
    """Add the range of tiles met at a zoom and, as ``in_...``, of those taken whole."""
    top, left, bot, right = [F.col(c) for c in RECT[1:]]
    height, width = grid.lat_size(zoom), grid.lng_size(zoom)
    r0, r1, c0, c1 = [F.col(c) for c in _RANGE]
    cut = {
        "r0": r0 + (F.lit(90.0) - r0 * height > top).cast("int"),
        "r1": r1 - (F.lit(90.0) - (r1 + 1) * height < bot).cast("int"),
        "c0": c0 + (F.lit(-180.0) + c0 * width < left).cast("int"),
        "c1": c1 - (F.lit(-180.0) + (c1 + 1) * width > right).cast("int"),
    }
    met = grid.with_cover(df, zoom).withColumns({f"{prefix}in_{k}": v for k, v in cut.items()})
    return met.withColumnsRenamed({k: f"{prefix}{k}" for k in _RANGE})


def _bounds(prefix: str) -> list[Column]:
    return [F.col(prefix + name) for name in _RANGE]


def _frame(outer: list[Column], inner: list[Column], overlap: str) -> list[Column]:
    """The strips of one range less another within it, which may be empty."""
    r0, r1, c0, c1 = outer
    i0, i1, j0, j1 = inner
    empty = (i0 > i1) | (j0 > j1)
    # Around an empty range, the northern strip is all there is.
    north = F.when(empty, r1).otherwise(i0 - 1)
    beside = F.when(empty, F.lit(-1)).otherwise(i1)  # an empty range of rows
    strips = [
        (r0, north, c0, c1),
        (F.when(empty, r1 + 1).otherwise(i1 + 1), r1, c0, c1),
        (i0, beside, c0, j0 - 1),
        (i0, beside, j1 + 1, c1),
    ]
    return [
        F.struct(
            *[bound.cast("int").alias(name) for bound, name in zip(strip, _RANGE)],
            F.lit(overlap).alias("overlap"),
        )
        for strip in strips
    ]


def _strips(selections: DataFrame, zoom: int, coarsest: int) -> DataFrame:
    """The nodes of ``cover_tree`` as ranges of tiles: ``selection, tile_zoom``, the bounds
    ``r0, r1, c0, c1``, ``overlap``. A selection has at most four a zoom and four of its edge;
    one side of a range has at most a few tiles."""
    level, above = F.col("tile_zoom"), F.col("zoom_above")
    levels = F.array(*[F.lit(z) for z in range(coarsest, zoom + 1)])
    levelled = _clipped(selections).withColumn("tile_zoom", F.explode(levels))
    levelled = levelled.withColumn("zoom_above", F.greatest(level - 1, F.lit(0)))
    ranges = _with_ranges(_with_ranges(levelled, above, "up_"), level, "")
    down = (grid.row_count(level) / grid.row_count(above)).cast("int")
    across = (grid.col_count(level) / grid.col_count(above)).cast("int")
    p0, p1, q0, q1 = _bounds("up_in_")
    # Nothing is coarser than the coarsest zoom: an empty range there.
    first = level == coarsest
    known = {
        "was_r0": F.when(first, 1).otherwise(p0 * down),
        "was_r1": F.when(first, 0).otherwise((p1 + 1) * down - 1),
        "was_c0": F.when(first, 1).otherwise(q0 * across),
        "was_c1": F.when(first, 0).otherwise((q1 + 1) * across - 1),
    }
    ranges = ranges.withColumns(known)
    whole = _frame(_bounds("in_"), _bounds("was_"), "full")
    edge = _frame(_bounds(""), _bounds("in_"), "partial")
    strips = F.when(level == zoom, F.array(*whole, *edge)).otherwise(F.array(*whole))
    return ranges.select("selection", "tile_zoom", F.inline(strips)).filter(
        "r0 <= r1 and c0 <= c1"
    )


def cover_tree(selections: DataFrame, zoom: int = MAX_ZOOM, coarsest: int = 0) -> DataFrame:
    """The fewest tiles of zooms ``coarsest..zoom`` that make up a selection: the largest
    it takes whole (``overlap`` full), and at ``zoom`` those it takes in part (partial).

    Returns ``selection`` (the row given, as a struct), ``tile_zoom, row, col, overlap``,
    and the interval ``first_key..last_key`` of quad keys. A selection's intervals are
    disjoint; a zoom-18 tile is met by it iff its key lies in one, or, if ``zoom`` is
    coarser, may be met if it lies in a partial one.
    """
    if not 0 <= coarsest <= zoom <= MAX_ZOOM:
        raise ValueError(f"zooms {coarsest}..{zoom} are not within 0..{MAX_ZOOM}")
    nodes = _strips(selections, zoom, coarsest)
    return quad.with_keys(unroll(nodes), "tile_zoom").select(
        "selection", "tile_zoom", "row", "col", "overlap", "first_key", "last_key"
    )


def expand_tree(tree: DataFrame, zoom: int = MAX_ZOOM) -> DataFrame:
    """A tree's nodes as tiles of one zoom, no coarser than any of them: ``selection,
    tile_zoom, row, col, overlap``. Its size follows the area again."""
    level, row, col = F.col("tile_zoom"), F.col("row"), F.col("col")
    down = (F.lit(grid.n_rows(zoom)) / grid.row_count(level)).cast("int")
    across = (F.lit(grid.n_cols(zoom)) / grid.col_count(level)).cast("int")
    ranges = tree.select(
        "selection",
        "overlap",
        (row * down).alias("r0"),
        (row * down + down - 1).alias("r1"),
        (col * across).alias("c0"),
        (col * across + across - 1).alias("c1"),
    )
    return unroll(ranges).select("selection", F.lit(zoom).alias("tile_zoom"), "row", "col", "overlap")


def selection_totals(
    tiles: DataFrame,
    selections: DataFrame,
    key: str,
    edge_zoom: int = EDGE_ZOOM,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Per selection ``key``: the counts of the devices (zoom-18 tiles) whose interior
    meets it; a selection without any has no row.

    Whole tiles are looked up in the tile table at their own zoom, so a stored sum stands
    for all devices below it. Only tiles of ``edge_zoom`` that the selection cuts are opened.
    A tree of at most ``broadcast_rows`` nodes is broadcast, and both are joins by tile. A
    larger one stays as strips: the tiles of a strip that lie in one line of the grid are
    a run, and its total is the difference of two running sums of that line. So no node
    is made, and work and disk follow the tiles and the selections, not their products.
    """
    if not MIN_SUMMARY_ZOOM <= edge_zoom <= MAX_ZOOM:
        raise ValueError(f"edge_zoom must be within {MIN_SUMMARY_ZOOM}..{MAX_ZOOM}")
    edges = _clipped(selections.select(F.col(key).alias("selection_key"), *RECT[1:]))
    edges = written(edges.select("selection.selection_key", *RECT[1:]), "selections")
    strips = _strips(edges, edge_zoom, MIN_SUMMARY_ZOOM)
    stored = tiles.select(*TILE, *COUNTS)
    size = (F.col("r1") - F.col("r0") + 1).cast("bigint") * (F.col("c1") - F.col("c0") + 1)
    if (strips.agg(F.sum(size)).head()[0] or 0) <= broadcast_rows:
        totals = _totals_of_nodes(stored, strips, edge_zoom)
    else:
        totals = _totals_of_runs(stored, strips, edge_zoom)
    return totals.withColumnRenamed("selection_key", key)


def _totals_of_nodes(stored: DataFrame, strips: DataFrame, edge_zoom: int) -> DataFrame:
    """The totals by two joins with the nodes, which are broadcast."""
    nodes = unroll(strips).select("selection", "tile_zoom", "row", "col", "overlap")
    nodes = written(nodes, "nodes").withColumnRenamed("tile_zoom", "zoom")
    side = [F.broadcast(n.drop("overlap")) for n in _by_overlap(nodes)]
    counts = ["selection.selection_key", *COUNTS]
    inside = stored.filter(F.col("zoom").between(MIN_SUMMARY_ZOOM, edge_zoom))
    found = inside.join(side[0], TILE).select(*counts)
    up = MAX_ZOOM - edge_zoom
    devices = grid.with_edges(stored.filter(F.col("zoom") == MAX_ZOOM), MAX_ZOOM).select(
        F.struct(*RECT).alias("device"),
        F.lit(edge_zoom).alias("zoom"),
        grid.ancestor(F.col("row"), up).alias("row"),
        grid.ancestor(F.col("col"), up).alias("col"),
        *COUNTS,
    )
    cut = devices.join(side[1], TILE).filter(
        grid.overlaps(lambda e: F.col(f"selection.{e}"), lambda e: F.col(f"device.{e}"))
    )
    both = found.unionByName(cut.select(*counts))
    return both.groupBy("selection_key").agg(*sums())


def _totals_of_runs(stored: DataFrame, strips: DataFrame, edge_zoom: int) -> DataFrame:
    """The totals from running sums along lines. Tiles and runs are shuffled once, by line;
    what a selection's runs differ by there is summed by selection.

    Rows are counted like tiles, as a selection that meets tiles of devices that are all
    gone has a row of zeros."""
    full, cut = _by_overlap(strips)
    levels = list(range(MAX_ZOOM, edge_zoom, -LINE_STEP)) or [MAX_ZOOM]
    inside = stored.filter(F.col("zoom").between(MIN_SUMMARY_ZOOM, edge_zoom))
    devices = stored.filter(F.col("zoom") == MAX_ZOOM)
    runs = _full_runs(full).unionByName(_cut_runs(cut, edge_zoom, levels))
    lined = _lined(inside, [None]).unionByName(_lined(devices, levels))
    rows = lined.unionByName(runs, allowMissingColumns=True).repartition(*LINE)
    step, place = F.col("step"), F.col("place")
    one = F.array(F.struct(F.col("first").alias("place"), F.lit(0).alias("step")))
    two = F.array(
        F.struct((F.col("first") - 1).alias("place"), F.lit(-1).alias("step")),
        F.struct(F.col("last").alias("place"), F.lit(1).alias("step")),
    )
    rows = rows.select("*", F.inline(F.when(F.col("last").isNull(), one).otherwise(two)))
    line = Window.partitionBy(*LINE).orderBy(place, step != 0)
    line = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = [F.sum(c).over(line).alias(c) for c in COUNTS]
    running += [F.count(c).over(line).alias("known_" + c) for c in COUNTS]
    running += [F.count_if(step == 0).over(line).alias("met")]
    passed = rows.select("selection_key", "step", *running).filter(step != 0)
    names = [*COUNTS, *["known_" + c for c in COUNTS], "met"]
    change = [F.sum(step * F.coalesce(c, F.lit(0))).alias(c) for c in names]
    totals = passed.groupBy("selection_key").agg(*change).filter("met > 0")
    return totals.select(
        "selection_key", *[F.when(F.col("known_" + c) > 0, F.col(c)).alias(c) for c in COUNTS]
    )


def _lattice(zoom: int | Column, wide: bool | Column, opened: bool) -> Column:
    """A number for a zoom's lines of tiles or, if these are opened, of devices: its rows
    or its columns."""
    number = F.lit(zoom) + F.when(F.lit(wide), 0).otherwise(32) + 64 * opened
    return number.cast("int").alias("lattice")


def _wide() -> Column:
    """Whether a range is taken row by row: lines run along its longer side."""
    return (F.col("c1") - F.col("c0") >= F.col("r1") - F.col("r0")).alias("wide")


def _lined(tiles: DataFrame, levels: list[int | None]) -> DataFrame:
    """Every tile at its place ``first`` in its row and in its column; with levels, devices
    in the rows and columns of those zooms."""
    listed = []
    for level in levels:
        zoom, up = (F.col("zoom"), 0) if level is None else (level, MAX_ZOOM - level)
        for wide, across, along in ((True, "row", "col"), (False, "col", "row")):
            lattice = _lattice(zoom, wide, level is not None)
            line = grid.ancestor(F.col(across), up).alias("line")
            listed.append(F.struct(lattice, line, F.col(along).alias("first")))
    there = tiles.filter("row is not null and col is not null")
    return there.select(*COUNTS, F.inline(F.array(*listed)))


def _by_lines(ranges: DataFrame) -> DataFrame:
    """Add the range of lines ``l0..l1`` and, in each, of places ``first..last``."""
    r0, r1, c0, c1 = _bounds("")
    sides = {"l0": (r0, c0), "l1": (r1, c1), "first": (c0, r0), "last": (c1, r1)}
    named = {k: F.when(F.col("wide"), row).otherwise(col) for k, (row, col) in sides.items()}
    return ranges.withColumns(named)


def _unrolled_lines(ranges: DataFrame) -> DataFrame:
    lines = F.when(F.col("l0") <= F.col("l1"), F.sequence("l0", "l1"))
    return ranges.withColumn("line", F.explode(lines)).select(
        "selection_key", *LINE, "first", "last"
    )


def _full_runs(strips: DataFrame) -> DataFrame:
    """The runs of whole tiles, at their own zoom."""
    ranges = strips.select("selection.selection_key", "tile_zoom", _wide(), *_RANGE)
    lattice = _lattice(F.col("tile_zoom"), F.col("wide"), False)
    return _unrolled_lines(_by_lines(ranges).withColumn("lattice", lattice))


def _cut_runs(strips: DataFrame, edge_zoom: int, levels: list[int]) -> DataFrame:
    """The runs of devices that a selection meets in the tiles it cuts. A strip's lines of
    devices are joined to those of the ``levels``, finest first: whole ones at the coarsest,
    at finer ones what these leave at either end."""
    up = MAX_ZOOM - edge_zoom
    outer = [F.shiftleft(F.col(c), up).alias("of_" + c) for c in ("r0", "c0")]
    outer += [(F.shiftleft(F.col(c) + 1, up) - 1).alias("of_" + c) for c in ("r1", "c1")]
    met = grid.with_cover(strips.select("selection.*", _wide(), *outer), MAX_ZOOM)
    both = {c: F.greatest(F.col(c), F.col("of_" + c)) for c in ("r0", "c0")}
    both |= {c: F.least(F.col(c), F.col("of_" + c)) for c in ("r1", "c1")}
    met = met.withColumns(both).filter("r0 <= r1 and c0 <= c1")
    met = _by_lines(met).withColumnsRenamed({"l0": "top", "l1": "end"})
    top, end = F.col("top"), F.col("end")

    def whole(level: int) -> tuple[Column, Column]:
        down = MAX_ZOOM - level
        return F.shiftright(top + ((1 << down) - 1), down), F.shiftright(end + 1, down) - 1

    parts = []
    for level, coarser in zip(levels, [*levels[1:], None]):
        first, last = whole(level)
        lattice = _lattice(level, F.col("wide"), True)
        if coarser is None:
            parts.append(F.struct(lattice, first.alias("l0"), last.alias("l1")))
            continue
        above = whole(coarser)
        empty, down = above[0] > above[1], level - coarser
        before = F.when(empty, last).otherwise(F.shiftleft(above[0], down) - 1)
        after = F.when(empty, last + 1).otherwise(F.shiftleft(above[1] + 1, down))
        parts.append(F.struct(lattice, first.alias("l0"), before.alias("l1")))
        parts.append(F.struct(lattice, after.alias("l0"), last.alias("l1")))
    return _unrolled_lines(met.select("selection_key", "first", "last", F.inline(F.array(*parts))))


def _by_overlap(nodes: DataFrame) -> list[DataFrame]:
    return [nodes.filter(F.col("overlap") == o) for o in ("full", "partial")]
