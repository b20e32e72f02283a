"""Quad keys: the zoom-18 tiles numbered so that every tile's are one interval.

A key follows the path from the world down to a tile: 2 children at zoom 0, 9 at
zooms 1 and 2, 4 from there on, each level counted row by row. The upper part tells
the zoom-3 tile, the lower one interleaves the bits of row and column: written to base 4,
its digits are the steps down from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grid
from .grid import MAX_ZOOM, MIN_SUMMARY_ZOOM

# Levels that halve both axes: their bits are interleaved.
LEVELS = MAX_ZOOM - MIN_SUMMARY_ZOOM


def key_count(zoom) -> Column:
    """Keys of a tile: the zoom-18 tiles in it."""
    world = grid.n_rows(MAX_ZOOM) * grid.n_cols(MAX_ZOOM)
    return grid._per_zoom(zoom, lambda z: world // (grid.n_rows(z) * grid.n_cols(z))).cast("bigint")


def first_device(zoom, row: Column, col: Column) -> tuple[Column, Column]:
    """Row and column of a tile's north-west zoom-18 tile."""
    down = grid._per_zoom(zoom, lambda z: grid.n_rows(MAX_ZOOM) // grid.n_rows(z))
    across = grid._per_zoom(zoom, lambda z: grid.n_cols(MAX_ZOOM) // grid.n_cols(z))
    return (row * down).cast("int"), (col * across).cast("int")


def _spread(bits: Column) -> Column:
    """The binary digits read as digits to base 4: each with a gap beside it."""
    return F.conv(F.bin(bits), 4, 10).cast("bigint")


def _picked(digits: Column, bits: str) -> Column:
    """A number from base-4 digits, of each of which one bit is kept."""
    return F.conv(F.translate(digits, "0123", bits), 2, 10).cast("bigint")


def device_number(row: Column, col: Column) -> Column:
    """Key of a zoom-18 tile."""
    row, col = row.cast("bigint"), col.cast("bigint")
    r3, c3 = F.shiftright(row, LEVELS), F.shiftright(col, LEVELS)

    def third(index: Column) -> Column:
        return F.floor(index / 3)

    # The zoom-2 tile row by row within its half of the world, then the zoom-3 tile.
    zoom_2 = F.floor(c3 / 9) * 9 + third(r3) * 3 + third(c3) % 3
    zoom_3 = zoom_2 * 9 + (r3 % 3) * 3 + c3 % 3
    low = F.lit((1 << LEVELS) - 1)
    inner = F.shiftleft(_spread(row.bitwiseAND(low)), 1).bitwiseOR(_spread(col.bitwiseAND(low)))
    return F.shiftleft(zoom_3.cast("bigint"), 2 * LEVELS).bitwiseOR(inner)


def with_keys(tiles: DataFrame, zoom: str = "zoom") -> DataFrame:
    """Add ``first_key, last_key``: the interval of a tile's zoom-18 tiles."""
    level = F.col(zoom)
    first = device_number(*first_device(level, F.col("row"), F.col("col")))
    return tiles.withColumn("first_key", first).withColumn(
        "last_key", F.col("first_key") + key_count(level) - 1
    )


def device_of(key: Column) -> tuple[Column, Column]:
    """Row and column of the zoom-18 tile with a key."""
    zoom_3 = F.shiftright(key, 2 * LEVELS)
    zoom_2, inner = F.floor(zoom_3 / 9), key.bitwiseAND(F.lit((1 << 2 * LEVELS) - 1))
    r3 = F.floor(zoom_2 % 9 / 3) * 3 + F.floor(zoom_3 % 9 / 3)
    c3 = F.floor(zoom_2 / 9) * 9 + zoom_2 % 3 * 3 + zoom_3 % 3

    digits = F.conv(inner.cast("string"), 10, 4)

    def placed(base: Column, bits: Column) -> Column:
        return F.shiftleft(base.cast("bigint"), LEVELS).bitwiseOR(bits).cast("int")

    return placed(r3, _picked(digits, "0011")), placed(c3, _picked(digits, "0101"))
