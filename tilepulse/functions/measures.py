"""Measures derived from a tile's or a selection's own columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import MAX_ZOOM

# The coarsest zoom at which an area action is allowed, and the
# fill ratio below which a tile counts as partly filled.
MIN_SELECTABLE_ZOOM = 8
PARTIAL_BELOW = 0.5


def max_devices(zoom: Column) -> Column:
    """Devices that fit into a tile: four per level down to zoom 18."""
    bits = ((F.lit(MAX_ZOOM) - zoom) * 2).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bits)


def with_mood(tiles: DataFrame) -> DataFrame:
    """``happy``, ``sad`` or ``mixed``."""
    happy, sad = F.col("happy_count"), F.col("sad_count")
    return tiles.withColumn(
        "mood",
        F.when((happy > 0) & (sad == 0), "happy")
        .when((happy == 0) & (sad > 0), "sad")
        .otherwise("mixed"),
    )


def with_density(tiles: DataFrame) -> DataFrame:
    """Fill ratio, and whether the tile is only partly filled."""
    ratio = F.col("device_count") / max_devices(F.col("zoom"))
    return tiles.withColumn("fill_ratio", ratio).withColumn("partial", ratio < PARTIAL_BELOW)


def selection_cost(selections: DataFrame) -> DataFrame:
    """Devices a selection touches, seconds it takes at its rate (halves round
    up; null for rate 0), and whether its zoom is allowed."""
    devices = max_devices(F.col("zoom"))
    seconds = F.floor(F.try_divide(devices, F.col("rate")) + F.lit(0.5))
    return selections.select(
        "*",
        devices.alias("device_total"),
        seconds.alias("duration_sec"),
        (F.col("zoom") >= MIN_SELECTABLE_ZOOM).alias("allowed"),
    )
