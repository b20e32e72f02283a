"""Totals over time: regular samples, their changes, and an axis scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.grid import COUNTS
from ..sources.workspace import written
from .summary import sums, with_deltas

# Fixed value: samples the monitor keeps.
KEEP = 180
DELTAS = ["device_delta", "happy_delta", "sad_delta"]


def step_deltas(events: DataFrame, step_seconds: int) -> DataFrame:
    """Net change of the totals per time step (steps counted from the epoch)."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    step = F.floor(seconds / (step_seconds * 1_000_000))
    return with_deltas(events).groupBy(step.alias("step")).agg(*sums())


def activity(events: DataFrame, step_seconds: int = 1, keep: int = KEEP) -> DataFrame:
    """The newest ``keep`` samples: totals at the end of each step and the change
    since the sample before; the very first sample of a history changes nothing.
    """
    steps = written(step_deltas(events, step_seconds), "steps")
    return recent_samples(steps, step_seconds, keep)


def recent_samples(steps: DataFrame, step_seconds: int, keep: int = KEEP) -> DataFrame:
    """Samples from per-step changes. Steps without events are sampled too.

    All older steps are first summed into one row, so the window that runs over
    all rows sees ``keep + 1`` of them at most. ``steps`` is gone through three
    times and should be a table.
    """
    newest = steps.agg(F.max("step").alias("newest"), F.min("step").alias("oldest"))
    last = newest.select("newest").scalar()
    dense = newest.select(
        F.explode(
            F.sequence(F.greatest(F.col("newest") - keep, F.col("oldest")), F.col("newest"))
        ).alias("step"),
        *[F.lit(0).cast("bigint").alias(c) for c in COUNTS],
    )
    recent = (
        steps.withColumn("step", F.greatest(F.col("step"), last - keep))
        .groupBy("step")
        .agg(*sums())
        .unionByName(dense)
        .groupBy("step")
        .agg(*sums())
    )
    line = Window.orderBy("step")
    running = recent.select(
        "step",
        F.row_number().over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("nth"),
        *[F.sum(c).over(line.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in COUNTS],
        *[F.col(c).alias(d) for c, d in zip(COUNTS, DELTAS)],
    )
    return running.filter(F.col("step") > last - keep).select(
        (F.col("step") * step_seconds).alias("sample_epoch"),
        *COUNTS,
        *[F.when(F.col("nth") == 1, 0).otherwise(F.col(d)).cast("bigint").alias(d) for d in DELTAS],
    )


def activity_scale(samples: DataFrame) -> DataFrame:
    """Smallest and largest change over the three series, and the axis bounds:
    multiples of the power of ten that leaves at most ten of them."""
    extremes = samples.agg(
        F.min(F.least(*DELTAS)).alias("min_delta"), F.max(F.greatest(*DELTAS)).alias("max_delta")
    )
    low, high = F.col("min_delta"), F.col("max_delta")
    return extremes.select(
        "min_delta",
        "max_delta",
        _bound(low, -1).alias("scale_neg"),
        _bound(high, 1).alias("scale_pos"),
    )


def _bound(delta: Column, sign: int) -> Column:
    """With unit u = +-10, +-100, .. the first such that delta / u <= 10, the
    bound is floor(delta / u) * u + u. Counting the digits of |delta| - 1 gives
    the unit exactly, where a logarithm would round."""
    size = delta * sign
    digits = F.length((size - 1).cast("string"))
    power = F.when(size > 100, digits - 1).otherwise(1)
    unit = F.element_at(F.array(*[F.lit(10**n).cast("bigint") for n in range(1, 19)]), power) * sign
    return F.floor(delta / unit) * unit + unit
