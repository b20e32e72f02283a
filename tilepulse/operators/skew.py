"""Helpers that keep hot keys from landing in one task.

Both work out a description of the hot keys first, which is broadcast only if it has
at most ``MAX_SPLITS`` rows, and both leave the result exactly as it would be without
them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.workspace import written

MAX_SPLITS = 50_000
CHUNK_ROWS = 4_000_000
SAMPLES_PER_CHUNK = 256
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; stops counting past the bound."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with their place ``name`` (from 0) in the whole order, without bringing
    them into one task: ranges are numbered apart, then shifted by the rows of the
    ranges before them. The driver sees one count per range."""
    ranged = df.repartitionByRange(*order).withColumn("range_id", F.spark_partition_id())
    stored = written(ranged, "numbered")
    counts = sorted(tuple(row) for row in stored.groupBy("range_id").count().collect())
    before, shifts = 0, []
    for range_id, count in counts:
        shifts.append((range_id, before))
        before += count
    shift = df.sparkSession.createDataFrame(shifts, "range_id int, rows_before long")
    place = F.row_number().over(Window.partitionBy("range_id").orderBy(*order)) - 1
    return (
        stored.withColumn(name, place)
        .join(F.broadcast(shift), "range_id")
        .withColumn(name, F.col(name) + F.col("rows_before"))
        .drop("range_id", "rows_before")
    )


class Splits(NamedTuple):
    """Where to cut the ordered rows of hot keys: one row per hot key with a sorted
    array ``cuts``. ``small`` says whether they are few enough to broadcast."""

    table: DataFrame
    keys: list[str]
    small: bool

    def side(self, df: DataFrame) -> DataFrame:
        """For a join with as many rows as there are cuts, or fewer."""
        return F.broadcast(df) if self.small else df

    def hot(self) -> DataFrame:
        return self.side(self.table.select(*self.keys))


def split_points(
    df: DataFrame, keys: list[str], order: list[str], chunk_rows: int = CHUNK_ROWS
) -> Splits | None:
    """Cuts so that each piece of a hot key's rows holds about ``chunk_rows``, however
    many rows there are. None if no key has more than one piece.

    The cuts come from a sample picked by a hash of the order columns, in one pass. They
    only balance the work: any cuts give the same answer. They are written down, so every
    use of them, and every retry of a task, sees the same ones.
    """
    one_in = max(1, chunk_rows // SAMPLES_PER_CHUNK)
    step = max(1, chunk_rows // one_in)
    sample = df.select(*keys, *order)
    if one_in > 1:
        sample = sample.filter(F.pmod(F.xxhash64(*order), F.lit(one_in)) == 0)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    found = (
        sample.withColumn("nth", nth)
        .filter(F.col("nth") % step == 0)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct(*order))).alias("cuts"))
    )
    stored = written(found, "cuts")
    total = stored.agg(F.sum(F.size("cuts"))).head()[0]
    return Splits(stored, keys, total <= MAX_SPLITS) if total else None


def with_chunk(
    df: DataFrame, keys: list[str], order: list[str], splits: Splits | None
) -> DataFrame:
    """Add ``chunk``: how many cuts lie at or before the row (0 for cold keys).

    A hot key's time, the first of the order columns, is divided into as many equal
    slices as it has cuts; a row looks up its slice, with the number of cuts before
    that and the few cuts in it. So a row's cost does not grow with the cuts.
    """
    if splits is None:
        return df.withColumn("chunk", F.lit(0))

    def micros(time: Column) -> Column:
        return F.unix_micros(time.cast("timestamp"))

    def slice_of(time: Column) -> Column:
        place = F.floor((micros(time) - F.col("time_from")) / F.col("time_width"))
        return F.least(place, F.col("slices").cast("bigint"))

    time = order[0]
    first, last = [micros(F.col("cuts")[i][time]) for i in (F.lit(0), F.size("cuts") - 1)]
    width = F.greatest(F.lit(1), F.ceil((last - first + 1) / F.size("cuts")))
    lines = splits.table.select(
        *keys,
        first.alias("time_from"),
        width.alias("time_width"),
        F.size("cuts").alias("slices"),
        "cuts",
    )
    each = lines.select("*", F.posexplode("cuts").alias("nth", "cut"))
    filled = (
        each.withColumn("slice", slice_of(F.col("cut")[time]))
        .groupBy(*keys, "slice")
        .agg(
            F.min("nth").alias("cuts_before"),
            F.sort_array(F.collect_list("cut")).alias("cuts_here"),
        )
    )
    numbers = F.sequence(F.lit(0).cast("bigint"), F.col("slices").cast("bigint"))
    every = lines.select(*keys, F.explode(numbers).alias("slice"))
    line = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.last(F.col("cuts_before") + F.size("cuts_here"), ignorenulls=True).over(line)
    slices = every.join(filled, [*keys, "slice"], "left").select(
        *keys,
        "slice",
        F.coalesce("cuts_before", passed, F.lit(0)).alias("cuts_before"),
        "cuts_here",
    )
    here = F.struct(*order)
    among = F.coalesce(F.size(F.filter("cuts_here", lambda cut: cut <= here)), F.lit(0))
    return (
        df.join(splits.side(lines.drop("cuts")), keys, "left")
        .withColumn("slice", slice_of(F.col(time)))
        .join(splits.side(slices), [*keys, "slice"], "left")
        .withColumn("among", F.when(F.col("cuts_here").isNull(), 0).otherwise(among))
        .withColumn("chunk", F.coalesce(F.col("cuts_before") + F.col("among"), F.lit(0)).cast("int"))
        .drop("time_from", "time_width", "slices", "slice", "cuts_before", "cuts_here", "among")
    )


def salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], hot_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Inner equi-join in which a key with more than ``hot_rows`` rows on a side
    is spread over several tasks: that side by its rows' numbers, so that equal rows part
    too, the other by copies.

    Both sides are written first: they are counted, grouped and joined, which would run what
    derives them three times, and a row of a written table keeps its number when a task is
    run again.
    """
    left, right = written(left, "salted-left"), written(right, "salted-right")
    left_fan = _fan_out(left, keys, hot_rows, "left_fan")
    right_fan = _fan_out(right, keys, hot_rows, "right_fan")
    if left_fan is None and right_fan is None:
        return left.join(right, keys)

    def salted(df: DataFrame, own: str, other: str) -> DataFrame:
        df = df.withColumn("row_salt", F.monotonically_increasing_id())
        for fan, name in ((left_fan, "left_fan"), (right_fan, "right_fan")):
            df = (
                df.withColumn(name, F.lit(1))
                if fan is None
                else df.join(F.broadcast(fan), keys, "left").fillna(1, [name])
            )
        # Hashed, as the low bits of the numbers of short partitions are much alike.
        spread = F.pmod(F.xxhash64("row_salt"), F.col(own)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return (
            df.withColumn(own + "_salt", spread)
            .withColumn(other + "_salt", copies)
            .drop("left_fan", "right_fan", "row_salt")
        )

    return (
        salted(left, "left_fan", "right_fan")
        .join(
            salted(right, "right_fan", "left_fan"), [*keys, "left_fan_salt", "right_fan_salt"]
        )
        .drop("left_fan_salt", "right_fan_salt")
    )


def _fan_out(df: DataFrame, keys: list[str], hot_rows: int, name: str) -> DataFrame | None:
    """Number of pieces for each hot key; at most ``MAX_SPLITS`` keys."""
    total = df.count()
    if total <= hot_rows:
        return None
    hot_rows = max(hot_rows, -(-total // MAX_SPLITS))
    hot = (
        df.groupBy(*keys)
        .count()
        .filter(F.col("count") > hot_rows)
        .select(*keys, F.ceil(F.col("count") / hot_rows).cast("int").alias(name))
    )
    rows = hot.collect()
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(name, T.IntegerType())])
    return df.sparkSession.createDataFrame(rows, schema) if rows else None
