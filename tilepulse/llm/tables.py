"""Helpers shared by the operators: given tables, size checks, numbering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..sources.workspace import written

# A side is broadcast only if its measured size is at most this.
BROADCAST_BYTES = 8 << 20
# Per row, what a broadcast table holds besides its texts.
ROW_BYTES = 64
# Rows of an Arrow batch that Python handles at once, and what it returns at once.
OUT_ROWS = 8_192
# The same where whole texts become Python's objects.
HELD_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_small(df: DataFrame, *texts: str) -> bool:
    """Whether the rows, with the named text columns, fit a broadcast: measured
    over all rows, not assumed."""
    wide = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(ROW_BYTES))
    size = df.agg(F.sum(wide.cast("long"))).head()[0]
    return (size or 0) <= BROADCAST_BYTES


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their place ``name`` (from 0) in the whole order, without
    bringing them into one task: ranges are numbered apart, then shifted by the
    rows of the ranges before them. What the driver sees is one count a range."""
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    stored = written(ranged, "numbered")
    counts = sorted((r["_range"], r["count"]) for r in stored.groupBy("_range").count().collect())
    before, shifts = 0, []
    for part, count in counts:
        shifts.append((part, before))
        before += count
    if not shifts:
        return stored.drop("_range").withColumn(name, F.lit(0).cast("long"))
    schema = "_range int, _shift long"
    shift = local_table(df.sparkSession, shifts, schema)
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return (
        stored.withColumn(name, place)
        .join(F.broadcast(shift), "_range")
        .withColumn(name, F.col(name) + F.col("_shift"))
        .drop("_range", "_shift")
    )


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the driver's rows. It goes through Arrow, as from a list it would be
    decoded by Python workers of another kind, which executors keep beside the others."""
    fields = to_arrow_schema(T.StructType.fromDDL(schema))
    columns = list(zip(*rows)) or [[] for _ in fields]
    arrays = [pa.array(c, f.type) for c, f in zip(columns, fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=fields), schema)


def per_row(
    batches: Iterator[pa.RecordBatch], schema: pa.Schema, make: Callable[..., tuple]
) -> Iterator[pa.RecordBatch]:
    """One output row for each input row, some hundred rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, HELD_ROWS):
            part = batch.slice(start, HELD_ROWS)
            rows = [make(*values) for values in zip(*(c.to_pylist() for c in part.columns))]
            columns = zip(*rows) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
            )
