"""From a stream of device events to the tile table."""

from __future__ import annotations

import json

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from ..functions.grid import (
    COUNTS,
    MAX_ZOOM,
    MIN_SUMMARY_ZOOM,
    TILE,
    centre_lat,
    centre_lng,
    on_map,
)
from ..operators.activity import step_deltas
from ..operators.summary import summarize_all, sums, with_deltas
from ..operators.tiles import assign_by_centre, climb
from ..sources.store import append_deltas, compact_tiles

# Micro-batches between two compactions of the table.
COMPACT_EVERY = 20


def group_within(
    reader: DataStreamReader, files: int | None = None, size: str | None = None
) -> DataStreamReader:
    """Bound the events handled together by the files, or by the bytes ("64m", say), that
    a micro-batch takes; the other bound, a time, is the trigger interval. A file is never
    split, so write files of bounded size. (For Kafka the same limit is called
    ``maxOffsetsPerTrigger``.)"""
    if files is not None:
        return reader.option("maxFilesPerTrigger", files)
    return reader if size is None else reader.option("maxBytesPerTrigger", size)


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a streaming query keeps as long as its checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").head()[0])["id"]


def run_projection(
    events: DataFrame,
    path: str,
    checkpoint: str,
    interval: str | None = None,
    offset: str | None = None,
    projection: str = "tiles",
    key: str = "",
    compact_every: int | None = COMPACT_EVERY,
) -> StreamingQuery:
    """Add every micro-batch's counts to the tile table at ``path``, exactly
    once: the batch and its offset become visible together, and a micro-batch
    that is run again is recognised by its id.

    Several projections may feed one table, each under a ``projection`` and ``key`` of
    its own. A key goes on with the checkpoint it began with; another checkpoint, also
    a renewed one in the same place, is refused.

    ``interval`` is the longest wait, "1 second" say; without it the query takes
    what there is, in bounded micro-batches, and ends. ``offset`` names the
    column whose maximum is saved with each batch. A micro-batch is computed once
    (kept while it is written; a lost executor's share is computed again). Every
    ``compact_every`` micro-batches the table is compacted; leave that to one of
    several projections by giving the others None.
    """
    spark = events.sparkSession
    writer: list[str] = []

    def project(batch: DataFrame, batch_id: int) -> None:
        if not writer:
            writer.append(query_id(spark, checkpoint))
        kept = batch.persist(StorageLevel.DISK_ONLY)
        try:
            counted = summarize_all(kept)
            found = F.max(offset) if offset else F.lit(None).cast("bigint")
            total, top = kept.agg(F.count("*"), found).head()
            if total:
                append_deltas(counted, path, batch_id, top, projection, key, writer[0])
        finally:
            kept.unpersist()
        if compact_every and batch_id % compact_every == compact_every - 1:
            compact_tiles(spark, path)

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        events.writeStream.foreachBatch(project)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def stream_tile_counts(events: DataFrame) -> DataFrame:
    """Running counts per tile and zoom, kept in the state store (update mode)."""
    there = events.filter(on_map(centre_lat(), centre_lng()))
    counts = assign_by_centre(with_deltas(there)).select("row", "col", *COUNTS)
    return climb(counts, MIN_SUMMARY_ZOOM, MAX_ZOOM).groupBy(*TILE).agg(*sums())


def stream_activity(events: DataFrame, step_seconds: int = 1) -> DataFrame:
    """Net change per time step, kept in the state store (update mode). The
    samples are cut from it by ``operators.activity.recent_samples``."""
    return step_deltas(events, step_seconds)


def keep_latest(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write every micro-batch's updated rows to its own folder under ``path``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        updates.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest(written: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row per key of what ``keep_latest`` wrote."""
    values = [c for c in written.columns if c not in (*keys, "batch_id")]
    newest = F.max_by(F.struct(*values), "batch_id").alias("newest")
    return written.groupBy(*keys).agg(newest).select(*keys, "newest.*")
