"""The event journal: an append-only Parquet table of change events."""

from __future__ import annotations

import time

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.grid import COUNTS, DEVICE, RECT
from ..functions.keys import device_key, tag_of
from ..operators.lifecycle import event_to_state
from ..operators.skew import CHUNK_ROWS, broadcast_if_small, numbered, split_points, with_chunk
from ..operators.summary import summarize_all, with_deltas
from . import store
from .workspace import written

ORDER = ["ts", "event_id"]
LOADS = "load int, load_id string"
MANAGEMENT = "projection_name string, projection_key string, paused boolean, last_updated long"
# Bits of ``ordering`` for an event's place in its load: 10**12 events, 8 million loads.
PLACE_BITS = 40
# Increments between two compactions of the tile table.
COMPACT_EVERY = 20
# So many tables of last states are folded into one of the next level.
FOLD = 8
LAST = (
    "zoom int, top_left_lat double, top_left_lng double, bot_right_lat double, "
    "bot_right_lng double, last_number long, state string"
)
MANIFEST = "load int, tag string, file string, first long, last long, events long"


def journal_rows(
    events: DataFrame,
    tag_count: int,
    chunk_rows: int | None = CHUNK_ROWS,
    load: int = 1,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """One load of events as journal rows. ``ordering`` is the place of append: the
    load's number in the high bits, below it the event's place in the load by time.
    ``sequence_number`` counts a device's events and goes on from ``earlier``, the
    devices' last numbers (as of ``last_of_devices``).

    A device with a very long history is numbered chunk by chunk: each chunk's
    numbers start after the rows of the chunks before it.
    """
    splits = None if chunk_rows is None else split_points(events, RECT, ORDER, chunk_rows)
    chunked = with_chunk(events, RECT, ORDER, splits)
    number = F.row_number().over(Window.partitionBy(*DEVICE, "chunk").orderBy(*ORDER))
    counted = chunked.withColumn("sequence_number", number.cast("bigint"))
    if splits is not None:
        before = Window.partitionBy(*RECT).orderBy("chunk")
        rows_before = F.coalesce(
            F.sum("count").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        )
        offsets = (  # one row per chunk of a hot device
            chunked.join(splits.hot(), RECT, "left_semi")
            .groupBy(*RECT, "chunk")
            .count()
            .select(*RECT, "chunk", rows_before.alias("offset"))
        )
        counted = counted.join(splits.side(offsets), [*RECT, "chunk"], "left").withColumn(
            "sequence_number", F.col("sequence_number") + F.coalesce("offset", F.lit(0))
        )
    if earlier is not None:
        counted = counted.join(earlier.select(*RECT, "last_number"), RECT, "left").withColumn(
            "sequence_number", F.col("sequence_number") + F.coalesce("last_number", F.lit(0))
        )
    key = device_key()
    placed = numbered(counted.select(*ORDER, *RECT, "event_type", "sequence_number"), ORDER, "place")
    return placed.select(
        (F.col("place") + F.lit(load << PLACE_BITS)).alias("ordering"),
        key.alias("persistence_id"),
        "sequence_number",
        F.lit(False).alias("deleted"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("write_timestamp"),
        "event_type",
        *RECT,
        tag_of(key, tag_count).alias("tag"),
    )


def append_journal(
    events: DataFrame,
    path: str,
    tag_count: int = 1,
    chunk_rows: int | None = CHUNK_ROWS,
    load_id: str | None = None,
) -> None:
    """Append one load of events, partitioned by tag. A load that is listed under its
    ``load_id`` is left alone; one that failed half-way is written anew. Loads are
    appended one after the other, and a device's later events come in later loads.

        <path>/events/load=<n>/tag=<t>/   the events of load n
        <path>/manifest/load=<n>/         its files: tag, least and greatest ordering, events
        <path>/last/<m>-<n>/              last numbers and states of the devices of loads m to n
        <path>/loads/                     one row per finished load
    """
    spark = events.sparkSession
    if load_id is not None and has_load(spark, path, load_id):
        return
    load = 1 + (_loads(spark, path).agg(F.max("load")).head()[0] or 0)
    earlier = last_of_devices(spark, path) if load > 1 else None
    # Written first: what derives the events would else run for each of the steps below.
    events = written(events.select(*ORDER, *RECT, "event_type"), "load")
    rows = journal_rows(events, tag_count, chunk_rows, load, earlier)
    rows.write.mode("overwrite").partitionBy("tag").parquet(f"{path}/events/load={load}")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/events/load={load}")
    top = F.max_by("event_type", "sequence_number")
    last = stored.groupBy(*RECT).agg(
        F.max("sequence_number").alias("last_number"), event_to_state(top).alias("state")
    )
    last = last.withColumn("load", F.lit(load))
    last.write.mode("overwrite").parquet(f"{path}/last/{load}-{load}")
    _fold_last(spark, path, load)
    _write_manifest(stored, f"{path}/manifest/load={load}")
    row = spark.createDataFrame([(load, load_id if load_id is not None else str(load))], LOADS)
    row.coalesce(1).write.mode("append").json(f"{path}/loads")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """The events of all finished loads."""
    newest = _loads(spark, path).agg(F.max("load")).head()[0] or 0
    rows = spark.read.parquet(f"{path}/events").filter(F.col("load") <= newest).drop("load")
    return rows.withColumn("tag", F.col("tag").cast("string"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(load, tag, file, first, last, events) of every file of the finished loads."""
    newest = _loads(spark, path).agg(F.max("load")).head()[0] or 0
    if not newest:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{path}/manifest").filter(F.col("load") <= newest)


def _write_manifest(stored: DataFrame, path: str) -> None:
    name = F.col("_metadata.file_name").alias("file")
    files = stored.select(F.col("tag").cast("string"), name, "ordering").groupBy("tag", "file")
    bounds = [F.min("ordering").alias("first"), F.max("ordering").alias("last")]
    counted = files.agg(*bounds, F.count("*").alias("events"))
    counted.coalesce(1).write.mode("overwrite").json(path)


def has_load(spark: SparkSession, path: str, load_id: str) -> bool:
    """Whether a load is finished."""
    return bool(_loads(spark, path).filter(F.col("load_id") == load_id).head(1))


def last_of_devices(spark: SparkSession, path: str) -> DataFrame:
    """(rectangle, last_number, state) of every device in the finished loads, from
    the rows that each load keeps per device, not from its events. ``state`` is what
    the state machine goes on from. Of n loads some log(n) tables are read."""
    newest = _loads(spark, path).agg(F.max("load")).head()[0] or 0
    if not newest:
        return spark.createDataFrame([], LAST)
    return _newest_states(spark, path, last_tables(newest)).drop("load")


def last_tables(newest: int) -> list[tuple[int, int]]:
    """The folded tables that hold the loads 1 to ``newest``."""
    tables, size, end = [], 1, newest
    while end:
        for _ in range(end // size % FOLD):
            tables.append((end - size + 1, end))
            end -= size
        size *= FOLD
    return tables[::-1]


def _newest_states(spark: SparkSession, path: str, tables: list[tuple[int, int]]) -> DataFrame:
    last = spark.read.parquet(*[f"{path}/last/{first}-{end}" for first, end in tables])
    newest = F.max_by(F.struct("last_number", "state", "load"), "load").alias("newest")
    return last.groupBy(*RECT).agg(newest).select(*RECT, "newest.*")


def _fold_last(spark: SparkSession, path: str, load: int) -> None:
    """Fold the tables that a load completes, each level from those of the one below."""
    size = FOLD
    while load % size == 0:
        step = size // FOLD
        parts = [(end - step + 1, end) for end in range(load - size + step, load + 1, step)]
        folded = _newest_states(spark, path, parts)
        folded.write.mode("overwrite").parquet(f"{path}/last/{load - size + 1}-{load}")
        size *= FOLD


def _loads(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LOADS).json(f"{path}/loads")
    except AnalysisException:  # nothing appended yet
        return spark.createDataFrame([], LOADS)


def event_tags(journal: DataFrame) -> DataFrame:
    """The tag table: one row per event and tag."""
    return journal.select(F.col("ordering").alias("event_id"), "tag")


def join_tags(journal: DataFrame, tags: DataFrame) -> DataFrame:
    """Journal rows with the tags of a separate tag table."""
    plain = journal.drop("tag")
    return plain.join(tags, plain["ordering"] == tags["event_id"]).drop("event_id")


def events_by_tag(
    journal: DataFrame, tags: DataFrame | None, tag: str, offset: int
) -> DataFrame:
    """Events of one tag after an offset, in order. With the tag as a column of
    the journal (``tags`` None) only that partition is read."""
    tagged = journal if tags is None else join_tags(journal, tags)
    return tagged.filter((F.col("tag") == tag) & (F.col("ordering") > offset)).orderBy("ordering")


def run_incremental(
    journal: DataFrame,
    progress: DataFrame,
    projection: str,
    management: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Events past the saved offset, and the offsets to save once they are
    handled. The projection's key is the tag. Keys paused in ``management`` are
    skipped and keep their offset.

    ``progress`` and ``management`` have one row per key, so at most one per tag.
    """
    saved = progress.filter(F.col("projection_name") == projection).select(
        F.col("projection_key").alias("tag"), "current_offset"
    )
    due = (
        journal.join(broadcast_if_small(saved), "tag", "left")
        .filter(F.col("ordering") > F.coalesce("current_offset", F.lit(-1)))
        .drop("current_offset")
    )
    if management is not None:
        paused = management.filter(
            (F.col("projection_name") == projection) & F.col("paused")
        ).select(F.col("projection_key").alias("tag"))
        due = due.join(broadcast_if_small(paused), "tag", "left_anti")
    moved = due.groupBy("tag").agg(F.max("ordering").alias("moved_to"))
    advanced = saved.join(moved, "tag", "full_outer").select(
        F.lit(projection).alias("projection_name"),
        F.col("tag").alias("projection_key"),
        F.coalesce("moved_to", "current_offset").alias("current_offset"),
    )
    others = progress.filter(F.col("projection_name") != projection)
    return due, advanced.unionByName(others.select(*advanced.columns))


def due_loads(
    spark: SparkSession, path: str, progress: DataFrame, projection: str
) -> list[int]:
    """The loads that hold events past the saved offset of a tag that isn't paused, by the
    manifest alone."""
    saved = progress.filter(F.col("projection_name") == projection).select(
        F.col("projection_key").alias("tag"), "current_offset"
    )
    paused = (
        read_management(spark, path)
        .filter((F.col("projection_name") == projection) & F.col("paused"))
        .select(F.col("projection_key").alias("tag"))
    )
    due = (
        read_manifest(spark, path)
        .join(broadcast_if_small(saved), "tag", "left")
        .filter(F.col("last") > F.coalesce("current_offset", F.lit(-1)))
        .join(broadcast_if_small(paused), "tag", "left_anti")
    )
    return sorted(row["load"] for row in due.select("load").distinct().collect())


def read_loads(spark: SparkSession, path: str, loads: list[int]) -> DataFrame:
    """The events of some finished loads with events; other loads' folders are not listed."""
    folders = [f"{path}/events/load={load}" for load in loads]
    rows = spark.read.option("basePath", f"{path}/events").parquet(*folders).drop("load")
    return rows.withColumn("tag", F.col("tag").cast("string"))


def project_increment(
    spark: SparkSession,
    path: str,
    tiles: str,
    projection: str = "tiles",
    compact_every: int | None = COMPACT_EVERY,
) -> bool:
    """Add the counts of all events past the saved offsets to the tile table, and save
    the offsets with them: both or neither. The projection's keys are the tags; those
    paused (``set_paused``) wait. Only loads with such events are read. Every
    ``compact_every`` increments the table is compacted. Returns whether anything was due."""
    progress = store.read_progress(spark, tiles)
    loads = due_loads(spark, path, progress, projection)
    if not loads:
        return False
    due, _ = run_incremental(
        read_loads(spark, path, loads), progress, projection, read_management(spark, path)
    )
    due = due.persist(StorageLevel.DISK_ONLY)
    try:
        moved = due.groupBy("tag").agg(F.max("ordering").alias("top")).collect()  # a row per tag
        if not moved:
            return False
        batch = 1 + max(store.saved_batch(spark, tiles, projection), 0)
        offsets = {row["tag"]: row["top"] for row in moved}
        deltas = summarize_all(due)
        store.append_deltas(deltas, tiles, batch, projection=projection, offsets=offsets)
    finally:
        due.unpersist()
    if compact_every and batch % compact_every == 0:
        store.compact_tiles(spark, tiles)
    return True


def set_paused(
    spark: SparkSession, path: str, projection: str, key: str, paused: bool
) -> None:
    """Pause a key of a projection, or let it go on; kept beside the journal."""
    row = (projection, key, paused, time.time_ns() // 1000)
    rows = spark.createDataFrame([row], MANAGEMENT)
    rows.coalesce(1).write.mode("append").json(f"{path}/management")


def read_management(spark: SparkSession, path: str) -> DataFrame:
    """(projection_name, projection_key, paused): the latest word on each key."""
    try:
        rows = spark.read.schema(MANAGEMENT).json(f"{path}/management")
    except AnalysisException:  # nothing was ever paused
        rows = spark.createDataFrame([], MANAGEMENT)
    return rows.groupBy("projection_name", "projection_key").agg(
        F.max_by("paused", "last_updated").alias("paused")
    )


def tag_deltas(due: DataFrame) -> DataFrame:
    """Per tag: events due and their net counts."""
    return (
        with_deltas(due)
        .groupBy("tag")
        .agg(F.count("*").alias("event_total"), *[F.sum(c).alias(c) for c in COUNTS])
    )
