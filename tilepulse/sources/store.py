"""The tile table on disk.

Counts are additive, so a batch of changes is added by *appending* its deltas
and summing when reading: nothing is rewritten per batch. Now and then
``compact_tiles`` folds deltas together, and into the larger parts only when they
have grown to a fair share of these, so that each row is rewritten a bounded number
of times (the logarithm of the table's size), not at every compaction.

    <path>/deltas/<key>/batch=<n>/zoom=<z>/   changes of batch n of a projection key
    <path>/parts/version=<v>/zoom=<z>/        what version v folded together
    <path>/heads/v=<v>/                       the parts of version v, and how far it
                                              has folded each projection key
    <path>/progress/since=<v>/                one row per batch finished since then

Deltas and parts have the same layout: by zoom, sorted by blocks of tiles.

Progress is kept per projection name and key, as several projections may feed one
table. A batch is written to its own folder, replacing what a failed attempt may
have left there, and counts only once it is listed. Within a key batch ids rise;
one that is listed or folded already is left alone. A key belongs to its writer (a
stream's checkpoint): another writer that numbers batches anew is refused instead of
having its batches taken for old ones.

One compaction runs at a time; batches may be added meanwhile. Readers of a version
are undisturbed until ``KEPT_VERSIONS`` further compactions have removed it.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import grid
from ..functions.grid import COUNTS, TILE
from ..operators.summary import sums

TILES = T.StructType(
    [T.StructField(c, T.IntegerType()) for c in TILE]
    + [T.StructField(c, T.LongType()) for c in COUNTS]
)
PROGRESS = T.StructType(
    [
        T.StructField("projection_name", T.StringType()),
        T.StructField("projection_key", T.StringType()),
        T.StructField("writer", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("current_offset", T.LongType()),
        T.StructField("folder", T.StringType()),
    ]
)
HEAD = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("parts", T.ArrayType(T.StringType())),
        T.StructField("rows", T.ArrayType(T.LongType())),
        T.StructField("folded", T.ArrayType(PROGRESS)),
    ]
)
# Rows per file of the table.
FILE_ROWS = 4_000_000
# Levels between a block of the sort order and its tiles.
BLOCK_DEPTH = 5
# A part is folded into once what is to be added is no smaller than this share of it.
FOLD_SHARE = 0.25
KEPT_VERSIONS = 2


class Head(NamedTuple):
    """The newest version: its parts, largest first, and what it has folded."""

    version: int
    parts: list[str]
    rows: list[int]
    folded: dict[tuple[str, str], T.Row]


def upsert_tiles(current: DataFrame, changes: DataFrame, mode: str = "add") -> DataFrame:
    """The table after an upsert: ``add`` sums counts into existing tiles,
    ``replace`` overwrites them. New tiles are inserted either way. In the
    changes given to ``replace`` a tile comes once, as in a keyed insert."""
    columns = [*TILE, *COUNTS]
    current, changes = current.select(*columns), changes.select(*columns)
    if mode == "add":
        return current.unionByName(changes).groupBy(*TILE).agg(*sums())
    if mode == "replace":
        return current.join(changes, TILE, "left_anti").unionByName(changes)
    raise ValueError(f"mode must be 'add' or 'replace', not {mode!r}")


def bulk_load(tiles: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Write a whole table in one distributed job: partitioned by zoom and, in
    each zoom, laid out by blocks of 32 x 32 tiles, so that a viewport reads few
    row groups."""
    ranged = tiles.select(*TILE, *COUNTS).repartitionByRange(*_layout())
    _write_sorted(ranged, path, file_rows)


def _layout() -> list[Column]:
    block = [grid.ancestor(F.col(c), BLOCK_DEPTH) for c in ("row", "col")]
    return [F.col("zoom"), *block, F.col("row"), F.col("col")]


def _write_sorted(tiles: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Each task's rows by zoom and in the table's order. A batch is written so: its
    tasks' tiles are few, and ranges would cost running the batch twice."""
    (
        tiles.select(*TILE, *COUNTS)
        .sortWithinPartitions(*_layout())
        .write.mode("overwrite")
        .option("maxRecordsPerFile", file_rows)
        .partitionBy("zoom")
        .parquet(path)
    )


def append_deltas(
    deltas: DataFrame,
    path: str,
    batch_id: int,
    offset: int | None = None,
    projection: str = "tiles",
    key: str = "",
    writer: str = "",
    offsets: dict[str, int] | None = None,
) -> None:
    """Add one batch of a projection key's changes; a batch already added is left
    alone. Its counts and its offset become visible together, and so do ``offsets``,
    those of further keys whose changes are in this batch."""
    spark = deltas.sparkSession
    head = _head(spark, path)
    since = _progress(spark, path).filter(
        (F.col("projection_name") == projection) & (F.col("projection_key") == key)
    )
    known = [row for row in [head.folded.get((projection, key)), *since.collect()] if row]
    for row in known:
        if row["writer"] != writer:
            raise ValueError(
                f"projection {projection!r}, key {key!r} is written by {row['writer']!r}, not by "
                f"{writer!r}: go on with its checkpoint or give the new one a key of its own"
            )
    folded = head.folded.get((projection, key))
    if folded and batch_id <= folded["batch_id"] or batch_id in {r["batch_id"] for r in known}:
        return
    folder = _delta_folder(projection, key, batch_id)
    _write_sorted(deltas, f"{path}/{folder}")
    rows = [(projection, key, writer, batch_id, offset, folder)]
    rows += [(projection, k, writer, batch_id, at, None) for k, at in (offsets or {}).items()]
    listed = spark.createDataFrame(rows, PROGRESS).coalesce(1)  # one file: all or nothing
    listed.write.mode("append").json(f"{path}/progress/since={head.version}")


def replace_tiles(
    rows: DataFrame, path: str, batch_id: int, projection: str = "tiles", key: str = ""
) -> None:
    """Set the counts of the given tiles (each listed once) in the stored table: what
    is added is the difference to what it holds. Others must not add to these tiles
    meanwhile."""
    spark, columns = rows.sparkSession, [*TILE, *COUNTS]
    given = rows.select(*columns)
    held = read_tiles(spark, path).join(given.select(*TILE), TILE, "left_semi")
    less = held.select(*TILE, *[(-F.col(c)).alias(c) for c in COUNTS])
    change = given.unionByName(less).groupBy(*TILE).agg(*sums())
    append_deltas(change, path, batch_id, projection=projection, key=key)


def compact_tiles(spark: SparkSession, path: str) -> int | None:
    """Fold the finished batches, and parts that are not much larger, into one part;
    returns the version, None for a table without batches."""
    head = _head(spark, path)
    finished = _unfolded(_progress(spark, path).collect(), head)
    if not finished:
        return head.version or None
    folders = [f"{path}/{row['folder']}" for row in finished if row["folder"]]
    merged = sum(_stored(spark, folder).count() for folder in folders)
    parts, rows = list(head.parts), list(head.rows)
    while parts and merged >= FOLD_SHARE * rows[-1]:
        merged += rows.pop()
        folders.append(f"{path}/{parts.pop()}")
    version = head.version + 1
    part = f"parts/version={version}"
    bulk_load(_summed([_stored(spark, folder) for folder in folders]), f"{path}/{part}")
    parts, rows = [*parts, part], [*rows, _stored(spark, f"{path}/{part}").count()]
    folded = dict(head.folded)
    for row in finished:
        name = (row["projection_name"], row["projection_key"])
        if name not in folded or folded[name]["batch_id"] < row["batch_id"]:
            top = [r["current_offset"] for r in (folded.get(name), row) if r]
            top = max((t for t in top if t is not None), default=None)
            folded[name] = T.Row(**{**row.asDict(), "current_offset": top})
    _write_head(spark, path, Head(version, parts, rows, folded))
    _clean(spark, path, version, [*head.parts], parts, folders)
    return version


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """The tile table as of the last finished batch: the parts of the newest version
    and the batches finished since; compacting keeps their list short."""
    head = _head(spark, path)
    finished = _unfolded(_progress(spark, path).collect(), head)
    folders = [f"{path}/{part}" for part in head.parts]
    folders += [f"{path}/{row['folder']}" for row in finished if row["folder"]]
    if not folders:
        return spark.createDataFrame([], TILES)
    return _summed([_stored(spark, folder) for folder in folders])


def read_base(spark: SparkSession, path: str) -> DataFrame:
    """A bulk-loaded table: one row per tile, pruned by zoom."""
    return _stored(spark, path)


def saved_offset(
    spark: SparkSession, path: str, projection: str = "tiles", key: str = ""
) -> int:
    """Highest offset saved with a finished batch of a key; -1 before the first."""
    folded = _head(spark, path).folded.get((projection, key))
    since = _progress(spark, path).filter(
        (F.col("projection_name") == projection) & (F.col("projection_key") == key)
    )
    found = [since.agg(F.max("current_offset")).head()[0], folded and folded["current_offset"]]
    return max((offset for offset in found if offset is not None), default=-1)


def saved_batch(spark: SparkSession, path: str, projection: str = "tiles", key: str = "") -> int:
    """Highest batch finished of a key; -1 before the first."""
    folded = _head(spark, path).folded.get((projection, key))
    since = _progress(spark, path).filter(
        (F.col("projection_name") == projection) & (F.col("projection_key") == key)
    )
    top = since.agg(F.max("batch_id")).head()[0]
    return max(-1 if top is None else top, folded["batch_id"] if folded else -1)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """(projection_name, projection_key, current_offset): how far each key has come."""
    folded = spark.createDataFrame(list(_head(spark, path).folded.values()), PROGRESS)
    return (
        _progress(spark, path)
        .unionByName(folded)
        .filter("current_offset is not null")
        .groupBy("projection_name", "projection_key")
        .agg(F.max("current_offset").alias("current_offset"))
    )


def key_and_batch(row: T.Row) -> tuple[str, str, int]:
    return row["projection_name"], row["projection_key"], row["batch_id"]


def _delta_folder(projection: str, key: str, batch_id: int) -> str:
    name = re.sub(r"[^A-Za-z0-9]", lambda m: f"_{ord(m.group()):x}_", f"{projection}.{key}")
    return f"deltas/{name}/batch={batch_id}"


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(TILES).parquet(folder).select(*TILE, *COUNTS)


def _summed(tables: list[DataFrame]) -> DataFrame:
    if len(tables) == 1:
        return tables[0]
    stacked = tables[0]
    for more in tables[1:]:
        stacked = stacked.unionByName(more)
    return stacked.groupBy(*TILE).agg(*sums())


def _unfolded(finished: list[T.Row], head: Head) -> list[T.Row]:
    """Finished batches that the version does not hold yet."""
    out = {}
    for row in finished:
        done = head.folded.get((row["projection_name"], row["projection_key"]))
        if done is None or row["batch_id"] > done["batch_id"]:
            out[key_and_batch(row)] = row
    return [out[name] for name in sorted(out)]


def _head(spark: SparkSession, path: str) -> Head:
    try:
        heads = spark.read.schema(HEAD).json(f"{path}/heads").orderBy(F.desc("version")).head(1)
    except AnalysisException:  # never compacted
        heads = []
    if not heads:
        return Head(0, [], [], {})
    row = heads[0]
    folded = {(r["projection_name"], r["projection_key"]): r for r in row["folded"] or []}
    return Head(row["version"], list(row["parts"] or []), list(row["rows"] or []), folded)


def _write_head(spark: SparkSession, path: str, head: Head) -> None:
    folded = [tuple(row[c] for c in PROGRESS.names) for row in head.folded.values()]
    rows = spark.createDataFrame([(head.version, head.parts, head.rows, folded)], HEAD)
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/heads/v={head.version}")


def _progress(spark: SparkSession, path: str) -> DataFrame:
    try:
        found = spark.read.schema(PROGRESS).json(f"{path}/progress")
    except AnalysisException:  # nothing finished yet
        return spark.createDataFrame([], PROGRESS)
    return found.select(*PROGRESS.names)


def _clean(
    spark: SparkSession,
    path: str,
    version: int,
    before: list[str],
    parts: list[str],
    folders: list[str],
) -> None:
    """Remove what no version of the last ``KEPT_VERSIONS`` needs: the progress rows
    and deltas folded by then, and parts that were folded into others. What this
    version has folded is noted, to be removed by a later one."""
    gone = [f"{path}/{part}" for part in before if part not in parts]
    gone += [folder for folder in folders if "/deltas/" in folder]
    gone += [f"{path}/progress/since={version - 1 - KEPT_VERSIONS}", f"{path}/heads/v={version - 1}"]
    schema = "version int, folder string"
    rows = spark.createDataFrame([(version, folder) for folder in gone], schema)
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/garbage/folded_by={version}")
    old = version - KEPT_VERSIONS
    try:
        listed = spark.read.schema(schema).json(f"{path}/garbage/folded_by={old}")
        for row in listed.collect():
            _remove(spark, row["folder"])
        _remove(spark, f"{path}/garbage/folded_by={old}")
    except AnalysisException:  # no such version
        return


def _remove(spark: SparkSession, folder: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(target, True)
