"""The given tables as telemetry, points, selections and areas.

No given table has coordinates, so an id is turned into a place by integer
arithmetic; DuckDB does the same sums, and all edges are exact doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grid
from ..functions.grid import MAX_ZOOM, RECT
from ..operators.lifecycle import derive_events
from ..operators.summary import summarize_all
from ..sources.journal import append_journal
from ..sources.store import bulk_load, read_base
from ..sources.workspace import workspace

# Event type in the events table -> device action.
ACTION_OF = {
    "signup": "create",
    "view": "ping",
    "click": "happy",
    "error": "sad",
    "purchase": "delete",
}
SELECTION_ACTIONS = ["create", "delete", "happy", "sad"]
# Customers' commands precede those of the events table.
FLEET_START = "2023-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place_row(ident: Column) -> Column:
    """Zoom-18 row and column of an id. All ids below 294,912 differ in row;
    beyond that the third term moves the column on."""
    return ((ident * 104729 + 7) % 294912).cast("int")


def place_col(ident: Column) -> Column:
    return ((ident * 1299709 + 11 + F.floor(ident / 294912)) % 589824).cast("int")


def place(df: DataFrame, ident: str, zoom: int | Column = MAX_ZOOM) -> DataFrame:
    """Add ``zoom, row, col`` and the four edges of the id's tile."""
    key = F.col(ident).cast("bigint")
    if isinstance(zoom, int):
        level, up = F.lit(zoom), MAX_ZOOM - zoom
    else:
        level = zoom.cast("int")
        up = F.lit(MAX_ZOOM) - F.col("zoom")
    placed = df.withColumn("zoom", level).select(
        "*",
        grid.ancestor(place_row(key), up).alias("row"),
        grid.ancestor(place_col(key), up).alias("col"),
    )
    return grid.with_edges(placed, zoom if isinstance(zoom, int) else None)


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as device commands; a device is a user's tile."""
    return as_commands(table(spark, sf_dir, "events"))


def as_commands(events: DataFrame) -> DataFrame:
    action = F
    for event, name in ACTION_OF.items():
        action = action.when(F.col("event_type") == event, name)
    named = events.select("event_id", "ts", "user_id", action.alias("action"))
    return place(named, "user_id").select("event_id", "ts", "action", *RECT)


def bad_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with four of every fifty commands broken, each in its own way."""
    broken = F.col("event_id") % 50
    top, left = F.col("top_left_lat"), F.col("top_left_lng")
    bot, right = F.col("bot_right_lat"), F.col("bot_right_lng")
    return commands(spark, sf_dir).select(
        "event_id",
        F.when(broken == 3, "Create").otherwise(F.col("action")).alias("action"),
        F.when(broken == 0, 19).otherwise(F.col("zoom")).alias("zoom"),
        F.when(broken == 1, bot).otherwise(top).alias("top_left_lat"),
        F.when(broken == 2, right).otherwise(left).alias("top_left_lng"),
        F.when(broken == 1, top).otherwise(bot).alias("bot_right_lat"),
        F.when(broken == 2, left).otherwise(right).alias("bot_right_lng"),
    )


def fleet_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of all devices: every customer's device is created and, if the
    balance is negative, made sad; then come the events."""
    actions = F.when(F.col("c_acctbal") < 0, F.array(F.lit("create"), F.lit("sad"))).otherwise(
        F.array(F.lit("create"))
    )
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", F.posexplode(actions).alias("nth", "action")
    )
    first = place(customers, "c_custkey").select(
        (F.col("nth") - 2 * F.col("c_custkey") - 2).cast("bigint").alias("event_id"),
        F.lit(FLEET_START).cast("timestamp_ntz").alias("ts"),
        "action",
        *RECT,
    )
    return first.unionByName(commands(spark, sf_dir))


def device_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_events(commands(spark, sf_dir))


def fleet_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_events(fleet_commands(spark, sf_dir))


def fleet_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tile table of the whole fleet, zooms 3..18."""
    return summarize_all(fleet_events(spark, sf_dir))


_stored: dict[tuple[str, ...], str] = {}


def stored_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a table on disk, as map queries find it: built once per
    session and data folder, in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        path = workspace(spark, "tiles")
        bulk_load(fleet_tiles(spark, sf_dir), path)
        _stored[key] = path
    return read_base(spark, _stored[key])


def stored_journal(spark: SparkSession, sf_dir: str, tag_count: int) -> str:
    """Path of a journal of the device events, as readers find it: appended once per
    session and data folder, in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, f"journal-{tag_count}")
    if key not in _stored:
        path = workspace(spark, "journal")
        append_journal(device_events(spark, sf_dir), path, tag_count)
        _stored[key] = path
    return _stored[key]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of the device tiles of all orders: ``point_id, lat, lng``."""
    placed = place(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return placed.select(
        F.col("o_orderkey").alias("point_id"),
        grid.centre_lat().alias("lat"),
        grid.centre_lng().alias("lng"),
    )


def selections(spark: SparkSession, sf_dir: str, zoom: int | Column = 13) -> DataFrame:
    """One area action per supplier: its tile at some zoom, an action, a rate."""
    key = F.col("s_suppkey")
    actions = F.array(*[F.lit(a) for a in SELECTION_ACTIONS])
    named = table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.get(actions, (key % 4).cast("int")).alias("action"),
        (100 * (1 + key % 10)).cast("int").alias("rate"),
    )
    return place(named, "s_suppkey", zoom)


def areas(
    spark: SparkSession, sf_dir: str, zoom: int, half_height: float, half_width: float
) -> DataFrame:
    """One query area per supplier around its device's centre, not on the grid,
    clipped to the map. Sizes are exact binary fractions, so edges are exact."""
    top, left = F.col("top_left_lat"), F.col("top_left_lng")
    placed = place(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")
    return placed.select(
        F.col("s_suppkey").alias("area_id"),
        F.lit(zoom).alias("zoom"),
        F.least(top + half_height, F.lit(90.0)).alias("top_left_lat"),
        F.greatest(left - half_width, F.lit(-180.0)).alias("top_left_lng"),
        F.greatest(top - half_height, F.lit(-90.0)).alias("bot_right_lat"),
        F.least(left + half_width, F.lit(180.0)).alias("bot_right_lng"),
    )
