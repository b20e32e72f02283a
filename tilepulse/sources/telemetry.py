"""Telemetry commands and area selections: reading, checking, answering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import grid
from ..functions.grid import MAX_ZOOM, RECT

ACTIONS = ["create", "delete", "happy", "sad", "ping"]

# The JSON field of each rectangle column.
JSON_NAMES = {
    "top_left_lat": "topLeftLat",
    "top_left_lng": "topLeftLng",
    "bot_right_lat": "botRightLat",
    "bot_right_lng": "botRightLng",
}
_RECT_FIELDS = [
    T.StructField("zoom", T.IntegerType()),
    *[T.StructField(name, T.DoubleType()) for name in JSON_NAMES.values()],
]
TELEMETRY = T.StructType([T.StructField("action", T.StringType()), *_RECT_FIELDS])
SELECTION = T.StructType(
    [T.StructField("action", T.StringType()), T.StructField("rate", T.IntegerType()), *_RECT_FIELDS]
)

# Reject reason -> message and status of the answer.
REJECTIONS = {
    "malformed": ("The request content was malformed.", 400),
    "zoom_range": ("The zoom has to lie between 0 and 18.", 400),
    "lat_order": ("The northern edge has to lie north of the southern one.", 400),
    "lng_order": ("The western edge has to lie west of the eastern one.", 400),
    "off_map": ("The centre of the rectangle must be on the map.", 400),
    "unknown_action": (
        "Action '%s' is unknown; known are create, ping, delete, happy and sad.",
        500,
    ),
}
ACCEPTED = ("Accepted", 200)


def _columns(schema: T.StructType, source: str = "") -> list[Column]:
    names = {json: name for name, json in JSON_NAMES.items()}
    return [F.col(source + f.name).alias(names.get(f.name, f.name)) for f in schema]


def _read(spark: SparkSession, path: str, schema: T.StructType, streaming: bool) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).json(path).select(*_columns(schema))


def read_telemetry(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Commands from JSON files, batch or stream, without schema inference."""
    return _read(spark, path, TELEMETRY, streaming)


def read_selections(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Area actions from JSON files: a command for a whole area, with a rate."""
    return _read(spark, path, SELECTION, streaming)


def parse_telemetry(df: DataFrame, value: str = "value") -> DataFrame:
    """Commands from a text column (a message queue's value, say)."""
    return _parse(df, value, TELEMETRY)


def parse_selections(df: DataFrame, value: str = "value") -> DataFrame:
    return _parse(df, value, SELECTION)


def _parse(df: DataFrame, value: str, schema: T.StructType) -> DataFrame:
    kept = [c for c in df.columns if c != value]
    parsed = df.withColumn("parsed", F.from_json(value, schema))
    return parsed.select(*kept, *_columns(schema, "parsed."))


def telemetry_json(fields: list[str]) -> Column:
    """The JSON text of a command (or selection) held in columns."""
    return F.to_json(F.struct(*[F.col(f).alias(JSON_NAMES.get(f, f)) for f in fields]))


def check_telemetry(df: DataFrame) -> DataFrame:
    """Add ``reject_reason``: why a command is refused, null for a good one.
    Missing numbers become zero, as in the JSON binding of the service being fed;
    a line in which nothing could be read is malformed."""
    top, left, bot, right = [F.col(c) for c in RECT[1:]]
    nothing = F.coalesce("action", *[F.col(c).cast("string") for c in RECT]).isNull()
    reason = (
        F.when(F.col("reject_reason") == "malformed", "malformed")
        .when(~F.col("zoom").between(0, MAX_ZOOM), "zoom_range")
        .when(top <= bot, "lat_order")
        .when(left >= right, "lng_order")
        .when(F.col("action").isNull() | ~F.col("action").isin(ACTIONS), "unknown_action")
        .when(~grid.on_map(grid.centre_lat(), grid.centre_lng()), "off_map")
    )
    read = df.withColumn("reject_reason", F.when(nothing, "malformed"))
    return read.fillna(0, RECT).withColumn("reject_reason", reason)


def validate_telemetry(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good commands, and the rest with a ``reject_reason``."""
    checked = check_telemetry(df)
    good = checked.filter("reject_reason is null").drop("reject_reason")
    return good, checked.filter("reject_reason is not null")


def acknowledge(df: DataFrame) -> DataFrame:
    """One answer per command: message, status code and the command itself. A
    command without effect on its device is accepted like any other."""
    reason = F.col("reject_reason")
    message, status = F, F
    for name, (text, code) in REJECTIONS.items():
        shown = F.format_string(text, "action") if "%s" in text else F.lit(text)
        message, status = message.when(reason == name, shown), status.when(reason == name, code)
    return _answer(
        check_telemetry(df),
        ["action", *RECT],
        message.otherwise(ACCEPTED[0]),
        status.otherwise(ACCEPTED[1]),
        "telemetry_request",
    )


def acknowledge_selections(df: DataFrame) -> DataFrame:
    """One answer per area action: accepted at once, before it is carried out."""
    message, status = [F.lit(value) for value in ACCEPTED]
    return _answer(df, ["action", "rate", *RECT], message, status, "selection_request")


def _answer(
    df: DataFrame, fields: list[str], message: Column, status: Column, name: str
) -> DataFrame:
    kept = [c for c in df.columns if c not in (*fields, "reject_reason")]
    return df.select(
        *kept,
        message.alias("message"),
        status.alias("http_status_code"),
        F.struct(*[F.col(c).alias(JSON_NAMES.get(c, c)) for c in fields]).alias(name),
    )
