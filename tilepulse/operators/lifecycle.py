"""The device state machine: commands to events, states and outcomes.

A device is a rectangle. It is inactive (I), active and happy (H) or active and
sad (S). create and ping activate an inactive device (happy); delete deactivates
an active one; happy and sad switch an active device's mood. Everything else is
accepted and changes nothing.

Two facts make this a job for window functions instead of a fold:

* a device is active iff its latest create, ping or delete was not a delete;
* an active device's mood was set by its latest activation, or by the latest
  happy or sad it received while active.

Commands of a device are ordered by ``(ts, event_id)``. If one device holds a
large share of all commands its history is cut into chunks (see ``skew``). What
a chunk does to each of the three states is a function; folding the functions of
a device's chunks (one row each) gives every chunk the state it starts in.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.grid import DEVICE, RECT
from .skew import CHUNK_ROWS, Splits, split_points, with_chunk

ORDER = ["ts", "event_id"]

# State x command -> event.
EVENTS = {
    ("I", "create"): "DeviceActivated",
    ("I", "ping"): "DeviceActivated",
    ("H", "delete"): "DeviceDeactivatedHappy",
    ("S", "delete"): "DeviceDeactivatedSad",
    ("S", "happy"): "DeviceMadeHappy",
    ("H", "sad"): "DeviceMadeSad",
}
# Event -> state it leads to.
STATE_AFTER = {
    "DeviceActivated": "H",
    "DeviceDeactivatedHappy": "I",
    "DeviceDeactivatedSad": "I",
    "DeviceMadeHappy": "H",
    "DeviceMadeSad": "S",
}


def _before(keys: list[str]) -> WindowSpec:
    """The device's earlier commands."""
    line = Window.partitionBy(*keys).orderBy(*ORDER)
    return line.rowsBetween(Window.unboundedPreceding, -1)


def _activity() -> Column:
    action = F.col("action")
    return F.when(action.isin("create", "ping"), True).when(action == "delete", False)


def _mood(active_before: Column) -> Column:
    """The mood a command sets, if any, given whether the device is active."""
    action = F.col("action")
    starts = ~active_before & action.isin("create", "ping")
    return F.when(starts | (active_before & (action == "happy")), "H").when(
        active_before & (action == "sad"), "S"
    )


def _event(state: Column) -> Column:
    branches = F
    for (before, action), event in EVENTS.items():
        branches = branches.when((state == before) & (F.col("action") == action), F.lit(event))
    return branches


def event_to_state(event: Column) -> Column:
    branches = F
    for name, state in STATE_AFTER.items():
        branches = branches.when(event == name, F.lit(state))
    return branches


def device_history(
    cmds: DataFrame, chunk_rows: int | None = CHUNK_ROWS, initial: DataFrame | None = None
) -> DataFrame:
    """Every command with ``state_before``, ``event_type`` (null for a no-op) and
    ``state_after``. One shuffle and one sort for devices of ordinary size.

    ``chunk_rows`` bounds the commands of one device that one task handles; None
    skips the look for hot devices. ``initial`` (rectangle and ``state``, one row per
    device) is where the devices stand before these commands, from ``replay`` or a
    journal, say; a device that it does not list is inactive.
    """
    splits = None if chunk_rows is None else split_points(cmds, RECT, ORDER, chunk_rows)
    known = None if initial is None else initial.select(*RECT, F.col("state").alias("start"))
    keys, started = DEVICE, cmds.withColumn("start", F.lit("I"))
    if splits is None and known is not None:
        started = cmds.join(known, RECT, "left").fillna("I", ["start"])
    elif splits is not None:
        keys, chunked = [*DEVICE, "chunk"], with_chunk(cmds, RECT, ORDER, splits)
        starts = _chunk_starts(chunked, splits, known)  # one row per chunk of a hot device
        if known is None:
            starts = splits.side(starts)
        else:  # others are one chunk; by chunk, so that no join gathers a hot device
            others = known.join(splits.hot(), RECT, "left_anti")
            starts = starts.unionByName(others.withColumn("chunk", F.lit(0)))
        started = chunked.join(starts, keys, "left").fillna("I", ["start"])

    known = F.last("activity", ignorenulls=True).over(_before(keys))
    mood = F.last("mood", ignorenulls=True).over(_before(keys))
    active, start = F.col("active_before"), F.col("start")
    return (
        started.withColumn("activity", _activity())
        .withColumn("active_before", F.coalesce(known, start != "I"))
        .withColumn("mood", _mood(active))
        .withColumn("mood_before", mood)
        .withColumn(
            "state_before", F.when(active, F.coalesce("mood_before", start)).otherwise("I")
        )
        .withColumn("event_type", _event(F.col("state_before")))
        .withColumn("state_after", F.coalesce(event_to_state(F.col("event_type")), "state_before"))
        .drop("activity", "active_before", "mood", "mood_before", "start", "chunk")
    )


def _chunk_starts(chunked: DataFrame, splits: Splits, initial: DataFrame | None) -> DataFrame:
    """State ``start`` in which each chunk of a hot device begins, if ``initial`` (with
    ``start``) is where devices stand before the first."""
    known = F.last("activity", ignorenulls=True).over(_before([*DEVICE, "chunk"]))
    here = F.struct(*ORDER)

    def final(column: str) -> Column:
        return F.max_by(column, F.when(F.col(column).isNotNull(), here))

    effects = (
        chunked.join(splits.hot(), RECT, "left_semi")
        .select(*RECT, "chunk", "action", *ORDER, _activity().alias("activity"))
        .withColumn("mood_if_inactive", _mood(F.coalesce(known, F.lit(False))))
        .withColumn("mood_if_active", _mood(F.coalesce(known, F.lit(True))))
        .groupBy(*RECT, "chunk")
        .agg(
            final("activity").alias("activity"),
            final("mood_if_inactive").alias("mood_if_inactive"),
            final("mood_if_active").alias("mood_if_active"),
        )
    )
    if initial is None:
        effects = effects.withColumn("start", F.lit("I"))
    else:
        effects = effects.join(initial, RECT, "left").fillna("I", ["start"])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk").reset_index(drop=True)
        starts, state = [], pdf["start"][0]
        for row in pdf.itertuples():
            starts.append(state)
            mood = row.mood_if_inactive if state == "I" else row.mood_if_active
            active = state != "I" if pd.isna(row.activity) else bool(row.activity)
            state = (state if pd.isna(mood) else mood) if active else "I"
        return pdf[[*RECT, "chunk"]].assign(start=starts)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in effects.schema[:6])
    return effects.groupBy(*RECT).applyInPandas(fold, schema + ", start string")


def derive_events(
    cmds: DataFrame, chunk_rows: int | None = CHUNK_ROWS, initial: DataFrame | None = None
) -> DataFrame:
    """The change events: commands that changed their device's state."""
    return (
        device_history(cmds, chunk_rows, initial)
        .filter("event_type is not null")
        .select(*ORDER, *RECT, "event_type")
    )


def command_outcomes(
    cmds: DataFrame, chunk_rows: int | None = CHUNK_ROWS, initial: DataFrame | None = None
) -> DataFrame:
    """Per action: how many commands took effect and how many did not."""
    return (
        device_history(cmds, chunk_rows, initial)
        .groupBy("action", F.col("event_type").isNotNull().alias("effective"))
        .agg(F.count("*").alias("command_count"))
    )


def device_state(
    cmds: DataFrame, chunk_rows: int | None = CHUNK_ROWS, initial: DataFrame | None = None
) -> DataFrame:
    """Each device's state after its last command."""
    return (
        device_history(cmds, chunk_rows, initial)
        .groupBy(*RECT)
        .agg(F.max_by("state_after", F.struct(*ORDER)).alias("state"))
    )


def replay(events: DataFrame, order: list[str] = ORDER) -> DataFrame:
    """Each device's state rebuilt from its event log: the last event decides."""
    last = F.max_by("event_type", F.struct(*order))
    return events.groupBy(*RECT).agg(event_to_state(last).alias("state"))
