"""The device state machine on a stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.grid import RECT
from ..operators.lifecycle import EVENTS, ORDER, STATE_AFTER
from ..sources.telemetry import ACTIONS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def apply_commands(state: str, actions: Iterable[str]) -> tuple[list[str | None], str]:
    """The event of each of a device's commands, and the state after the last."""
    events = []
    for action in actions:
        event = EVENTS.get((state, action))
        state = STATE_AFTER.get(event, state)
        events.append(event)
    return events, state


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A device's commands of one micro-batch, in order, on top of its state."""
    parts = [[part[c].to_numpy() for c in [*ORDER, "code"]] for part in batches]
    ts, ident, code = [np.concatenate(column) for column in zip(*parts)]
    order = np.lexsort((ident, ts))
    start = state.get[0] if state.exists else "I"
    events, after = apply_commands(start, (ACTIONS[c] for c in code[order]))
    if after == "I":  # what a device without state is taken for
        if state.exists:
            state.remove()
    elif after != start:
        state.update((after,))
    changed = [i for i, event in enumerate(events) if event]
    if changed:
        kept = order[changed]
        columns = {"ts": ts[kept], "event_id": ident[kept], **dict(zip(RECT, key))}
        yield pd.DataFrame(columns | {"event_type": [events[i] for i in changed]})


def stream_device_events(cmds: DataFrame) -> DataFrame:
    """Change events of an unbounded command stream (columns as in the batch
    job, ``ts`` a timestamp). State is one letter per active device; it never expires,
    and goes when its device is deactivated.

    Commands are put in order within a micro-batch; one that arrives in a later
    micro-batch is applied then, in arrival order. A hot device's group is
    bounded by the micro-batch: set the source's rate limit
    (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``). On a cluster, keep state
    in RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    # A small number instead of a text: less to shuffle and to hold.
    code = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action")) - 1
    known = cmds.filter(F.col("action").isin(ACTIONS))
    fields = {f.name: f.dataType.simpleString() for f in cmds.schema}
    columns = [f"{c} {fields[c]}" for c in [*ORDER, *RECT]]
    return (
        known.select(*ORDER, *RECT, code.cast("tinyint").alias("code"))
        .groupBy(*RECT)
        .applyInPandasWithState(
            _step,
            ", ".join([*columns, "event_type string"]),
            "state string",
            "append",
            GroupStateTimeout.NoTimeout,
        )
    )


def stream_commands(reader, path: str) -> DataFrame:
    """A stream over Parquet command files with the time as a timestamp."""
    cmds = reader.parquet(path)
    return cmds.withColumn("ts", F.col("ts").cast("timestamp"))
