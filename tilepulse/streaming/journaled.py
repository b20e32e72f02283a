"""The device state machine on a stream whose state is the journal itself.

A micro-batch is one load: its commands go on from the states that the journal holds,
with the batch job's windows, and their events are appended. So a device with a large
share of a micro-batch is cut into chunks over several tasks, as in the batch job, and
no Python group holds a device's commands. A stream may start on any journal, and batch
loads may follow it: there is no state elsewhere to hand over.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.grid import RECT
from ..operators.lifecycle import ORDER, derive_events
from ..operators.skew import BROADCAST_ROWS, CHUNK_ROWS, broadcast_if_small
from ..sources.journal import append_journal, has_load, last_of_devices
from ..sources.telemetry import ACTIONS
from .projection import query_id


def stream_into_journal(
    cmds: DataFrame,
    path: str,
    checkpoint: str,
    tag_count: int = 1,
    interval: str | None = None,
    chunk_rows: int | None = CHUNK_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> StreamingQuery:
    """Append the change events of an unbounded command stream to the journal at ``path``,
    each micro-batch as a load of its own, exactly once: a load is named after the query
    and the micro-batch, and one that is listed is left alone when it is run again.

    Commands are put in order within a micro-batch; one that arrives in a later micro-batch
    is applied then. A journal has one writer at a time. ``interval`` is the longest
    wait, "10 seconds" say; without it the query takes what there is and ends.

    Each micro-batch reads the journal's last states (of n loads some log(n) tables) and
    keeps those of its own devices, so it suits large and rare micro-batches;
    ``devices.stream_device_events`` suits small and frequent ones.
    """
    spark = cmds.sparkSession
    writer: list[str] = []

    def append(batch: DataFrame, batch_id: int) -> None:
        if not writer:
            writer.append(query_id(spark, checkpoint))
        load_id = f"{writer[0]}-{batch_id}"
        if has_load(spark, path, load_id):
            return
        kept = batch.persist(StorageLevel.DISK_ONLY)
        try:
            concerned = broadcast_if_small(kept.select(*RECT).distinct(), broadcast_rows)
            initial = last_of_devices(spark, path).join(concerned, RECT, "left_semi")
            events = derive_events(kept, chunk_rows, initial)
            append_journal(events, path, tag_count, chunk_rows, load_id)
        finally:
            kept.unpersist()

    known = cmds.filter(F.col("action").isin(ACTIONS)).select(*ORDER, *RECT, "action")
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        known.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
