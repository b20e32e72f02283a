import datetime
import json
import random
import time

import pytest
from models import fold
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from conftest import SMALL
from test_lifecycle import ACTIONS, commands, crowd, model
from test_sources import rows_of
from tilepulse.operators import activity, lifecycle, summary
from tilepulse.plans import inputs
from tilepulse.sources import journal, store
from tilepulse.streaming import devices, events, journaled, projection
from tilepulse.sources.workspace import workspace


def test_commands_of_one_micro_batch_equal_the_fold():
    rng = random.Random(6)
    for _ in range(200):
        start = rng.choice("IHS")
        actions = [rng.choice(ACTIONS) for _ in range(rng.randrange(1, 12))]
        found, end = devices.apply_commands(start, actions)
        events, states = fold(((i, 0, a) for i, a in enumerate(actions)), start)
        assert end == states[0]
        assert [(i, event) for i, event in enumerate(found) if event] == events


def write_parts(spark, triples, path, parts):
    """Command files in time order, one modification time after the other."""
    ordered = sorted(enumerate(triples), key=lambda p: (p[1][0], p[0]))
    cmds = commands(spark, [t for _, t in ordered])
    size = -(-len(triples) // parts)
    for i in range(parts):
        part = cmds.filter(F.col("event_id").between(i * size, (i + 1) * size - 1)).coalesce(1)
        part.write.mode("append").parquet(path)
        time.sleep(0.05)
    return cmds


def stream_files(spark, schema, path, files=1):
    reader = projection.group_within(spark.readStream.schema(schema), files)
    return devices.stream_commands(reader, path)


def run(stream, out):
    query = (
        stream.writeStream.format("parquet")
        .option("path", out + "/rows")
        .option("checkpointLocation", out + "/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


@pytest.mark.parametrize("parts, provider", [(1, None), (6, devices.ROCKSDB)])
def test_device_stream_equals_batch_for_any_split(spark, tmp_path, parts, provider):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    if provider:
        spark.conf.set(key, provider)
    try:
        triples = crowd(51, 400)
        cmds = write_parts(spark, triples, str(tmp_path / "in"), parts)
        stream = stream_files(spark, cmds.schema, str(tmp_path / "in"))
        query = run(devices.stream_device_events(stream), str(tmp_path / "out"))
        assert len({p["batchId"] for p in query.recentProgress if p["numInputRows"]}) == parts
    finally:
        spark.conf.set(key, before)
    got = spark.read.parquet(str(tmp_path / "out/rows")).collect()
    want = lifecycle.derive_events(cmds).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_device_state_survives_a_restart(spark, tmp_path):
    triples = sorted(crowd(52, 300))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    cmds = commands(spark, triples)
    for half in ("event_id < 150", "event_id >= 150"):
        cmds.filter(half).coalesce(1).write.mode("append").parquet(source)
        run(devices.stream_device_events(stream_files(spark, cmds.schema, source)), out)
    got = sorted((r.event_id, r.event_type) for r in spark.read.parquet(out + "/rows").collect())
    assert got == sorted(model(triples)[0])


@pytest.fixture(scope="module")
def event_files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "in")
    events = inputs.device_events(spark, SMALL).withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(6).write.parquet(path)
    return events, path


def test_projection_adds_every_event_once(spark, event_files, tmp_path):
    events, path = event_files
    table, checkpoint = str(tmp_path / "tiles"), str(tmp_path / "checkpoint")
    for _ in range(2):  # the second run finds nothing new
        stream = projection.group_within(spark.readStream.schema(events.schema), 2).parquet(path)
        projection.run_projection(stream, table, checkpoint, offset="event_id").awaitTermination()
    assert rows_of(store.read_tiles(spark, table)) == rows_of(summary.summarize_all(events))
    assert store.saved_offset(spark, table) == events.agg(F.max("event_id")).head()[0]
    # A micro-batch that is run again, after a crash between write and checkpoint:
    writer = json.loads((tmp_path / "checkpoint/metadata").read_text())["id"]
    store.append_deltas(summary.summarize_all(events), table, 1, writer=writer)
    assert rows_of(store.read_tiles(spark, table)) == rows_of(summary.summarize_all(events))


def test_a_second_checkpoint_needs_a_key_of_its_own(spark, event_files, tmp_path):
    events, path = event_files
    table = str(tmp_path / "tiles")

    def start(checkpoint, key):
        stream = spark.readStream.schema(events.schema).parquet(path)
        return projection.run_projection(stream, table, str(tmp_path / checkpoint), key=key)

    start("one", "a").awaitTermination()
    with pytest.raises(StreamingQueryException):
        start("two", "a").awaitTermination()
    start("three", "b").awaitTermination()
    doubled = events.unionByName(events)
    assert rows_of(store.read_tiles(spark, table)) == rows_of(summary.summarize_all(doubled))


def test_a_micro_batch_is_computed_once(spark, tmp_path):
    triples = crowd(53, 300)
    cmds = write_parts(spark, triples, str(tmp_path / "in"), 1)
    calls = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(_):
        calls.add(1)
        return True

    events = lifecycle.derive_events(cmds)
    events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "events"))
    stored = spark.read.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(stored.schema).parquet(str(tmp_path / "events"))
    counted = stream.filter(seen.asNondeterministic()("event_id"))
    projection.run_projection(
        counted, str(tmp_path / "tiles"), str(tmp_path / "cp"), offset="event_id"
    ).awaitTermination()
    assert calls.value == stored.count()


def test_projection_on_a_trigger_interval(spark, event_files, tmp_path):
    events, path = event_files
    stream = projection.group_within(spark.readStream.schema(events.schema), 3).parquet(path)
    query = projection.run_projection(
        stream, str(tmp_path / "tiles"), str(tmp_path / "cp"), interval="1 second"
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = store.read_tiles(spark, str(tmp_path / "tiles"))
    assert rows_of(got) == rows_of(summary.summarize_all(events))


def test_running_tile_counts(spark, event_files, tmp_path):
    events, path = event_files
    out = str(tmp_path / "out")
    stream = projection.group_within(spark.readStream.schema(events.schema), 3).parquet(path)
    counted = projection.stream_tile_counts(stream)
    projection.keep_latest(counted, out, str(tmp_path / "cp")).awaitTermination()
    got = projection.latest(spark.read.parquet(out), ["zoom", "row", "col"])
    assert rows_of(got) == rows_of(summary.summarize_all(events))


def test_activity_on_a_stream(spark, event_files, tmp_path):
    events, path = event_files
    out = str(tmp_path / "out")
    stream = projection.group_within(spark.readStream.schema(events.schema), 1).parquet(path)
    steps = projection.stream_activity(stream, 3600)
    projection.keep_latest(steps, out, str(tmp_path / "cp")).awaitTermination()
    newest = projection.latest(spark.read.parquet(out), ["step"])
    got = activity.recent_samples(newest, 3600).collect()
    assert sorted(got) == sorted(activity.activity(events, 3600).collect()) and len(got) == 180


def test_workspace_lies_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert workspace(spark, "x").startswith(shared + "/x-")
    assert workspace(spark, "x") != workspace(spark, "x")


def test_late_command_is_applied_on_arrival(spark, tmp_path):
    """Across micro-batches arrival decides, as for a service fed over a network."""
    start = datetime.datetime(2024, 1, 1)
    cmds = commands(spark, [(9, 0, "create"), (1, 0, "sad")])
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in (0, 1):
        cmds.filter(F.col("event_id") == i).coalesce(1).write.mode("append").parquet(source)
        run(devices.stream_device_events(stream_files(spark, cmds.schema, source)), out)
    got = {r.event_type: r.ts for r in spark.read.parquet(out + "/rows").collect()}
    assert set(got) == {"DeviceActivated", "DeviceMadeSad"}
    assert got["DeviceMadeSad"] == start + datetime.timedelta(seconds=1)


def stream_to(query_rows, target, spark):
    """Run a stream to its end; the events of each micro-batch."""
    sizes = []

    def write(batch, batch_id):
        batch.persist()
        sizes.append(batch.count())
        batch.write.mode("append").parquet(f"{target}/out")
        batch.unpersist()

    writer = query_rows.writeStream.foreachBatch(write)
    events.drained(writer.option("checkpointLocation", f"{target}/checkpoint").start())
    return sizes


def test_the_journal_as_a_stream_in_groups_of_events(spark, tmp_path):
    path = str(tmp_path / "journal")
    all_events = inputs.device_events(spark, SMALL)
    early = F.pmod("event_id", F.lit(3)) != 0
    journal.append_journal(all_events.filter(early), path, 4)
    journal.append_journal(all_events.limit(0), path, 4)  # an empty load
    total = journal.read_journal(spark, path).count()
    sizes = stream_to(events.stream_events(spark, path, 200), tmp_path / "a", spark)
    assert max(sizes) <= 200 and sum(sizes) == total and len(sizes) == -(-total // 200)
    journal.append_journal(all_events.filter(~early), path, 4)
    more = stream_to(events.stream_events(spark, path, 130), tmp_path / "a", spark)  # goes on
    rows = journal.read_journal(spark, path)
    assert max(more) <= 130 and sum(more) == rows.count() - total
    got = spark.read.parquet(str(tmp_path / "a/out")).select(*rows.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))


def test_a_tag_of_the_journal_past_an_offset(spark, tmp_path):
    path = str(tmp_path / "journal")
    journal.append_journal(inputs.device_events(spark, SMALL), path, 4)
    after = (1 << journal.PLACE_BITS) + 333
    stream = events.stream_events(spark, f"file://{path}", 200, "2", after)
    sizes = stream_to(stream.select("ordering", "tag"), tmp_path / "a", spark)
    want = journal.events_by_tag(journal.read_journal(spark, path), None, "2", after).select("ordering", "tag")
    got = spark.read.parquet(str(tmp_path / "a/out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and sum(sizes) > 0


def test_counts_from_the_journal_as_a_stream(spark, tmp_path):
    path, tiles = str(tmp_path / "journal"), str(tmp_path / "tiles")
    journal.append_journal(inputs.device_events(spark, SMALL), path, 4)
    query = projection.run_projection(
        events.stream_events(spark, path, 400), tiles, str(tmp_path / "c"), interval="0 seconds", offset="ordering", compact_every=3
    )
    events.drained(query)
    want = summary.summarize_all(journal.read_journal(spark, path))
    got = store.read_tiles(spark, tiles).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def journal_events(spark, path):
    rows = journal.read_journal(spark, path)
    return sorted(map(tuple, rows.select("top_left_lng", "sequence_number", "event_type").collect()))


@pytest.mark.parametrize("parts, limits", [(1, {}), (4, {"chunk_rows": 9, "broadcast_rows": 0})])
def test_stream_into_a_journal_goes_on_where_the_batch_ended(spark, tmp_path, parts, limits):
    triples = sorted(crowd(57, 400))
    cmds = commands(spark, triples)
    first, later = cmds.filter("event_id < 150"), triples[150:]
    path, whole = str(tmp_path / "journal"), str(tmp_path / "whole")
    journal.append_journal(lifecycle.derive_events(first), path, 4)
    write_parts(spark, later, str(tmp_path / "in"), parts)
    for _ in range(2):  # the second run finds nothing new
        stream = stream_files(spark, cmds.schema, str(tmp_path / "in"))
        query = journaled.stream_into_journal(stream, path, str(tmp_path / "checkpoint"), 4, **limits)
        query.awaitTermination()
    journal.append_journal(lifecycle.derive_events(cmds), whole, 4)
    assert journal_events(spark, path) == journal_events(spark, whole)


def test_a_load_of_a_stream_is_appended_once(spark, tmp_path):
    triples = crowd(58, 200)
    cmds = write_parts(spark, triples, str(tmp_path / "in"), 1)
    path, checkpoint = str(tmp_path / "journal"), tmp_path / "checkpoint"

    def go_on():
        stream = stream_files(spark, cmds.schema, str(tmp_path / "in"))
        journaled.stream_into_journal(stream, path, str(checkpoint), 2).awaitTermination()

    go_on()
    found = journal_events(spark, path)
    for commit in (checkpoint / "commits").iterdir():  # as after a crash before the commit
        commit.unlink()
    go_on()
    assert journal_events(spark, path) == found
    # Micro-batches without a change, and without a command.
    commands(spark, []).write.mode("append").parquet(str(tmp_path / "in"))
    go_on()
    assert journal_events(spark, path) == found


def test_a_hot_device_of_a_micro_batch_is_no_python_group(spark, tmp_path):
    cmds = commands(spark, crowd(59, 300))
    initial = lifecycle.replay(lifecycle.derive_events(cmds))
    plan = lifecycle.derive_events(cmds, 20, initial)._jdf.queryExecution().optimizedPlan().toString()
    python = plan[plan.index("FlatMapGroupsInPandas") :]
    assert "Aggregate" in python  # one row per chunk reaches the fold, not the commands
