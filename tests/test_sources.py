import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SMALL
from test_lifecycle import commands, crowd
from tilepulse.functions.grid import COUNTS, TILE
from tilepulse.functions.keys import text_hash
from tilepulse.operators import lifecycle, summary
from tilepulse.operators.viewport import Area, viewport
from tilepulse.plans import inputs
from tilepulse.sources import journal, store, telemetry

TILES = "zoom int, row int, col int, device_count long, happy_count long, sad_count long"


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*TILE, *COUNTS).collect())


def request(**changes):
    fields = {"action": "create", "zoom": 18, "topLeftLat": 2.0, "topLeftLng": 1.0,
              "botRightLat": 1.0, "botRightLng": 2.0}
    return {**fields, **changes}


REQUESTS = [
    (request(), None),
    (request(action="ping"), None),
    (request(zoom=19), "zoom_range"),
    (request(zoom=-1), "zoom_range"),
    (request(topLeftLat=1.0), "lat_order"),
    (request(topLeftLng=2.0), "lng_order"),
    (request(action="Create"), "unknown_action"),
    (request(action=None), "unknown_action"),
    (request(topLeftLat=99.0, botRightLat=91.0), "off_map"),
    (request(topLeftLat=99.0, botRightLat=80.0), None),
    ({"action": "create"}, "lat_order"),
    ({k: v for k, v in request().items() if k != "topLeftLng"}, None),  # taken as zero
    ("{not json", "malformed"),
]


@pytest.fixture
def request_file(tmp_path):
    lines = [r if isinstance(r, str) else json.dumps(r) for r, _ in REQUESTS]
    (tmp_path / "requests.json").write_text("\n".join(lines))
    return str(tmp_path)


def test_telemetry_is_read_and_sorted_into_good_and_rejected(spark, request_file):
    good, rejected = telemetry.validate_telemetry(telemetry.read_telemetry(spark, request_file))
    reasons = sorted(r.reject_reason for r in rejected.collect())
    assert reasons == sorted(reason for _, reason in REQUESTS if reason)
    assert good.count() == 4 and good.columns == ["action", *lifecycle.RECT]


def test_telemetry_from_a_text_column_and_as_a_stream(spark, request_file, tmp_path_factory):
    text = spark.read.text(request_file)
    assert telemetry.parse_telemetry(text).count() == len(REQUESTS)
    out = str(tmp_path_factory.mktemp("out"))
    stream = telemetry.read_telemetry(spark, request_file, streaming=True)
    (stream.writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", out + "/cp").trigger(availableNow=True).start()
     .awaitTermination())
    assert spark.read.schema(stream.schema).parquet(out).count() == len(REQUESTS)


def test_acknowledgements(spark, request_file):
    acks = telemetry.acknowledge(telemetry.read_telemetry(spark, request_file)).collect()
    assert sorted(a.http_status_code for a in acks) == [200] * 4 + [400] * 7 + [500] * 2
    wrong = [a for a in acks if a.telemetry_request.action == "Create"][0]
    assert wrong.message.startswith("Action 'Create' is unknown") and "ping" in wrong.message
    assert {a.message for a in acks if a.http_status_code == 200} == {"Accepted"}


def test_selections_are_read(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({**request(), "rate": 100}))
    row = telemetry.read_selections(spark, str(tmp_path)).head()
    assert (row.action, row.rate, row.zoom, row.top_left_lat) == ("create", 100, 18, 2.0)


def test_upserts(spark):
    current = spark.createDataFrame([(5, 1, 1, 3, 2, 1), (5, 1, 2, 1, 1, 0)], TILES)
    changes = spark.createDataFrame([(5, 1, 1, -1, -1, 0), (5, 9, 9, 1, 1, 0)], TILES)
    added = rows_of(store.upsert_tiles(current, changes))
    assert added == [(5, 1, 1, 2, 1, 1), (5, 1, 2, 1, 1, 0), (5, 9, 9, 1, 1, 0)]
    replaced = rows_of(store.upsert_tiles(current, changes, "replace"))
    assert replaced == [(5, 1, 1, -1, -1, 0), (5, 1, 2, 1, 1, 0), (5, 9, 9, 1, 1, 0)]
    with pytest.raises(ValueError):
        store.upsert_tiles(current, changes, "merge")


def test_store_adds_batches_once_and_compacts(spark, tmp_path):
    path = str(tmp_path / "tiles")
    first = spark.createDataFrame([(5, 1, 1, 3, 2, 1), (18, 7, 8, 1, 1, 0)], TILES)
    second = spark.createDataFrame([(5, 1, 1, -1, -1, 0), (6, 2, 3, 1, 0, 1)], TILES)
    assert store.read_tiles(spark, path).count() == 0 and store.compact_tiles(spark, path) is None
    store.append_deltas(first, path, 0, offset=10)
    store.append_deltas(first, path, 0, offset=10)  # the same batch again
    assert rows_of(store.read_tiles(spark, path)) == rows_of(first)
    assert store.compact_tiles(spark, path) == 1
    store.append_deltas(second, path, 1, offset=20)
    want = [(5, 1, 1, 2, 1, 1), (6, 2, 3, 1, 0, 1), (18, 7, 8, 1, 1, 0)]
    assert rows_of(store.read_tiles(spark, path)) == want
    assert store.compact_tiles(spark, path) == 2 and store.compact_tiles(spark, path) == 2
    assert rows_of(store.read_tiles(spark, path)) == want
    store.append_deltas(second, path, 1, offset=20)  # a folded batch again
    assert rows_of(store.read_tiles(spark, path)) == want
    assert store.saved_offset(spark, path) == 20


def test_projection_keys_have_batches_of_their_own(spark, tmp_path):
    path = str(tmp_path / "tiles")
    one = spark.createDataFrame([(5, 1, 1, 1, 1, 0)], TILES)
    for key in ("a", "b"):
        store.append_deltas(one, path, 0, offset=7, key=key)
        store.append_deltas(one, path, 0, offset=7, projection="other", key=key)
    assert rows_of(store.read_tiles(spark, path)) == [(5, 1, 1, 4, 4, 0)]
    assert store.read_progress(spark, path).count() == 4
    store.append_deltas(one, path, 0, key="c", writer="first checkpoint")
    for _ in range(2):  # refused before and after compaction
        with pytest.raises(ValueError):
            store.append_deltas(one, path, 1, key="c", writer="second checkpoint")
        store.compact_tiles(spark, path)


def test_the_table_stays_small_over_many_batches(spark, tmp_path):
    path = tmp_path / "tiles"
    for batch in range(12):
        rows = [(5, 1, 1, 1, 1, 0), (18, batch, 2, 1, 0, 1)]
        store.append_deltas(spark.createDataFrame(rows, TILES), str(path), batch, offset=batch)
        if batch % 2:
            store.compact_tiles(spark, str(path))
    want = [(5, 1, 1, 12, 12, 0), *[(18, b, 2, 1, 0, 1) for b in range(12)]]
    assert rows_of(store.read_tiles(spark, str(path))) == want
    listed = [f for f in (path / "progress").rglob("*.json")]
    assert len(listed) <= 2 * (store.KEPT_VERSIONS + 3)
    assert len(list((path / "deltas").rglob("batch=*"))) <= 2 * (store.KEPT_VERSIONS + 1)


def test_replacing_in_the_stored_table(spark, tmp_path):
    path = str(tmp_path / "tiles")
    first = spark.createDataFrame([(5, 1, 1, 3, 2, 1), (18, 7, 8, 1, 1, 0)], TILES)
    store.append_deltas(first, path, 0)
    given = spark.createDataFrame([(5, 1, 1, 1, 1, 0), (6, 2, 3, 1, 0, 1)], TILES)
    for _ in range(2):
        store.replace_tiles(given, path, 1)
    assert rows_of(store.read_tiles(spark, path)) == [
        (5, 1, 1, 1, 1, 0), (6, 2, 3, 1, 0, 1), (18, 7, 8, 1, 1, 0),
    ]


def test_stored_deltas_prune_by_zoom(spark, tmp_path):
    path = str(tmp_path / "tiles")
    store.append_deltas(inputs.fleet_tiles(spark, SMALL), path, 0)
    store.compact_tiles(spark, path)
    store.append_deltas(inputs.fleet_tiles(spark, SMALL), path, 1)
    shown = viewport(store.read_tiles(spark, path), Area(8, 60.0, -100.0, -60.0, 100.0))
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(zoom") == 2


def test_unfinished_batch_does_not_count(spark, tmp_path):
    path = str(tmp_path / "tiles")
    df = spark.createDataFrame([(5, 1, 1, 3, 2, 1)], TILES)
    store.append_deltas(df, path, 0)
    store.bulk_load(df, f"{path}/{store._delta_folder('tiles', '', 1)}")  # no progress row
    assert rows_of(store.read_tiles(spark, path)) == rows_of(df)
    store.append_deltas(df, path, 1)  # the retry replaces what was left
    assert rows_of(store.read_tiles(spark, path)) == [(5, 1, 1, 6, 4, 2)]


def test_viewport_on_the_stored_table_prunes(spark, tmp_path):
    path = str(tmp_path / "base")
    store.bulk_load(inputs.fleet_tiles(spark, SMALL), path, file_rows=100)
    files = spark.read.parquet(path).select(F.input_file_name()).distinct().count()
    assert files > 16
    shown = viewport(store.read_base(spark, path), Area(8, 60.0, -100.0, -60.0, 100.0))
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(zoom" in plan
    pushed = plan.split("PushedFilters:")[1]
    assert "GreaterThanOrEqual(row" in pushed and "LessThanOrEqual(col" in pushed


@pytest.mark.parametrize("chunk_rows", [None, 30])
def test_journal_numbers_each_devices_events(spark, tmp_path, chunk_rows):
    events = lifecycle.derive_events(commands(spark, crowd(41, 900)))
    path = str(tmp_path / "journal")
    journal.append_journal(events, path, 4, chunk_rows)
    rows = journal.read_journal(spark, path).orderBy("write_timestamp", "ordering").collect()
    numbers = {}
    for r in rows:
        numbers.setdefault(r.persistence_id, []).append(r.sequence_number)
    assert len(rows) == events.count()
    assert all(n == list(range(1, len(n) + 1)) for n in numbers.values())


@pytest.mark.parametrize("chunk_rows", [None, 30])
def test_loads_go_on_where_the_last_one_ended(spark, tmp_path, chunk_rows):
    cmds = commands(spark, crowd(43, 900))
    whole = lifecycle.derive_events(cmds).collect()
    path, known = str(tmp_path / "journal"), None
    thirds = cmds.withColumn("third", F.ntile(3).over(Window.orderBy(*journal.ORDER)))
    for i in range(3):
        part = thirds.filter(F.col("third") == i + 1).drop("third")
        events = lifecycle.derive_events(part, chunk_rows, initial=known)
        for _ in range(2):  # the second time it is listed already
            journal.append_journal(events, path, 4, chunk_rows, load_id=f"load {i}")
        known = journal.last_of_devices(spark, path)
    rows = journal.read_journal(spark, path)
    assert rows.select("persistence_id", "sequence_number").distinct().count() == len(whole)
    assert sorted(r.event_type for r in rows.collect()) == sorted(r.event_type for r in whole)
    states = {tuple(r[:5]): r.state for r in lifecycle.device_state(cmds).collect()}
    replayed = lifecycle.replay(rows, ["sequence_number"]).collect()
    assert all(states[tuple(r[:5])] == r.state for r in replayed)


def test_increments_of_several_loads_and_a_pause(spark, tmp_path):
    path, tiles = str(tmp_path / "journal"), str(tmp_path / "tiles")
    events = inputs.fleet_events(spark, SMALL)
    journal.set_paused(spark, path, "tiles", "1", True)
    for part in ("event_id >= 0", "event_id < 0"):  # smaller ids come later
        journal.append_journal(events.filter(part), path, 3)
        assert journal.project_increment(spark, path, tiles)
        assert not journal.project_increment(spark, path, tiles)
    assert rows_of(store.read_tiles(spark, tiles)) != rows_of(summary.summarize_all(events))
    journal.set_paused(spark, path, "tiles", "1", False)
    assert journal.project_increment(spark, path, tiles)
    assert rows_of(store.read_tiles(spark, tiles)) == rows_of(summary.summarize_all(events))


def test_offsets_of_other_projections_are_kept(spark):
    schema = "projection_name string, projection_key string, current_offset long"
    progress = spark.createDataFrame([("p", "0", 5), ("q", "0", 9)], schema)
    rows = journal.journal_rows(inputs.device_events(spark, SMALL), 1)
    _, moved = journal.run_incremental(rows, progress, "p")
    assert {(r[0], r[1]) for r in moved.collect()} == {("p", "0"), ("q", "0")}
    assert [r[2] for r in moved.collect() if r[0] == "q"] == [9]


def test_text_hash_of_any_text(spark):
    words = [("abc",), ("",), (None,), ("é€",)]
    rows = spark.createDataFrame(words, "w string").select("w", text_hash("w").alias("h")).collect()
    want = {"abc": 96354, "": 0, None: None, "é€": 233 * 31 + 8364}
    assert {r.w: r.h for r in rows} == want


def test_events_by_tag_in_order_after_offset(spark, tmp_path):
    path = str(tmp_path / "journal")
    journal.append_journal(inputs.device_events(spark, SMALL), path, 4)
    rows = journal.read_journal(spark, path)
    after = (1 << journal.PLACE_BITS) + 50
    one = journal.events_by_tag(rows, None, "2", after)
    got = [r.ordering for r in one.collect()]
    assert got == sorted(got) and got and min(got) > after
    plan = one._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert "isnotnull(tag" in filters and "isnotnull(load" in filters
    tags = journal.event_tags(rows)
    assert [r.ordering for r in journal.events_by_tag(rows, tags, "2", after).collect()] == got


def test_increments_sum_to_the_full_run_and_pauses_hold(spark):
    rows = journal.journal_rows(inputs.device_events(spark, SMALL), 3).cache()
    schema = "projection_name string, projection_key string, current_offset long"
    progress, totals = spark.createDataFrame([], schema), {}
    first = 1 << journal.PLACE_BITS
    for top in (first + 100, first + 100, first + 250, 1 << 62):  # the journal as it grows; the second run finds nothing
        due, moved = journal.run_incremental(rows.filter(F.col("ordering") <= top), progress, "p")
        for r in journal.tag_deltas(due).collect():
            totals[r.tag] = totals.get(r.tag, 0) + r.event_total
        progress = spark.createDataFrame(moved.collect(), schema)
    want = {r.tag: r["count"] for r in rows.groupBy("tag").count().collect()}
    assert totals == want

    nothing = spark.createDataFrame([], schema)
    held = spark.createDataFrame(
        [("p", "1", True), ("p", "2", False), ("other", "0", True)],
        "projection_name string, projection_key string, paused boolean",
    )
    due, moved = journal.run_incremental(rows, nothing, "p", held)
    assert {r.tag for r in due.select("tag").distinct().collect()} == set(want) - {"1"}
    assert "1" not in {r.projection_key for r in moved.collect()}


def test_tag_histogram_lists_every_tag(spark):
    devices = inputs.commands(spark, SMALL).select(*lifecycle.RECT).distinct()
    rows = summary.tag_histogram(devices, 40).collect()
    assert sorted(int(r.tag) for r in rows) == list(range(40))
    assert sum(r.device_total for r in rows) == devices.count()


def loads_read(df):
    """The folders of loads that a plan's scans list."""
    files = [f for f in df.inputFiles() if "/events/" in f]
    return {int(f.split("/load=")[1].split("/")[0]) for f in files}


def test_an_increment_reads_only_new_loads(spark, tmp_path):
    path, tiles = str(tmp_path / "journal"), str(tmp_path / "tiles")
    events = inputs.device_events(spark, SMALL)
    journal.set_paused(spark, path, "tiles", "1", True)
    for part in range(3):
        journal.append_journal(events.filter(F.pmod("event_id", F.lit(3)) == part), path, 3)
        progress = store.read_progress(spark, tiles)
        due = journal.due_loads(spark, path, progress, "tiles")
        assert due == [part + 1]
        assert loads_read(journal.read_loads(spark, path, due)) == {part + 1}
        assert journal.project_increment(spark, path, tiles, compact_every=2)
        assert not journal.project_increment(spark, path, tiles)
    journal.set_paused(spark, path, "tiles", "1", False)
    assert journal.due_loads(spark, path, store.read_progress(spark, tiles), "tiles") == [1, 2, 3]
    assert journal.project_increment(spark, path, tiles)
    assert rows_of(store.read_tiles(spark, tiles)) == rows_of(summary.summarize_all(events))


def test_the_manifest_lists_files_and_their_places(spark, tmp_path):
    path = str(tmp_path / "journal")
    events = inputs.device_events(spark, SMALL)
    for part in range(2):
        journal.append_journal(events.filter(F.pmod("event_id", F.lit(2)) == part), path, 4)
    rows = journal.read_journal(spark, path)
    want = rows.groupBy("tag", F.shiftright("ordering", 40).cast("int").alias("load")).agg(
        F.min("ordering"), F.max("ordering"), F.count("*")
    )
    got = journal.read_manifest(spark, path).groupBy("tag", "load").agg(
        F.min("first"), F.max("last"), F.sum("events")
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_few_tables_hold_the_last_states():
    for n in range(1, 600):
        tables = journal.last_tables(n)
        assert [i for first, end in tables for i in range(first, end + 1)] == list(range(1, n + 1))
        assert len(tables) <= 7 * 4
    assert journal.last_tables(500) == [(1, 64), (65, 128), (129, 192), (193, 256), (257, 320), (321, 384), (385, 448), (449, 456), (457, 464), (465, 472), (473, 480), (481, 488), (489, 496), (497, 497), (498, 498), (499, 499), (500, 500)]


def test_last_states_are_those_of_the_newest_load(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(journal, "FOLD", 2)
    path = str(tmp_path / "journal")
    cmds = inputs.commands(spark, SMALL)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = cmds.agg(F.min(micros), F.max(micros)).head()
    for nth in range(5):  # the last but one is empty
        span = cmds.filter(F.floor((micros - first) * 4 / (last - first + 1)) == (nth if nth < 3 else 7 - nth))
        known = journal.last_of_devices(spark, path) if nth else None
        journal.append_journal(lifecycle.derive_events(span, initial=known), path, 2)
    assert {p.name for p in (tmp_path / "journal" / "last").iterdir()} == {"1-1", "2-2", "1-2", "3-3", "4-4", "3-4", "1-4", "5-5"}
    assert journal.last_tables(5) == [(1, 4), (5, 5)]
    rows = journal.read_journal(spark, path)
    want = rows.groupBy(*lifecycle.RECT).agg(F.max("sequence_number").alias("last_number"))
    want = want.join(lifecycle.replay(rows, ["ordering"]), lifecycle.RECT)
    got = journal.last_of_devices(spark, path)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert journal.read_manifest(spark, path).filter("load = 4").count() == 0
