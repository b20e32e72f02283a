"""The registered queries: one per operator, each over whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grid, measures
from ..functions.grid import COUNTS, MAX_ZOOM, RECT, TILE
from ..functions.keys import device_key, parse_device, parse_key
from ..operators import activity, joins, lifecycle, quadtree, summary, tiles, viewport
from ..operators.viewport import Area
from ..sources import journal, store, telemetry
from ..streaming import devices, events, journaled, projection
from ..sources.workspace import workspace, written
from . import inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters that the SQL equivalents share.
VIEW = Area(8, 61.3, -121.7, -47.9, 133.1)
PAGE_VIEW = Area(7, 61.3, -121.7, -47.9, 133.1)
LOOKUP_ZOOM = 6
LOOKUP_IDS = (1, 2, 3, 4)
CELL_ZOOM = 5
TAG_COUNT = 8
TAG = "3"
# Where commands are split into two loads.
SPLIT_TIME = "2024-01-15 00:00:00"
TAG_OFFSET = (1 << journal.PLACE_BITS) + 100
SHARDS = 2
STEP_SECONDS = 3600
# Loads of a journal, and events in a group of the journal's stream.
MANY_LOADS = 9
GROUP_EVENTS = 20_000
# Files of commands in one micro-batch: the bound on what one device's group holds.
STREAM_FILES = 64
# Bounds of a spatial join that has its cells shuffled and hot ones spread.
SHUFFLED = {"broadcast_rows": 0, "hot_rows": 1_000}
HALF_HEIGHT, HALF_WIDTH = 1.3, 2.1
GRID_HEIGHT, GRID_WIDTH = 1.25, 2.5
TRAVERSED_HEIGHT, TRAVERSED_WIDTH = 0.0013, 0.0021
# Areas that take tiles of zoom 3 whole, and the zoom at which their trees end.
TREE_HEIGHT, TREE_WIDTH = 21.3, 41.7
TREE_ZOOM = 9


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def shown(tiles_: DataFrame) -> DataFrame:
    """Tiles as the tile table shows them: zoom, edges, counts."""
    return grid.with_edges(tiles_).select(*RECT, *COUNTS)


def lookup_keys() -> list[tuple[int, int, int]]:
    up = MAX_ZOOM - LOOKUP_ZOOM
    return [
        (LOOKUP_ZOOM, (i * 104729 + 7) % 294912 >> up, (i * 1299709 + 11) % 589824 >> up)
        for i in LOOKUP_IDS
    ]


def supplier_areas(spark: SparkSession, sf_dir: str, zoom: int = 8) -> DataFrame:
    return inputs.areas(spark, sf_dir, zoom, HALF_HEIGHT, HALF_WIDTH)


def split_fleet(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The fleet's change events: the customers' first ones, and the rest."""
    events = inputs.fleet_events(spark, sf_dir)
    return events.filter("event_id < 0"), events.filter("event_id >= 0")


# Scans, sources and sinks


@query
def telemetry_scan(spark, sf_dir):
    cmds = inputs.commands(spark, sf_dir)
    text = cmds.select("event_id", telemetry.telemetry_json(["action", *RECT]).alias("value"))
    return telemetry.parse_telemetry(text)


@query
def telemetry_rejects(spark, sf_dir):
    _, rejected = telemetry.validate_telemetry(inputs.bad_commands(spark, sf_dir))
    return rejected.select("event_id", "reject_reason")


@query
def telemetry_acks(spark, sf_dir):
    acks = telemetry.acknowledge(inputs.bad_commands(spark, sf_dir))
    return acks.select(
        "event_id",
        "message",
        "http_status_code",
        F.col("telemetry_request.action").alias("action"),
        F.col("telemetry_request.zoom").alias("zoom"),
        F.col("telemetry_request.topLeftLat").alias("top_left_lat"),
    )


@query
def selection_scan(spark, sf_dir):
    chosen = inputs.selections(spark, sf_dir)
    fields = ["action", "rate", *RECT]
    text = chosen.select("s_suppkey", telemetry.telemetry_json(fields).alias("value"))
    return telemetry.parse_selections(text)


@query
def selection_acks(spark, sf_dir):
    chosen = inputs.selections(spark, sf_dir).select("s_suppkey", "action", "rate", *RECT)
    acks = telemetry.acknowledge_selections(chosen)
    return acks.select(
        "s_suppkey",
        "message",
        "http_status_code",
        F.col("selection_request.action").alias("action"),
        F.col("selection_request.rate").alias("rate"),
        F.col("selection_request.botRightLng").alias("bot_right_lng"),
    )


@query
def event_journal(spark, sf_dir):
    path = workspace(spark, "journal")
    journal.append_journal(inputs.device_events(spark, sf_dir), path, TAG_COUNT)
    return journal.read_journal(spark, path).select(
        "ordering", "persistence_id", "sequence_number", "write_timestamp", "event_type", "tag"
    )


def split_commands(cmds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The commands up to some time, and those after it."""
    early = F.col("ts") < F.lit(SPLIT_TIME).cast("timestamp_ntz")
    return cmds.filter(early), cmds.filter(~early)


def journal_of_two_loads(spark: SparkSession, sf_dir: str) -> str:
    """A journal whose second load goes on from the states that the first one left.
    The first load is appended twice, which changes nothing."""
    path = workspace(spark, "journal")
    first, later = split_commands(inputs.commands(spark, sf_dir))
    for _ in range(2):
        journal.append_journal(lifecycle.derive_events(first), path, TAG_COUNT, load_id="first")
    known = journal.last_of_devices(spark, path)
    events = lifecycle.derive_events(later, initial=known)
    journal.append_journal(events, path, TAG_COUNT, load_id="later")
    return path


@query
def event_journal_two_loads(spark, sf_dir):
    return journal.read_journal(spark, journal_of_two_loads(spark, sf_dir)).select(
        "ordering", "persistence_id", "sequence_number", "write_timestamp", "event_type", "tag"
    )


@query
def events_by_tag(spark, sf_dir):
    rows = journal.read_journal(spark, inputs.stored_journal(spark, sf_dir, TAG_COUNT))
    tagged = journal.events_by_tag(rows, None, TAG, TAG_OFFSET)
    return tagged.select("ordering", "persistence_id", "event_type")


@query
def journal_tag_join(spark, sf_dir):
    rows = journal.read_journal(spark, inputs.stored_journal(spark, sf_dir, TAG_COUNT))
    joined = journal.join_tags(rows, written(journal.event_tags(rows), "event-tags"))
    return joined.select("ordering", "sequence_number", "event_type", "tag")


@query
def tile_summary_scan(spark, sf_dir):
    path = workspace(spark, "tiles")
    store.bulk_load(inputs.fleet_tiles(spark, sf_dir), path)
    return shown(store.read_base(spark, path))


@query
def tile_upsert_additive(spark, sf_dir):
    first, later = split_fleet(spark, sf_dir)
    return shown(
        store.upsert_tiles(summary.summarize_all(first), summary.summarize_all(later))
    )


@query
def tile_upsert_replace(spark, sf_dir):
    first, _ = split_fleet(spark, sf_dir)
    given = summary.summarize_all(inputs.device_events(spark, sf_dir))
    return shown(store.upsert_tiles(summary.summarize_all(first), given, "replace"))


@query
def tile_replace_stored(spark, sf_dir):
    """The replacing upsert on the stored table, with a compaction before it."""
    path = workspace(spark, "tiles")
    first, _ = split_fleet(spark, sf_dir)
    store.append_deltas(summary.summarize_all(first), path, 0)
    store.compact_tiles(spark, path)
    given = summary.summarize_all(inputs.device_events(spark, sf_dir))
    store.replace_tiles(written(given, "given"), path, 1)
    return shown(store.read_tiles(spark, path))


@query
def tile_bulk_load(spark, sf_dir):
    path = workspace(spark, "tiles")
    events = written(inputs.fleet_events(spark, sf_dir), "fleet-events")
    first, later = events.filter("event_id < 0"), events.filter("event_id >= 0")
    store.append_deltas(summary.summarize_all(first), path, 0)
    store.compact_tiles(spark, path)
    store.append_deltas(summary.summarize_all(later), path, 1)
    return shown(store.read_tiles(spark, path))


# Geo-tile projections and expansions


@query
def assign_tile(spark, sf_dir):
    placed = tiles.assign_tile(inputs.points(spark, sf_dir), zoom=12)
    return placed.select("point_id", *TILE)


@query
def assign_all_zooms(spark, sf_dir):
    customers = inputs.table(spark, sf_dir, "customer").select("c_custkey")
    centres = inputs.place(customers, "c_custkey").select(
        "c_custkey", grid.centre_lat().alias("lat"), grid.centre_lng().alias("lng")
    )
    return tiles.assign_all_zooms(centres).select("c_custkey", *TILE)


@query
def assign_by_centre(spark, sf_dir):
    placed = tiles.assign_by_centre(supplier_areas(spark, sf_dir), 9)
    return placed.select("area_id", F.col("tile_zoom").alias("zoom"), "row", "col")


@query
def device_key_counts(spark, sf_dir):
    return summary.device_key_counts(inputs.commands(spark, sf_dir))


@query
def device_key_decode(spark, sf_dir):
    seen = inputs.commands(spark, sf_dir).select(*RECT).distinct()
    keyed = seen.select(device_key().alias("device_key"))
    key = F.col("device_key")
    decoded = keyed.select("device_key", *parse_key(key), *parse_device(key))
    finest = inputs.stored_tiles(spark, sf_dir).filter(F.col("zoom") == MAX_ZOOM).drop("zoom")
    return decoded.join(finest, ["row", "col"]).drop("row", "col")


@query
def expand_children(spark, sf_dir):
    mixed = inputs.selections(spark, sf_dir, F.lit(3) + F.col("s_suppkey") % 16)
    world = [(-1, 0, 0, 0), (-2, 1, 0, 0), (-3, 1, 0, 1)]
    world += [(-4 - 6 * row - col, 2, row, col) for row in range(3) for col in range(6)]
    coarse = spark.createDataFrame(world, mixed.select("s_suppkey", *TILE).schema)
    return tiles.expand_children(mixed.select("s_suppkey", *TILE).unionByName(coarse))


@query
def expand_to_devices(spark, sf_dir):
    chosen = inputs.selections(spark, sf_dir, 14).select("s_suppkey", *TILE)
    return tiles.expand_to_devices(chosen)


@query
def selection_commands(spark, sf_dir):
    """From area actions to counts: expanded, run per device, summed per tile."""
    cmds = tiles.selection_commands(inputs.selections(spark, sf_dir, 14), "s_suppkey")
    timed = cmds.withColumn("ts", F.timestamp_seconds("event_id"))
    return shown(summary.summarize_all(lifecycle.derive_events(timed)))


@query
def cover_area(spark, sf_dir):
    off_grid = supplier_areas(spark, sf_dir).withColumn("aligned", F.lit(False))
    on_grid = inputs.areas(spark, sf_dir, 8, GRID_HEIGHT, GRID_WIDTH)
    snapped = tiles.assign_by_centre(on_grid, 8).select(
        "area_id",
        F.lit(8).alias("zoom"),
        *grid.edges(8, F.col("row"), F.col("col")),
        F.lit(True).alias("aligned"),
    )
    covered = tiles.cover_area(off_grid.unionByName(snapped))
    return covered.select("area_id", "aligned", F.col("tile_zoom").alias("zoom"), "row", "col")


@query
def neighbour_tiles(spark, sf_dir):
    table = inputs.stored_tiles(spark, sf_dir)
    both = [
        tiles.neighbours(table, side).withColumn("direction", F.lit(side))
        for side in ("right", "below")
    ]
    return both[0].unionByName(both[1]).filter("next_device_count is not null")


@query
def zoom_levels(spark, sf_dir):
    used = summary.per_zoom(inputs.stored_tiles(spark, sf_dir))
    return tiles.zoom_levels(spark).join(used, "zoom", "left")


@query
def selection_traversal(spark, sf_dir):
    chosen = inputs.areas(spark, sf_dir, 8, TRAVERSED_HEIGHT, TRAVERSED_WIDTH)
    steps = tiles.traverse_selection(chosen, range(0, MAX_ZOOM + 1))
    return steps.select(
        "area_id",
        F.col("tile_zoom").alias("zoom"),
        "row",
        "col",
        "overlap",
        "trim_top_lat",
        "trim_left_lng",
        "trim_bot_lat",
        "trim_right_lng",
    )


@query
def selection_tree(spark, sf_dir):
    chosen = inputs.areas(spark, sf_dir, 8, TREE_HEIGHT, TREE_WIDTH)
    return quadtree.cover_tree(chosen, TREE_ZOOM).select(
        "selection.area_id",
        F.col("tile_zoom").alias("zoom"),
        "row",
        "col",
        "overlap",
        "first_key",
        "last_key",
    )


@query
def selection_totals(spark, sf_dir):
    chosen = inputs.areas(spark, sf_dir, 8, TREE_HEIGHT, TREE_WIDTH)
    return quadtree.selection_totals(inputs.stored_tiles(spark, sf_dir), chosen, "area_id")


# Filters


@query
def viewport_tiles(spark, sf_dir):
    return shown(viewport.viewport(inputs.stored_tiles(spark, sf_dir), VIEW))


@query
def viewport_join(spark, sf_dir):
    found = viewport.viewports(
        inputs.stored_tiles(spark, sf_dir), supplier_areas(spark, sf_dir, 10)
    )
    return found.select(
        "area.area_id", "tile.zoom", "tile.row", "tile.col", *[f"tile.{c}" for c in COUNTS]
    )


@query
def non_empty_tiles(spark, sf_dir):
    return shown(viewport.non_empty(inputs.stored_tiles(spark, sf_dir)))


@query
def tiles_or_lookup(spark, sf_dir):
    return shown(viewport.lookup_tiles_or(inputs.stored_tiles(spark, sf_dir), lookup_keys()))


@query
def only_devices(spark, sf_dir):
    mixed = inputs.selections(spark, sf_dir, F.lit(15) + F.col("s_suppkey") % 4)
    return tiles.only_devices(mixed).select("s_suppkey", *RECT)


# Joins


@query
def cover_semi_join(spark, sf_dir):
    cover = tiles.cover_area(supplier_areas(spark, sf_dir, 6))
    return shown(joins.lookup_cover(inputs.stored_tiles(spark, sf_dir), cover))


@query
def overlap_join(spark, sf_dir):
    placed = grid.with_edges(inputs.stored_tiles(spark, sf_dir)).select(*TILE, *RECT[1:])
    pairs = joins.overlap_join(supplier_areas(spark, sf_dir), placed, ("area", "tile"))
    return pairs.select("area.area_id", *[f"tile.{c}" for c in TILE])


@query
def contains_join(spark, sf_dir):
    placed = grid.with_edges(inputs.stored_tiles(spark, sf_dir)).select(*TILE, *RECT[1:])
    pairs = joins.contains_join(supplier_areas(spark, sf_dir), placed, ("area", "tile"))
    return pairs.select("area.area_id", *[f"tile.{c}" for c in TILE])


@query
def points_in_regions(spark, sf_dir):
    pairs = joins.points_in_regions(
        inputs.points(spark, sf_dir), supplier_areas(spark, sf_dir), ("point", "area")
    )
    return pairs.select("point.point_id", "area.area_id")


@query
def overlap_join_large(spark, sf_dir):
    """As beyond the bound of a broadcast: shuffled, with hot cells on several tasks."""
    placed = grid.with_edges(inputs.stored_tiles(spark, sf_dir)).select(*TILE, *RECT[1:])
    areas = supplier_areas(spark, sf_dir)
    pairs = joins.overlap_join(areas, placed, ("area", "tile"), **SHUFFLED)
    return pairs.select("area.area_id", *[f"tile.{c}" for c in TILE])


@query
def points_in_regions_large(spark, sf_dir):
    """The same for points."""
    points, areas = inputs.points(spark, sf_dir), supplier_areas(spark, sf_dir)
    pairs = joins.points_in_regions(points, areas, ("point", "area"), **SHUFFLED)
    return pairs.select("point.point_id", "area.area_id")


# Aggregations


@query
def event_deltas(spark, sf_dir):
    counted = summary.with_deltas(inputs.device_events(spark, sf_dir))
    return counted.groupBy("event_type").agg(
        F.count("*").alias("event_total"), *summary.sums()
    )


@query
def summary_zoom(spark, sf_dir):
    return shown(summary.summarize(inputs.fleet_events(spark, sf_dir), 12))


@query
def summary_all_zooms(spark, sf_dir):
    return shown(inputs.fleet_tiles(spark, sf_dir))


@query
def summary_rollup(spark, sf_dir):
    finest = summary.summarize(inputs.device_events(spark, sf_dir), MAX_ZOOM)
    return shown(summary.roll_up(finest))


@query
def summary_sharded(spark, sf_dir):
    events = inputs.fleet_events(spark, sf_dir)
    shards = [
        summary.summarize(events, 12, SHARDS, i).withColumn("shard", F.lit(i))
        for i in range(SHARDS)
    ]
    return reduce(DataFrame.unionByName, shards)


@query
def tag_histogram(spark, sf_dir):
    fleet = inputs.fleet_commands(spark, sf_dir).select(*RECT).distinct()
    return summary.tag_histogram(fleet, TAG_COUNT)


@query
def world_totals(spark, sf_dir):
    return viewport.world_totals(inputs.stored_tiles(spark, sf_dir))


@query
def view_totals(spark, sf_dir):
    return viewport.view_totals(inputs.stored_tiles(spark, sf_dir), VIEW)


@query
def cell_counts(spark, sf_dir):
    cells = inputs.selections(spark, sf_dir, CELL_ZOOM).select("s_suppkey", *RECT)
    in_view = viewport.viewport(inputs.stored_tiles(spark, sf_dir), PAGE_VIEW)
    return viewport.counts_in_cell(in_view, cells, "s_suppkey")


@query
def per_zoom_counts(spark, sf_dir):
    return summary.per_zoom(inputs.stored_tiles(spark, sf_dir))


@query
def fill_region(spark, sf_dir):
    mixed = inputs.selections(spark, sf_dir, F.lit(13) + F.col("s_suppkey") % 4)
    return shown(summary.fill_region(mixed))


@query
def query_response(spark, sf_dir):
    pages = viewport.query_response(inputs.stored_tiles(spark, sf_dir), PAGE_VIEW)
    return pages.select(
        "page_row", "page_col", *COUNTS, F.inline_outer("region_summaries")
    ).toDF("page_row", "page_col", *COUNTS, *RECT, *["tile_" + c for c in COUNTS])


# Stateful operators


@query
def device_events(spark, sf_dir):
    return _with_user_key(inputs.device_events(spark, sf_dir))


def _with_user_key(events: DataFrame) -> DataFrame:
    return events.select("event_id", device_key().alias("device_key"), "event_type")


@query
def device_events_resumed(spark, sf_dir):
    """Two loads of commands, the second one from the states the first one ends in."""
    first, later = split_commands(inputs.commands(spark, sf_dir))
    early = written(lifecycle.derive_events(first), "device-events")
    late = lifecycle.derive_events(later, initial=lifecycle.replay(early))
    return _with_user_key(early.unionByName(late))


@query
def command_outcomes(spark, sf_dir):
    return lifecycle.command_outcomes(inputs.commands(spark, sf_dir))


@query
def device_state(spark, sf_dir):
    return lifecycle.device_state(inputs.commands(spark, sf_dir))


@query
def replay_state(spark, sf_dir):
    rows = journal.read_journal(spark, inputs.stored_journal(spark, sf_dir, TAG_COUNT))
    return lifecycle.replay(rows, ["sequence_number"])


@query
def activity_monitor(spark, sf_dir):
    return activity.activity(inputs.device_events(spark, sf_dir), STEP_SECONDS)


@query
def activity_scale(spark, sf_dir):
    samples = activity.activity(inputs.device_events(spark, sf_dir), STEP_SECONDS)
    return activity.activity_scale(samples)


# Derived measures


@query
def mood_classes(spark, sf_dir):
    classed = measures.with_mood(viewport.non_empty(inputs.stored_tiles(spark, sf_dir)))
    return classed.groupBy("zoom", "mood").agg(F.count("*").alias("tile_total"))


@query
def tile_density(spark, sf_dir):
    dense = measures.with_density(inputs.stored_tiles(spark, sf_dir))
    return dense.select(*TILE, "device_count", "fill_ratio", "partial")


@query
def selection_cost(spark, sf_dir):
    chosen = inputs.selections(spark, sf_dir, F.lit(6) + F.col("s_suppkey") % 7)
    return measures.selection_cost(chosen).select(
        "s_suppkey", "zoom", "rate", "device_total", "duration_sec", "allowed"
    )


# Set operations


@query
def tiles_union_lookup(spark, sf_dir):
    keys = lookup_keys()
    return shown(viewport.lookup_tiles_union(inputs.stored_tiles(spark, sf_dir), [*keys, keys[0]]))


# Projections by offset


@query
def incremental_projection(spark, sf_dir):
    rows, progress = _journal_with_progress(spark, sf_dir)
    due, advanced = journal.run_incremental(rows, progress, "tiles")
    return journal.tag_deltas(due).join(
        advanced.select(F.col("projection_key").alias("tag"), "current_offset"), "tag", "right"
    )


@query
def incremental_two_loads(spark, sf_dir):
    """Two loads, the second one with smaller event ids, each projected as it comes; a
    tag is paused during the first and goes on after the second."""
    path, tiles_path = workspace(spark, "journal"), workspace(spark, "tiles")
    first, later = split_fleet(spark, sf_dir)
    journal.set_paused(spark, path, "tiles", TAG, True)
    for events in (later, first):
        journal.append_journal(events, path, TAG_COUNT)
        journal.project_increment(spark, path, tiles_path)
    journal.set_paused(spark, path, "tiles", TAG, False)
    journal.project_increment(spark, path, tiles_path)
    return shown(store.read_tiles(spark, tiles_path))


@query
def incremental_many_loads(spark, sf_dir):
    """A load for each span of time, each projected as it comes."""
    path, tiles_path = workspace(spark, "journal"), workspace(spark, "tiles")
    events_ = written(inputs.fleet_events(spark, sf_dir), "fleet-events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = events_.agg(F.min(micros), F.max(micros)).head()
    width = (last - first) // MANY_LOADS + 1
    for nth in range(MANY_LOADS):
        span = events_.filter(F.floor((micros - first) / width) == nth)
        journal.append_journal(span, path, TAG_COUNT)
        journal.project_increment(spark, path, tiles_path, compact_every=4)
    return shown(store.read_tiles(spark, tiles_path))


@query
def paused_projections(spark, sf_dir):
    rows, progress = _journal_with_progress(spark, sf_dir)
    management = progress.select(
        "projection_name",
        "projection_key",
        (F.col("projection_key").cast("int") % 2 == 1).alias("paused"),
    )
    due, _ = journal.run_incremental(rows, progress, "tiles", management)
    return journal.tag_deltas(due)


def _journal_with_progress(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The journal, and offsets as if each tag's first half had been handled."""
    rows = journal.read_journal(spark, inputs.stored_journal(spark, sf_dir, TAG_COUNT))
    halfway = F.expr("(min(ordering) + max(ordering)) div 2").alias("current_offset")
    progress = rows.groupBy("tag").agg(halfway)
    return rows, progress.select(
        F.lit("tiles").alias("projection_name"),
        F.col("tag").alias("projection_key"),
        "current_offset",
    )


# Streams


def _streamed_commands(spark, sf_dir) -> DataFrame:
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    # A glob reaches the table whether it is one file or a folder of files.
    reader = projection.group_within(spark.readStream.schema(schema), STREAM_FILES)
    events = reader.parquet(f"{sf_dir}/event[s].parquet")
    return inputs.as_commands(events.withColumn("ts", F.col("ts").cast("timestamp")))


def _run_to_files(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    target = workspace(spark, name)
    (
        stream.writeStream.format("parquet")
        .option("path", f"{target}/out")
        .option("checkpointLocation", f"{target}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema(stream.schema).parquet(f"{target}/out")


@query
def stream_device_events(spark, sf_dir):
    stream = devices.stream_device_events(_streamed_commands(spark, sf_dir))
    return _with_user_key(_run_to_files(stream, spark, "device-events"))


@query
def stream_device_state(spark, sf_dir):
    stream = devices.stream_device_events(_streamed_commands(spark, sf_dir))
    return lifecycle.replay(_run_to_files(stream, spark, "device-state"))


@query
def stream_into_journal(spark, sf_dir):
    """The first commands as one load of a journal, the later ones as a stream that goes
    on from the states in it."""
    path, checkpoint = workspace(spark, "journal"), workspace(spark, "into-journal")
    first, _ = split_commands(inputs.commands(spark, sf_dir))
    journal.append_journal(lifecycle.derive_events(first), path, TAG_COUNT)
    later = _streamed_commands(spark, sf_dir).filter(F.col("ts") >= F.lit(SPLIT_TIME).cast("timestamp"))
    journaled.stream_into_journal(later, path, checkpoint, TAG_COUNT).awaitTermination()
    return journal.read_journal(spark, path).select(
        "persistence_id", "sequence_number", "write_timestamp", "event_type", "tag"
    )


def _streamed_events(spark, sf_dir, files: int = 2) -> DataFrame:
    """The device events as a stream of several files, taken a few at a time."""
    path = workspace(spark, "events")
    events = inputs.device_events(spark, sf_dir)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition("event_id").write.parquet(path)
    return projection.group_within(spark.readStream.schema(events.schema), files).parquet(path)


@query
def stream_events_by_tag(spark, sf_dir):
    """One tag's events past an offset, from the journal as a stream."""
    path, target = inputs.stored_journal(spark, sf_dir, TAG_COUNT), workspace(spark, "by-tag")
    stream = events.stream_events(spark, path, GROUP_EVENTS, TAG, TAG_OFFSET)
    rows = stream.select("ordering", "persistence_id", "event_type")
    writer = rows.writeStream.option("checkpointLocation", f"{target}/checkpoint")
    events.drained(writer.format("parquet").start(f"{target}/out"))
    return spark.read.schema(rows.schema).parquet(f"{target}/out")


@query
def stream_grouped(spark, sf_dir):
    target = workspace(spark, "grouped")
    deltas = summary.with_deltas(_streamed_events(spark, sf_dir)).groupBy("event_type")
    counted = deltas.agg(F.count("*").alias("event_total"), *summary.sums())
    projection.keep_latest(counted, f"{target}/out", f"{target}/checkpoint").awaitTermination()
    return projection.latest(spark.read.parquet(f"{target}/out"), ["event_type"])


@query
def stream_tile_summary(spark, sf_dir):
    target = workspace(spark, "projection")
    projection.run_projection(
        _streamed_events(spark, sf_dir),
        f"{target}/tiles",
        f"{target}/checkpoint",
        offset="event_id",
    ).awaitTermination()
    return shown(store.read_tiles(spark, f"{target}/tiles"))


@query
def stream_two_projections(spark, sf_dir):
    """Two projections, each of half the tags, into one table."""
    target = workspace(spark, "projection")
    for key in ("even", "odd"):
        events = summary.assign_tag(_streamed_events(spark, sf_dir), TAG_COUNT)
        mine = F.col("tag").cast("int") % 2 == int(key == "odd")
        projection.run_projection(
            events.filter(mine).drop("tag"),
            f"{target}/tiles",
            f"{target}/checkpoint-{key}",
            offset="event_id",
            projection="halves",
            key=key,
            compact_every=1,
        ).awaitTermination()
    return shown(store.read_tiles(spark, f"{target}/tiles"))


@query
def stream_tile_counts(spark, sf_dir):
    target = workspace(spark, "tile-counts")
    counted = projection.stream_tile_counts(_streamed_events(spark, sf_dir, 1000))
    projection.keep_latest(counted, f"{target}/out", f"{target}/checkpoint").awaitTermination()
    return shown(projection.latest(spark.read.parquet(f"{target}/out"), TILE))


@query
def stream_activity(spark, sf_dir):
    target = workspace(spark, "activity")
    steps = projection.stream_activity(_streamed_events(spark, sf_dir), STEP_SECONDS)
    projection.keep_latest(steps, f"{target}/out", f"{target}/checkpoint").awaitTermination()
    newest = projection.latest(spark.read.parquet(f"{target}/out"), ["step"])
    return activity.recent_samples(newest, STEP_SECONDS)
