"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local threads. Every
query is run to its last row into a sink that drops them; the time is that of
building, planning and running, best of BENCH_RUNS after one warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilepulse.functions.grid import RECT
from tilepulse.operators import lifecycle, summary, tiles
from tilepulse.plans import inputs
from tilepulse.plans.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINE = [
    "device_events",
    "device_state",
    "event_journal",
    "summary_all_zooms",
    "tile_bulk_load",
    "assign_all_zooms",
    "viewport_tiles",
    "viewport_join",
    "query_response",
    "world_totals",
    "overlap_join",
    "points_in_regions",
    "cell_counts",
    "expand_to_devices",
    "fill_region",
    "activity_monitor",
    "stream_device_events",
    "stream_tile_summary",
]


def filled_tile(zoom: int):
    """One tile filled with devices, summarised at all zooms."""

    def run(spark: SparkSession, _: str) -> DataFrame:
        point = spark.createDataFrame([(48.85, 2.35)], "lat double, lng double")
        return summary.fill_region(tiles.assign_tile(point, zoom=zoom))

    return run


def activated_tile(zoom: int):
    """The same by making every device and counting its event."""

    def run(spark: SparkSession, _: str) -> DataFrame:
        point = spark.createDataFrame([(48.85, 2.35)], "lat double, lng double")
        devices = tiles.expand_to_devices(tiles.assign_tile(point, zoom=zoom).drop("lat", "lng"))
        events = devices.selectExpr("zoom", "row", "col", "'DeviceActivated' as event_type")
        counted = summary.with_deltas(events).groupBy("row", "col").agg(*summary.sums())
        return summary.roll_up(counted)

    return run


def expanded_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All zooms without aggregating at zoom 18 first: the plan to beat."""
    placed = tiles.assign_by_centre(summary.with_deltas(inputs.fleet_events(spark, sf_dir)))
    expanded = tiles.climb(placed.select("row", "col", *summary.COUNTS), 3, 18)
    return expanded.groupBy(*summary.TILE).agg(*summary.sums())


def hot_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All commands as those of one device, cut into more than a thousand chunks."""
    cmds = inputs.commands(spark, sf_dir).drop(*RECT)
    rect = [F.lit(v).alias(c) for c, v in zip(RECT, (18, 2.0, 1.0, 1.0, 2.0))]
    return lifecycle.derive_events(cmds.select("*", *rect), chunk_rows=64)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    jobs = {name: QUERIES[name] for name in HEADLINE}
    jobs["summary_expanded_first"] = expanded_first
    jobs["hot_device"] = hot_device
    jobs["fill_zoom_12"] = filled_tile(12)
    jobs["fill_zoom_8"] = filled_tile(8)
    jobs["activate_zoom_8"] = activated_tile(8)

    def run(job) -> float:
        start = time.perf_counter()
        job(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name, job in jobs.items():
        run(job)
        times[name] = round(min(run(job) for _ in range(RUNS)), 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    total = round(sum(times[name] for name in HEADLINE), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": float(Path(SF_DIR).name.removeprefix("sf")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
