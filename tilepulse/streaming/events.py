"""The journal as a stream: events by their place of append, so many at a time.

An offset is an ``ordering``. Places in a load have no gaps, so the end of the next
group of events follows from the loads' sizes: the driver reads no events for it, and a
load of any number of files is taken in groups of the same bound.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..sources.journal import PLACE_BITS

FORMAT = "device_journal"
MAX_EVENTS = 1_000_000
COLUMNS = [
    ("ordering", "long"),
    ("persistence_id", "string"),
    ("sequence_number", "long"),
    ("deleted", "boolean"),
    ("write_timestamp", "long"),
    ("event_type", "string"),
    ("zoom", "int"),
    ("top_left_lat", "double"),
    ("top_left_lng", "double"),
    ("bot_right_lat", "double"),
    ("bot_right_lng", "double"),
    ("tag", "string"),
]
READ_ROWS = 8_192


@dataclass
class Part(InputPartition):
    """A file's events in a range of places."""

    file: str
    tag: str
    first: int
    last: int


class JournalReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        # Spark hands a folder's path on as it was given.
        path = re.sub("^file:/+", "/", options["path"])
        self.files, self.path = fs.FileSystem.from_uri(path) if "://" in path else (None, path)
        self.files = self.files or fs.LocalFileSystem()
        self.uri = path
        self.most = int(options.get("maxevents", MAX_EVENTS))
        self.tag = options.get("tag")
        self.start = int(options.get("offset", 0))
        self.at: int | None = None
        self.known: dict[str, dict] = {}

    def initialOffset(self) -> dict:
        if self.at is None:
            self.at = self.start
        return {"ordering": self.start}

    def latestOffset(self) -> dict:
        """The end of the next group: ``most`` events on, over as many loads as that takes."""
        at, left = self.start if self.at is None else self.at, self.most
        for load in sorted(self._loads()):
            size = sum(row["events"] for row in self._manifest(load))
            base = load << PLACE_BITS
            done = min(max(at - base + 1, 0), size)
            take = min(size - done, left)
            if take:
                at, left = base + done + take - 1, left - take
            if not left:
                break
        return {"ordering": at}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        after, last = start["ordering"], end["ordering"]
        self.at = last  # also what a query that goes on tells first
        return [
            Part(row["place"], row["tag"], after + 1, last)
            for load in sorted(self._loads())
            if (after + 1) >> PLACE_BITS <= load <= last >> PLACE_BITS
            for row in self._manifest(load)
            if row["first"] <= last and row["last"] > after and self.tag in (None, row["tag"])
        ]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        place = pc.field("ordering")
        wanted = (place >= partition.first) & (place <= partition.last)
        names = [name for name, _ in COLUMNS[:-1]]
        found = ds.dataset(partition.file, filesystem=self.files, format="parquet")
        for batch in found.to_batches(columns=names, filter=wanted, batch_size=READ_ROWS):
            if batch.num_rows:
                tags = pa.array([partition.tag] * batch.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, tags], [*names, "tag"])

    def _lines(self, folder: str) -> list[dict]:
        chosen = fs.FileSelector(f"{self.path}/{folder}", allow_not_found=True)
        rows = []
        for info in self.files.get_file_info(chosen):
            if info.base_name.endswith(".json"):
                if info.path not in self.known:  # what is written once stays as it is
                    with self.files.open_input_stream(info.path) as lines:
                        text = lines.read().decode()
                    self.known[info.path] = [json.loads(line) for line in text.splitlines()]
                rows += self.known[info.path]
        return rows

    def _loads(self) -> set[int]:
        return {row["load"] for row in self._lines("loads")}

    def _manifest(self, load: int) -> list[dict]:
        if load not in self.known:
            self.known[load] = [
                row | {"place": f"{self.path}/events/load={load}/tag={row['tag']}/{row['file']}"}
                for row in self._lines(f"manifest/load={load}")
            ]
        return self.known[load]


class JournalSource(DataSource):
    """``device_journal``: options ``path``, ``maxEvents``, ``tag``, ``offset``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ", ".join(f"{name} {kind}" for name, kind in COLUMNS)

    def streamReader(self, schema) -> JournalReader:
        return JournalReader({k.lower(): v for k, v in self.options.items()})


def stream_events(
    spark: SparkSession,
    path: str,
    max_events: int = MAX_EVENTS,
    tag: str | None = None,
    offset: int = 0,
) -> DataFrame:
    """The journal's events past ``offset`` as a stream, those of one tag or all, at most
    ``max_events`` of the journal in a micro-batch. A checkpoint keeps the place."""
    spark.dataSource.register(JournalSource)
    reader = spark.readStream.format(FORMAT).option("path", path)
    reader = reader.option("maxEvents", str(max_events)).option("offset", str(offset))
    return (reader if tag is None else reader.option("tag", tag)).load()


def drained(query: StreamingQuery) -> None:
    """Let a query take what there is and stop it. (``availableNow`` would end after one
    group: Spark takes such a source's latest offset for all there is.)"""
    try:
        query.processAllAvailable()
    finally:
        query.stop()
