"""Substring deduplication by content-defined chunks.

A gear hash rolls over a text's bytes; a chunk ends where the hash is greatest among
the ``LEAST`` - 1 places on either side. Since the hash forgets what lies ``WINDOW``
bytes back, chunk ends depend on nearby content only and not on the end before (but
for those that ``MOST`` forces): equal passages are cut alike from ``WINDOW`` +
``LEAST`` bytes after their start on, whatever stands before them. Chunks of
equal digest are repeats; the first one (smallest doc_id, then place) counts as the
original. A run of adjacent repeats is removed once it is long enough to be a
passage rather than a turn of phrase.

Chunk rows go to two shuffles, one summing per digest (on the map side first, so a
line found in a third of all documents costs a row per task) and one joining the
repeated digests back, which adaptive execution splits where hot. Texts travel
once, to the spans that are to be cut from them.

Defined results for odd inputs:

- null text: an empty one, no chunks. Texts of fewer bytes than ``LEAST_RUN`` lose
  nothing.
- equal texts: that of the smallest doc_id is the original. Rows equal in id *and*
  text cannot be told apart and are treated alike (as original, if they are).
- null ids sort before others.
- a text that repeats itself: its first occurrence is the original.
- empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import OUT_ROWS

# Bytes of a chunk: fewest, most.
LEAST, MOST = 24, 256
# Bytes that the gear hash looks back on: one bit of the hash each.
WINDOW = 32
# Least bytes of adjacent repeated chunks that are a passage.
LEAST_RUN = 64
GEAR_SEED = 3
GEAR = np.random.default_rng(GEAR_SEED).integers(0, 1 << 32, 256, np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte: the sum of GEAR[byte j back] << j over the
    last ``WINDOW`` bytes, by doubling the window."""
    rolled = GEAR[data]
    span = 1
    while span < WINDOW:
        longer = rolled.copy()
        longer[span:] += rolled[:-span] << np.uint32(span)
        rolled, span = longer, 2 * span
    return rolled


def greatest(rolled: np.ndarray, reach: int) -> np.ndarray:
    """The places whose hash is no less than the ``reach`` before and after them.
    Those nearer than that are equal, as where a word repeats."""
    n = len(rolled)
    # Of the hashes from each place on the greatest among ``reach``, by doubling.
    padded = np.concatenate([np.zeros(reach, np.uint32), rolled, np.zeros(reach, np.uint32)])
    ahead, span = padded, 1
    while span < reach:
        step = min(span, reach - span)
        ahead = np.maximum(ahead[:-step], ahead[step:])
        span += step
    before, after = ahead[:n], ahead[reach + 1 : reach + 1 + n]
    return np.flatnonzero((rolled >= before) & (rolled >= after))


def chunk_ends(raw: bytes) -> list[int]:
    """Where the chunks of a text end; the last end is its length."""
    n = len(raw)
    if not n:
        return []
    rolled = gear_hash(np.frombuffer(raw, np.uint8))
    ends, last = [], 0
    for place in (greatest(rolled, LEAST - 1) + 1).tolist():
        while place - last > MOST:
            last += MOST
            ends.append(last)
        if place - last >= LEAST:
            last = place
            ends.append(last)
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per chunk: ``id``, ``content`` (a hash of the text, which with the id
    names the row), ``start`` and ``length`` in bytes, ``digest``."""
    rows = docs.select(
        F.col(doc_id).alias("id"),
        F.xxhash64(F.col(text)).alias("content"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                owner, starts, lengths, digests = [], [], [], []
                for i, raw in enumerate(batch.column(2).to_pylist()):
                    last = 0
                    for end in chunk_ends(raw):
                        starts.append(last)
                        lengths.append(end - last)
                        digests.append(xxhash.xxh3_128_digest(raw[last:end]))
                        last = end
                    owner += [i] * (len(starts) - len(owner))
                at = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at),
                        batch.column(1).take(at),
                        pa.array(starts, pa.int32()),
                        pa.array(lengths, pa.int32()),
                        pa.array(digests, pa.binary()),
                    ],
                    ["id", "content", "start", "length", "digest"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"id {kind}, content long, start int, length int, digest binary"
    )


def repeats(found: DataFrame) -> DataFrame:
    """Per document with repeated chunks: their sorted (start, length, original)."""
    place = F.struct("id", "content", "start")
    by_digest = found.groupBy("digest").agg(
        F.count("*").alias("n"), F.min(place).alias("first")
    )
    again = by_digest.filter("n > 1").select("digest", "first")
    original = place.eqNullSafe(F.col("first")).alias("original")
    flagged = found.join(again, "digest").select("id", "content", "start", "length", original)
    spans = F.sort_array(F.collect_set(F.struct("start", "length", "original")))
    return flagged.groupBy("id", "content").agg(spans.alias("spans"))


def runs(spans: list[dict], removable: bool) -> list[tuple[int, int]]:
    """Long enough runs of adjacent repeated chunks, as (start, end); of the
    removable ones only, or of all."""
    out: list[list[int]] = []
    for span in spans:
        if removable and span["original"]:
            continue
        start, end = span["start"], span["start"] + span["length"]
        if out and out[-1][1] == start:
            out[-1][1] = end
        else:
            out.append([start, end])
    return [(a, b) for a, b in out if b - a >= LEAST_RUN]


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of bytes drawn in to the characters that they hold whole."""
    out = []
    for start, end in spans:
        while start < end and raw[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        if start < end:
            out.append((start, end))
    return out


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside the spans."""
    parts, last = [], 0
    for start, end in spans:
        parts.append(raw[last:start])
        last = end
    return b"".join([*parts, raw[last:]])


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_repeated (bytes in repeated passages, originals
    included), n_removed, spans (removed, in bytes), kept (the text left)."""
    rows = docs.select(
        F.col(doc_id).alias("id"),
        F.xxhash64(F.col(text)).alias("content"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"),
    )
    flagged = repeats(chunks(docs, doc_id, text)).withColumnsRenamed(
        {"id": "_id", "content": "_content"}
    )
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_content"))
    joined = rows.join(flagged.hint("shuffle_hash"), same, "left").select("id", "raw", "spans")
    kind = rows.schema["id"].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(first, OUT_ROWS)
                size, repeated, removed, cut, kept = [], [], [], [], []
                for raw, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    gone = whole_characters(raw, runs(spans or [], True))
                    size.append(len(raw))
                    repeated.append(sum(b - a for a, b in runs(spans or [], False)))
                    removed.append(sum(b - a for a, b in gone))
                    cut.append([{"start": a, "end": b} for a, b in gone])
                    kept.append(without(raw, gone).decode())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        *[pa.array(c, pa.int64()) for c in (size, repeated, removed)],
                        pa.array(cut, pa.list_(span)),
                        pa.array(kept, pa.string()),
                    ],
                    ["doc_id", "n_bytes", "n_repeated", "n_removed", "spans", "kept"],
                )

    return joined.mapInArrow(
        run,
        f"doc_id {kind}, n_bytes long, n_repeated long, n_removed long, "
        "spans array<struct<start: bigint, end: bigint>>, kept string",
    )

