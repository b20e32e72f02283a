"""Exact substring deduplication by external induced sorting.

Every byte covered by a ``LENGTH``-byte string that also starts somewhere else is
removed. Suffixes that share their first ``LENGTH`` bytes are found in suffix order,
where they are neighbours with a common prefix that long. The order of a few *seed*
suffixes is made by an external sort, and that of all others induced from it, leftwards,
a byte at a time, carrying each suffix's rank and the prefix it shares with the one
before:

1. **Seeds.** Of the ``LENGTH - SEED + 1`` places in a string where ``SEED`` bytes fit,
   the one of least hash (leftmost, if several) is its seed. The seed depends on the
   string only, so equal strings have equal seeds at equal offsets. Consecutive starts
   with one seed are a *run* (some 85 starts); a run's *content* is all bytes that its
   strings cover.
2. **Runs, not starts, are shuffled**, as digests of seed and content. Seeds that occur
   once are done with: their starts are unique. Runs whose content occurs twice are
   done with too: all their starts repeat. What is left are seeds with different
   contents: the edges of repeats.
3. **Induction.** For these, one copy of each content is fetched, and the contents are
   sorted by seed and by the bytes from the seed on: Spark's sort, whose queues go to
   disk, so a shard may far exceed memory. A task then takes the sorted suffixes in
   blocks. The tuples (rank, shared prefix) of the suffixes that start ``t`` bytes left of
   their seeds are dealt, in order, into buckets of the byte before; that *is* the order
   of the suffixes one byte further left, each sharing one byte more than the least
   shared between it and its new neighbour. Where that reaches ``LENGTH``, both starts
   repeat.
4. A seed with more than ``BLOCK`` contents is dealt over several blocks. Repeats between
   its blocks are found by digests of the starts that no partner was found for, and of
   one start for each set of partners.

The method's recursion ends after one level, as a seed's order is needed for ``LENGTH``
bytes only, which the sort compares directly.

Defined results for odd inputs: a null text is an empty one; texts under ``LENGTH`` bytes
lose nothing; rows equal in id and text each count as an occurrence and get equal
results; repeats within one text count, overlapping or not; the order of rows does not
matter, so there are no ties; an empty table gives no rows. Only the two named columns
are read. What is kept may begin or end inside a character, as bytes are what counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import written
from .chunk_dedup import gear_hash, without
from .tables import OUT_ROWS

LENGTH = 200
# Bytes of a seed: what the 32-bit gear hash looks back on.
SEED = 32
PLACES = LENGTH - SEED + 1
# Starts of a text that are looked at together.
STARTS = 1 << 20
# Contents of one seed, and of all seeds, that are sorted together.
BLOCK, HELD = 2_048, 32_768
ORDER_MIX = np.uint64(0x9E3779B97F4A7C15)  # any odd number would do


def seeds(raw: bytes) -> Iterator[tuple[int, int, int]]:
    """Runs of a text: (first start, last start, place of their seed)."""
    data, n = np.frombuffer(raw, np.uint8), len(raw) - LENGTH + 1
    for first in range(0, n, STARTS):
        starts = min(STARTS, n - first)
        part = data[first : first + starts + LENGTH - 1]
        rolled = gear_hash(part)[SEED - 1 :].astype(np.uint64) * ORDER_MIX
        key = (rolled & ~np.uint64(0xFFFFFFFF)) | np.arange(len(rolled), dtype=np.uint64)
        span = 1
        while 2 * span <= PLACES:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        rest = PLACES - span
        least = np.minimum(key[:starts], key[rest : rest + starts])
        place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        edges = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True])
        begins, ends = edges[:-1], edges[1:] - 1
        yield from zip(
            (begins + first).tolist(), (ends + first).tolist(), (place[begins] + first).tolist()
        )


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, content, raw): the row's id and the hash of its text name it."""
    return docs.select(
        F.col(doc_id).alias("id"),
        F.xxhash64(F.col(text)).alias("content"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"),
    )


def runs(rows: DataFrame) -> DataFrame:
    """One row per run: ``seed`` and ``body`` (digests), ``id`` and ``content`` of its
    text, ``start``, ``starts`` (how many), ``back`` (bytes from start to seed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                owner, columns = [], [[] for _ in range(5)]
                for i, raw in enumerate(batch.column(2).to_pylist()):
                    for a, b, q in seeds(raw):
                        columns[0].append(xxhash.xxh3_64_intdigest(raw[q : q + SEED]))
                        columns[1].append(xxhash.xxh3_64_intdigest(raw[a : b + LENGTH], q - a))
                        columns[2].append(a)
                        columns[3].append(b - a + 1)
                        columns[4].append(q - a)
                    owner += [i] * (len(columns[0]) - len(owner))
                at = pa.array(owner, pa.int64())
                digests = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in columns[:2]]
                yield pa.RecordBatch.from_arrays(
                    [
                        *digests,
                        batch.column(0).take(at),
                        batch.column(1).take(at),
                        pa.array(columns[2], pa.int32()),
                        pa.array(columns[3], pa.int32()),
                        pa.array(columns[4], pa.int16()),
                    ],
                    ["seed", "body", "id", "content", "start", "starts", "back"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"seed long, body long, id {kind}, content long, start int, starts int, back smallint",
    )


def shared_prefix(a: bytes, b: bytes) -> int:
    """Bytes that two strings have in common at their beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int((x != y).argmax())


def induced(group: np.ndarray, left: list[bytes], right: list[bytes]) -> Iterator[tuple]:
    """For suffixes sorted by group and ``right`` (the bytes from the seed on): at each
    step t, the suffixes that start t bytes left of their seeds, in order, and the prefix
    that each shares with the one before (0 for the first of its group or byte)."""
    n = len(group)
    back = np.fromiter(map(len, left), np.int64, n)
    most = int(back.max(initial=0))
    before = np.zeros((most, n), np.uint8)  # before[t]: the byte t + 1 left of the seed
    for i, piece in enumerate(left):
        before[: len(piece), i] = np.frombuffer(piece, np.uint8)[::-1]
    order = np.arange(n)
    shared = np.zeros(n, np.int64)
    for i in range(1, n):
        if group[i] == group[i - 1]:
            shared[i] = shared_prefix(right[i - 1], right[i])
    yield order, shared
    for t in range(most):
        # Suffixes that have a byte more, dealt into buckets in their order.
        place = np.flatnonzero(back[order] > t)
        rows = order[place]
        key = group[rows] * 256 + before[t, rows]
        dealt = np.argsort(key, kind="stable")
        place, rows, key = place[dealt], rows[dealt], key[dealt]
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        longer = np.zeros(len(rows), np.int64)
        if len(same):
            bounds = np.column_stack([place[same - 1] + 1, place[same] + 1]).ravel()
            least = np.minimum.reduceat(np.append(shared, 0), bounds)[::2]
            longer[same] = least + 1
        order, shared = rows, longer
        yield order, shared


def repeated_starts(block: list[dict]) -> Iterator[tuple[int, int, bool, bool]]:
    """Of a sorted block: (item, start relative to the run, whether it repeats within
    the block, whether it stands for its set of equal starts elsewhere)."""
    number: dict = {}
    group = np.array([number.setdefault(r["group"], len(number)) for r in block], np.int64)
    steps = induced(group, [r["left"] for r in block], [r["right"] for r in block])
    hot = np.array([r["hot"] for r in block], bool)
    back = np.array([len(r["left"]) for r in block])
    whole = back + np.array([len(r["right"]) for r in block])
    for t, (order, shared) in enumerate(steps):
        joined = shared >= LENGTH
        repeats = joined | np.append(joined[1:], False)
        full = t + whole[order] - back[order] >= LENGTH  # the run has this start
        told = full & (repeats | hot[order])
        for k in np.flatnonzero(told).tolist():
            i = int(order[k])
            yield i, int(back[i]) - t, bool(repeats[k]), bool(hot[i] and not joined[k])


def ranges(starts: list[int]) -> list[tuple[int, int]]:
    """Sorted numbers as ranges (first, last)."""
    out: list[list[int]] = []
    for s in sorted(starts):
        if out and out[-1][1] == s - 1:
            out[-1][1] = s
        else:
            out.append([s, s])
    return [(a, b) for a, b in out]


def contents(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted runs with their bytes, ``left`` and ``right`` of the seed's place."""
    fields = ["seed", "salt", "hot", "n", "start", "starts", "back"]
    per_text = wanted.groupBy("id", "content").agg(
        F.collect_list(F.struct(*fields)).alias("wanted")
    )
    per_text = per_text.withColumnsRenamed({"id": "_id", "content": "_content"})
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_content"))
    joined = rows.join(per_text.hint("shuffle_hash"), same)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                owner, found = [], []
                for i, (raw, asked) in enumerate(
                    zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
                ):
                    for r in asked:
                        a, q = r["start"], r["start"] + r["back"]
                        end = a + r["starts"] - 1 + LENGTH
                        owner.append(i)
                        found.append(
                            (r["seed"], r["salt"], r["hot"], r["n"], a, raw[a:q], raw[q:end])
                        )
                at = pa.array(owner, pa.int64())
                kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32())
                kinds += (pa.binary(), pa.binary())
                columns = zip(*found) if found else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at),
                        batch.column(1).take(at),
                        *[pa.array(c, k) for c, k in zip(columns, kinds)],
                    ],
                    ["id", "content", "seed", "salt", "hot", "n", "start", "left", "right"],
                )

    return joined.select("id", "content", "raw", "wanted").mapInArrow(
        run,
        f"id {kind}, content long, seed long, salt int, hot boolean, n long, start int, "
        "left binary, right binary",
    )


def induce(sorted_contents: DataFrame) -> DataFrame:
    """From contents sorted by seed, salt and right: ranges of starts (id, content, first,
    last) that repeat (``key`` null), and single starts of seeds with several blocks with
    the digest ``key`` of their string, for the search between blocks."""
    kind = sorted_contents.schema["id"].dataType.simpleString()

    def solved(block: list[dict], id_type) -> pa.RecordBatch:
        found: dict[int, list[int]] = {}
        out: list[tuple] = []
        for i, start, repeats, asks in repeated_starts(block):
            row = block[i]
            if repeats and row["n"] == 1:
                found.setdefault(i, []).append(start)
            if asks:
                whole = row["left"] + row["right"]
                digest = xxhash.xxh3_128_digest(whole[start : start + LENGTH])
                at = row["start"] + start
                out.append((row["id"], row["content"], at, at, digest, row["n"] > 1 or repeats))
        for i, starts in found.items():
            row = block[i]
            for a, b in ranges(starts):
                out.append(
                    (row["id"], row["content"], row["start"] + a, row["start"] + b, None, True)
                )
        kinds = (id_type, pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_())
        columns = zip(*out) if out else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            ["id", "content", "first", "last", "key", "known"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[dict] = []
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for row in batch.to_pylist():
                row["group"] = (row["seed"], row["salt"])
                if len(block) >= HELD and row["group"] != block[-1]["group"]:
                    yield solved(block, id_type)
                    block = []
                block.append(row)
        if block:
            yield solved(block, id_type)

    return sorted_contents.mapInArrow(
        run, f"id {kind}, content long, first int, last int, key binary, known boolean"
    )


def repeats(rows: DataFrame) -> DataFrame:
    """Ranges of starts (id, content, first, last) whose strings occur elsewhere."""
    found = runs(rows)
    per_seed = found.groupBy(F.col("seed").alias("_seed")).agg(
        F.count("*").alias("n"), F.min("body").alias("lo"), F.max("body").alias("hi")
    )
    again = per_seed.filter("n > 1").select("_seed", (F.col("lo") != F.col("hi")).alias("several"))
    found = found.join(again, F.col("seed") == F.col("_seed")).drop("_seed")
    found = written(found, "runs")
    last = (F.col("start") + F.col("starts") - 1).alias("last")
    span = ["id", "content", F.col("start").alias("first"), last]
    plain = found.filter("not several").select(*span)

    mixed = found.filter("several")
    place = F.struct("id", "content", "start", "starts", "back")
    bodies = mixed.groupBy("seed", "body").agg(F.count("*").alias("n"), F.min(place).alias("p"))
    bodies = written(bodies, "bodies")
    twice = bodies.filter("n > 1").select(F.col("seed").alias("_seed"), F.col("body").alias("_body"))
    same = (F.col("seed") == F.col("_seed")) & (F.col("body") == F.col("_body"))
    equal = mixed.join(twice, same, "left_semi").select(*span)

    counts = bodies.groupBy(F.col("seed").alias("_seed")).agg(F.count("*").alias("m"))
    sized = bodies.join(counts, F.col("seed") == F.col("_seed"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    wanted = sized.select(
        "p.*",
        "seed",
        F.pmod("body", blocks).cast("int").alias("salt"),
        (blocks > 1).alias("hot"),
        "n",
    )
    ordered = contents(rows, wanted).repartition("seed", "salt")
    ordered = ordered.sortWithinPartitions("seed", "salt", "right")
    solved = written(induce(ordered), "induced")
    inside = solved.filter("key is null").select("id", "content", "first", "last")
    asked = solved.filter("key is not null")
    met = asked.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n"))
    met = met.filter("n > 1")
    between = asked.filter("not known").join(met, F.col("key") == F.col("_key"), "left_semi")
    between = between.select("id", "content", "first", "last")
    return plain.unionByName(equal).unionByName(inside).unionByName(between)


def covered(ranges_: list[dict]) -> list[tuple[int, int]]:
    """Bytes that the strings at the given ranges of starts cover, as maximal spans."""
    out: list[list[int]] = []
    for a, b in sorted((r["first"], r["last"] + LENGTH) for r in ranges_):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, spans (removed, in bytes), kept (the bytes
    left)."""
    rows = keyed(docs, doc_id, text)
    found = repeats(rows).groupBy("id", "content").agg(
        F.collect_set(F.struct("first", "last")).alias("starts")
    )
    found = found.withColumnsRenamed({"id": "_id", "content": "_content"})
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_content"))
    joined = rows.join(found.hint("shuffle_hash"), same, "left").select("id", "raw", "starts")
    kind = rows.schema["id"].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(first, OUT_ROWS)
                size, removed, cut, kept = [], [], [], []
                for raw, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    gone = covered(starts or [])
                    size.append(len(raw))
                    removed.append(sum(b - a for a, b in gone))
                    cut.append([{"start": a, "end": b} for a, b in gone])
                    kept.append(without(raw, gone))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(size, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(cut, pa.list_(span)),
                        pa.array(kept, pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "n_removed", "spans", "kept"],
                )

    return joined.mapInArrow(
        run,
        f"doc_id {kind}, n_bytes long, n_removed long, "
        "spans array<struct<start: bigint, end: bigint>>, kept binary",
    )
