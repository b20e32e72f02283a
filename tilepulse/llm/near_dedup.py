"""Near-duplicate texts by Order MinHash, verified by banded alignment.

A text is the sequence of its k-mers, ``K`` consecutive words each, labelled with
their occurrence (a k-mer's second occurrence differs from its first). A sketch
draws the ``DRAWN`` k-mers of least hash and keeps them *in text order*; two texts
share a sketch if they drew the same k-mers in the same order. ``ROWS`` sketches make
a band, and texts that share a band of ``BANDS`` are candidates.

Candidates are verified by alignment of their k-mer sequences: the longest common
subsequence within the band of diagonals that the similarity allows. Two texts are
near-duplicates if common / (length a + length b - common) is at least ``SIMILAR``,
the Jaccard similarity of the labelled k-mers that keep their order.

Classes are the connected components of these links. Texts of equal words are one
node from the start, so copies cost a row each. In a bucket every node is compared
with one pivot first; only buckets that are not one component by then go on. Their
nodes meet in bounded blocks, where the Jaccard similarity of k-mers (which is never less
than that in order) of all pairs comes from a matrix product, and those that reach the
limit are aligned while they lie in different components. Blocks hand on the links that
join components, never pairs, and no candidate that could join two is passed by.

Defined results for odd inputs:

- null, empty and wordless texts: each document is its own class.
- texts of fewer than ``K`` words have one k-mer, all their words.
- repeated rows and copies are in one class; ``class_id`` is its smallest doc_id (null
  only if all of them are). ``keep_first`` keeps one row of each class, of rows equal in
  id and text any.
- an empty table gives no rows. Extra columns are kept by ``keep_first``, never read;
  names starting with ``_dup`` are its own.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import written
from .components import components
from .tables import HELD_ROWS

K = 5
SIMILAR = 0.8
DRAWN, ROWS, BANDS = 2, 2, 16
SEED = 7
# K-mers of a text that are sketched at once.
SKETCHED = 1 << 15
# Words whose hash a worker remembers (some 150 bytes each; forgotten ones are hashed again).
MEMORY = 1 << 16
# Nodes and k-mers that meet in one task's block, and columns of its matrix at once.
BLOCK, BLOCK_MERS, COLUMNS = 2_048, 2_000_000, 2_048
# Mixing constants (fixed values: the 64-bit finalizer of SplitMix, and its step).
MIX_A, MIX_B, STEP = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
U = np.uint64
SEEDS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(MIX_A)
    x = (x ^ (x >> U(27))) * U(MIX_B)
    return x ^ (x >> U(31))


class Words:
    """Hashes of words, remembered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known, out = self.known, np.empty(len(words), np.uint64)
        for i, word in enumerate(words):
            value = known.get(word)
            if value is None:
                if len(known) >= MEMORY:
                    known.clear()
                value = known[word] = xxhash.xxh3_64_intdigest(word)
            out[i] = value
        return out


def kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers of a text, given those of its words."""
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mixed(out + words[i : i + n] + U(STEP))
    return out


def labelled(mers: np.ndarray) -> np.ndarray:
    """K-mers with their occurrence worked in; all differ."""
    order = np.argsort(mers, kind="stable")
    ordered = mers[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    if len(starts) == len(mers):
        return mers
    nth = np.arange(len(mers)) - np.repeat(starts, np.diff(np.r_[starts, len(mers)]))
    out = mers.copy()
    out[order] = np.where(nth > 0, mixed(ordered + nth.astype(np.uint64) * U(STEP)), ordered)
    return out


def sketches(marked: np.ndarray) -> np.ndarray:
    """One number per sketch: the drawn k-mers, in text order."""
    n, drawn = len(marked), min(DRAWN, len(marked))
    per_sketch = max(1, min(len(SEEDS[0]), SKETCHED * 32 // n))
    out = np.empty(len(SEEDS[0]), np.uint64)
    for first in range(0, len(out), per_sketch):
        xor, times = SEEDS[:, first : first + per_sketch, None]
        ranks = mixed((marked[None, :] ^ xor) * (times | U(1)))
        least = np.argpartition(ranks, drawn - 1, axis=1)[:, :drawn]
        picked = marked[np.sort(least, axis=1)]
        value = np.zeros(len(picked), np.uint64)
        for i in range(drawn):
            value = mixed(value + picked[:, i] + U(STEP))
        out[first : first + per_sketch] = value
    return out


def bands(marked: np.ndarray) -> np.ndarray:
    """Bucket of each band."""
    parts = sketches(marked).reshape(BANDS, ROWS)
    value = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        value = mixed(value * U(STEP) + parts[:, i])
    return value


def common_in_order(a: np.ndarray, b: np.ndarray, band: int) -> tuple[int, int]:
    """(common labelled k-mers in any order, those of the longest common
    subsequence within the band). What both begin and end with is aligned as it is."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    a, b, n = a[head:], b[head:], n - head
    tail = 0
    if n:
        same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
        tail = n if same.all() else int(same.argmin())
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail, head + tail
    _, at_a, at_b = np.intersect1d(labelled(a), labelled(b), True, True)
    order = np.argsort(at_a)
    at_a, at_b = at_a[order], at_b[order]
    ends: list[int] = []  # least end of an increasing run of each length
    for place in at_b[np.abs(at_a - at_b) <= band].tolist():
        i = bisect_left(ends, place)
        if i == len(ends):
            ends.append(place)
        else:
            ends[i] = place
    return head + tail + len(at_a), head + tail + len(ends)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> tuple[float, float]:
    """(Jaccard similarity of labelled k-mers, that of those in order). The second is
    exact if it is at least ``least``: an alignment that reaches it leaves at most
    ``both * (1 - least) / (1 + least)`` k-mers out, so no diagonal beyond is needed."""
    both = len(a) + len(b)
    band = int(both * (1 - least) / (1 + least)) + 1
    common, aligned = common_in_order(a, b, band)
    return common / (both - common), aligned / (both - aligned)


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def described(batches: Iterator[pa.RecordBatch], sequences: bool) -> Iterator[pa.RecordBatch]:
    """Rows (id, content, raw) with what ``prepared`` finds in ``raw``. Of the texts of a
    batch one at a time is Python's."""
    memory = Words()
    for whole in batches:
        for first in range(0, whole.num_rows, HELD_ROWS):
            batch = whole.slice(first, HELD_ROWS)
            nodes, sizes, values = [], [], []
            for raw in batch.column(2):
                words = raw.as_py().lower().split()
                if not words:
                    nodes.append(None), sizes.append(0), values.append(None)
                    continue
                mers = kmers(memory.hashes(words))
                nodes.append(xxhash.xxh3_128_digest(b" ".join(words)))
                sizes.append(len(mers))
                if sequences:
                    values.append((mers >> U(32)).astype(np.uint32).tobytes())
                else:
                    values.append(bands(labelled(mers)).view(np.int64))
            last = pa.array(values, pa.binary() if sequences else pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(nodes, pa.binary()),
                    pa.array(sizes, pa.int32()),
                    last,
                ],
                ["id", "content", "node", "size", "mers" if sequences else "buckets"],
            )


def prepared(docs: DataFrame, doc_id: str, text: str, sequences: bool) -> DataFrame:
    """Per row: ``id``, ``content`` (hash of the text), ``node`` (digest of the words, null
    without any), ``size`` (k-mers), and ``buckets`` or, if asked for, ``mers``."""
    rows = docs.select(
        F.col(doc_id).alias("id"),
        F.xxhash64(F.col(text)).alias("content"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return described(batches, sequences)

    kind = rows.schema["id"].dataType.simpleString()
    last = "mers binary" if sequences else "buckets array<bigint>"
    return rows.mapInArrow(run, f"id {kind}, content long, node binary, size int, {last}")


def compared(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """Pairs (a, b) with ``jaccard`` and ``similar`` (both as of ``similarity``). The
    sequences come by two joins that adaptive execution splits where a node is in
    very many pairs."""
    left = sequences.select(F.col("node").alias("_a"), F.col("mers").alias("left"))
    right = sequences.select(F.col("node").alias("_b"), F.col("mers").alias("right"))
    joined = pairs.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b in zip(batch.column(2), batch.column(3)):
                found.append(similarity(unpacked(a), unpacked(b)))
            jaccard, aligned = zip(*found) if found else ([], [])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(jaccard, pa.float64()), pa.array(aligned, pa.float64())],
                ["a", "b", "jaccard", "aligned"],
            )

    return joined.select("a", "b", "left", "right").mapInArrow(
        run, "a binary, b binary, jaccard double, aligned double"
    )


def pivot_pairs(members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of a node and its bucket's pivot, the node of least hash.
    Lengths that rule a pair out are left out."""
    hashed = F.struct(F.xxhash64("node", F.lit(SEED)).alias("h"), "node", "size")
    pivots = members.groupBy("bucket").agg(F.min(hashed).alias("p"))
    pivots = pivots.select("bucket", "p.node", "p.size").toDF("_bucket", "b", "_size")
    joined = members.join(pivots, F.col("bucket") == F.col("_bucket"))
    fits = F.least("size", "_size") >= SIMILAR * F.greatest("size", "_size")
    return (
        joined.filter((F.col("node") != F.col("b")) & fits)
        .select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))
        .distinct()
    )


def rooted(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members with the ``root`` of their component so far."""
    found = components(links).withColumnRenamed("node", "_node")
    joined = members.join(found, F.col("node") == F.col("_node"), "left")
    return joined.withColumn("root", F.coalesce("root", "node")).drop("_node")


def unresolved(members: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component."""
    mixed_up = members.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    mixed_up = mixed_up.filter("lo <> hi").select(F.col("bucket").alias("_bucket"))
    return members.join(mixed_up, F.col("bucket") == F.col("_bucket"), "left_semi")


def block_links(block: pa.Table) -> pa.Table:
    """For ``applyInArrow``: links (a, b) between nodes of a block that join components
    not joined so far. The Jaccard similarity of all of the block's pairs comes from
    products of its matrix of nodes and k-mers; pairs that reach the limit are aligned
    as long as they lie in different components."""
    nodes, first = np.unique(np.array(block["node"].to_pylist(), object), return_index=True)
    roots = [block["root"][int(i)].as_py() for i in first]
    marked = [labelled(unpacked(block["mers"][int(i)])) for i in first]
    sizes = np.array([len(m) for m in marked])
    owner = np.repeat(np.arange(len(nodes)), sizes)
    mers, place, often = np.unique(np.concatenate(marked), return_inverse=True, return_counts=True)
    shared = np.zeros((len(nodes), len(nodes)), np.float32)
    kept = np.flatnonzero(often > 1)
    for start in range(0, len(kept), COLUMNS):
        column = np.full(len(mers), -1)
        part = kept[start : start + COLUMNS]
        column[part] = np.arange(len(part))
        at = column[place]
        matrix = np.zeros((len(nodes), len(part)), np.float32)
        matrix[owner[at >= 0], at[at >= 0]] = 1
        shared += matrix @ matrix.T
    jaccard = shared / (sizes[:, None] + sizes[None, :] - shared)
    left, right = np.nonzero(np.triu(jaccard >= SIMILAR - 1e-6, 1))
    best = np.argsort(-jaccard[left, right], kind="stable")
    parent = {root: root for root in roots}

    def top(root):
        while parent[root] != root:
            root = parent[root] = parent[parent[root]]
        return root

    found = []
    for i, j in zip(left[best].tolist(), right[best].tolist()):
        x, y = top(roots[i]), top(roots[j])
        if x != y:
            one, two = (unpacked(block["mers"][int(first[k])]) for k in (i, j))
            if similarity(one, two)[1] >= SIMILAR:
                parent[x] = y
                found.append((nodes[i], nodes[j]))
    columns = list(zip(*found)) or [[], []]
    return pa.table([pa.array(c, pa.binary()) for c in columns], ["a", "b"])


def unpacked(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint32).astype(np.uint64)


def remaining_links(members: DataFrame, sequences: DataFrame) -> DataFrame:
    """Links between nodes of a bucket that are in different components. A bucket of
    more than ``BLOCK`` nodes, or ``BLOCK_MERS`` k-mers, is dealt into parts, and each two
    parts meet in a block of their own: blocks are bounded, and no pair is passed by."""
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_MERS)).cast("int")
    sizes = members.groupBy(F.col("bucket").alias("_bucket")).agg(parts.alias("parts"))
    mers = sequences.select(F.col("node").alias("_node"), "mers")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    own = F.pmod(F.xxhash64("node", "bucket"), "parts").cast("int")
    dealt = (
        members.join(sizes, F.col("bucket") == F.col("_bucket"))
        .select("bucket", "node", "root", own.alias("own"), other.alias("other"))
        .select("bucket", "node", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .join(mers, F.col("node") == F.col("_node"))
        .select("bucket", "i", "j", "node", "root", "mers")
    )
    return dealt.groupBy("bucket", "i", "j").applyInArrow(block_links, "a binary, b binary")


def near_links(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows: id, content, node) and (nodes' components: node, root)."""
    rows = written(prepared(docs, doc_id, text, False), "sketches")
    whole = rows.filter("node is not null")
    place = F.struct("id", "content")
    nodes = whole.groupBy("node").agg(
        F.min(place).alias("place"), F.first("size").alias("size"), F.first("buckets").alias("buckets")
    )
    nodes = written(nodes, "nodes")
    members = nodes.select("node", "size", F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").count().filter("count > 1").select(F.col("bucket").alias("_bucket"))
    members = written(
        members.join(shared, F.col("bucket") == F.col("_bucket"), "left_semi"), "members"
    )
    needed = members.select("node").distinct().join(nodes.select("node", "place"), "node")
    needed = needed.select("node", "place.id", "place.content").toDF("_node", "_id", "_content")
    sequences = prepared(docs, doc_id, text, True).select("id", "content", "mers")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_content"))
    sequences = sequences.join(needed.hint("shuffle_hash"), same)
    sequences = written(
        sequences.select(F.col("_node").alias("node"), "mers").dropDuplicates(["node"])
        if has_repeats(whole)
        else sequences.select(F.col("_node").alias("node"), "mers"),
        "sequences",
    )
    done = written(compared(pivot_pairs(members), sequences), "compared")
    links = done.filter(F.col("aligned") >= SIMILAR).select("a", "b")
    members = written(unresolved(rooted(members, links)), "members")
    if not members.isEmpty():
        links = links.unionByName(written(remaining_links(members, sequences), "links"))
    return rows, components(links)


def has_repeats(rows: DataFrame) -> bool:
    """Whether two rows are equal in id and text."""
    twice = rows.groupBy("id", "content").count().filter("count > 1")
    return not twice.isEmpty()


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, class_size, and ``content``, the hash of
    its text."""
    rows, found = near_links(docs, doc_id, text)
    found = found.withColumnRenamed("node", "_node")
    joined = rows.select("id", "content", "node").join(found, F.col("node") == F.col("_node"), "left")
    own = joined.select("id", "content", "node", F.coalesce("root", "node").alias("root"))
    own = written(own, "roots")
    sizes = own.filter("root is not null").groupBy("root").agg(
        F.min("id").alias("class_id"), F.count("*").alias("class_size")
    )
    sizes = sizes.withColumnRenamed("root", "_root")
    named = own.join(sizes, F.col("root") == F.col("_root"), "left")
    alone = F.col("root").isNull()
    return named.select(
        F.col("id").alias("doc_id"),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, 1).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        "content",
        "root",
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, with all its columns: that of the smallest id."""
    found = written(classes(docs, doc_id, text), "classes")
    place = F.struct("doc_id", "content")
    first = found.filter("root is not null").groupBy("root").agg(F.min(place).alias("p"))
    first = first.select("p.*").unionByName(
        found.filter("root is null").select("doc_id", "content").distinct()
    )
    first = first.toDF("_dup_id", "_dup_content")
    hashed = docs.withColumn("_dup_hash", F.xxhash64(F.col(text)))
    same = F.col(doc_id).eqNullSafe(F.col("_dup_id")) & (F.col("_dup_hash") == F.col("_dup_content"))
    kept = hashed.join(first.hint("shuffle_hash"), same, "left_semi")
    if has_repeats(found.filter("root is not null").selectExpr("doc_id as id", "content")):
        wordless = F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]")), F.lit(0)) == 0
        kept = kept.filter(wordless).unionByName(
            kept.filter(~wordless).dropDuplicates([doc_id, "_dup_hash"])
        )
    return kept.drop("_dup_hash")
