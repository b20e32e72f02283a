"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are grown on a bounded sample: a node's hyperplane lies midway between
two of its vectors, drawn at random; nodes of at most ``LEAF`` sample vectors are
leaves. Every row is then filed in one leaf of each tree. A query goes down all
trees at once through one priority queue, ordered by the squared distances to the
hyperplanes on whose other side a node lies, and visits the ``PROBES`` leaves that come
first. All vectors of those leaves are candidates, and are ranked by exact inner
products in double precision.

How many leaves it takes depends on the vectors, hardly on their number: where they
have no structure at all, as in random directions, nine tenths of the nearest are
found only by comparing with a third of all rows, whatever the index.

To seek the largest inner product with hyperplanes, stored vectors get one more
component, sqrt(longest^2 - length^2), and queries a zero there: the angle between
them then orders as the inner product does.

On Spark: filing and searching are one pass over the vectors each; a leaf's
vectors meet the queries that visit it in blocks of at most ``BLOCK`` rows by
``BLOCK`` queries (a large leaf becomes several blocks, a much visited one too), a
block hands on its best ``k`` per query, and these are merged. Of equal vectors
only the ``k + 1`` with the smallest ids can be among the answers, so only they
are filed: a vector that a third of all rows share fills no leaf.

Defined results for odd inputs: vectors that are null, empty, zero, or hold null or
non-finite components, or are not of the most frequent length, take no part, as
rows or as queries; rows with a null id take no part either; rows of one id and
vector are one; rows of one id and several vectors each count, the id listed once
with its best score; ties go to the smaller id; an empty table gives no rows; if
there are fewer candidates than ``k``, all are returned. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.workspace import written
from .tables import is_small

NEAREST = 20
# Rows of the sample that the trees are grown on, by a hash of the id.
SAMPLE = 16_384
TREES, LEAF, PROBES = 12, 64, 240
SEED = 11
# Rows, and queries, that meet in one task's block.
BLOCK = 2_048


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite numbers."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull()
        & ~F.isnan(x)
        & (F.abs(x) < F.lit(float("inf"))),
    )
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


class Tree:
    """Hyperplanes of the inner nodes; children >= 0 are nodes, others leaves."""

    def __init__(self, sample: np.ndarray, leaf: int, rng: np.random.Generator):
        self.normals: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.root = self.grow(sample, np.arange(len(sample)), leaf, rng)
        width = sample.shape[1]
        self.planes = np.array(self.normals, np.float32).reshape(-1, width)
        self.shifts = np.array(self.offsets, np.float32)
        del self.normals, self.offsets

    def grow(self, sample, rows, leaf, rng) -> int:
        for _ in range(3 if len(rows) > leaf else 0):
            a, b = sample[rng.choice(rows, 2, replace=False)]
            normal = a - b
            normal /= np.sqrt((normal**2).sum()) + 1e-12
            offset = -float(normal @ (a + b)) / 2
            right = sample[rows] @ normal + offset > 0
            if 0 < right.sum() < len(rows):
                node = len(self.normals)
                self.normals.append(normal)
                self.offsets.append(offset)
                self.children.append([0, 0])
                self.children[node][0] = self.grow(sample, rows[~right], leaf, rng)
                self.children[node][1] = self.grow(sample, rows[right], leaf, rng)
                return node
        self.leaves += 1
        return -self.leaves

    def file(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.empty(len(rows), np.int32)
        todo = [(self.root, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if node < 0 or not len(at):
                out[at] = -node - 1
                continue
            right = rows[at] @ self.planes[node] + self.shifts[node] > 0
            todo += zip(self.children[node], (at[~right], at[right]))
        return out


class Forest:
    def __init__(self, sample: np.ndarray, longest: float, trees=TREES, leaf=LEAF, seed=SEED):
        self.longest = longest
        stored = self.stored(sample).astype(np.float32)
        self.trees = [
            Tree(stored, leaf, np.random.default_rng([seed, i])) for i in range(trees)
        ]

    def stored(self, rows: np.ndarray) -> np.ndarray:
        rest = self.longest**2 - (rows**2).sum(axis=1)
        return np.column_stack([rows, np.sqrt(np.maximum(rest, 0))])

    def file(self, rows: np.ndarray) -> np.ndarray:
        """(tree, row) -> leaf."""
        rows = self.stored(rows).astype(np.float32)
        return np.array([tree.file(rows) for tree in self.trees])

    def search(self, query: np.ndarray, probes: int) -> list[tuple[int, int]]:
        """The (tree, leaf) pairs that the shared queue reaches first. The query
        is made as long as the longest row, so that margins are comparable."""
        length = float(np.sqrt((query**2).sum()))
        query = np.append(query * (self.longest / length), 0.0).astype(np.float32)
        margins = [tree.planes @ query + tree.shifts for tree in self.trees]
        queue = [(0.0, i, tree.root) for i, tree in enumerate(self.trees)]
        heapq.heapify(queue)
        found: list[tuple[int, int]] = []
        while queue and len(found) < probes:
            far, i, node = heapq.heappop(queue)
            if node < 0:
                found.append((i, -node - 1))
                continue
            margin = float(margins[i][node])
            left, right = self.trees[i].children[node]
            heapq.heappush(queue, (far + max(0.0, margin) ** 2, i, left))
            heapq.heappush(queue, (far + max(0.0, -margin) ** 2, i, right))
        return found


def unpacked(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, each summed component by component: equal vectors get equal
    scores, wherever they stand."""
    out = np.zeros((len(queries), len(rows)))
    for i in range(queries.shape[1]):
        out += queries[:, i, None] * rows[None, :, i]
    return out


def vectors_of(rows: DataFrame, row_id: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that take part."""
    kept = rows.select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    kept = kept.filter(F.col("id").isNotNull() & usable(F.col("v")))
    widths = kept.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").head()
    return kept.filter(F.size("v") == (widths["w"] if widths else 0))


def grow_forest(rows: DataFrame, **options) -> Forest | None:
    """A forest on a sample of ``SAMPLE`` rows at most, those whose ids' hashes are
    smallest."""
    longest = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).head()
    if longest[0] is None:
        return None
    picked = rows.orderBy(F.xxhash64(F.col("id"), F.lit(SEED)), "id").limit(SAMPLE)
    sample = np.array([r["v"] for r in picked.select("v").collect()], np.float64)
    return Forest(sample, longest[0], **options)


def smallest_ids(rows: DataFrame, k: int) -> DataFrame:
    """Of rows with equal vectors the ``k + 1`` of the smallest ids (a query may be
    one of them)."""
    nth = F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))
    hashed = rows.withColumn("h", F.xxhash64("v"))
    return hashed.withColumn("n", nth).filter(F.col("n") <= k + 1).select("id", "v")


def filed(rows: DataFrame, shared) -> DataFrame:
    """(tree, leaf, id, v): each row in its leaf of every tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            if batch.num_rows:
                leaves = forest.file(unpacked(batch.column(1)))
                for i, own in enumerate(leaves):
                    tree = pa.array(np.full(len(own), i, np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [tree, pa.array(own), *batch.columns], ["tree", "leaf", "id", "v"]
                    )

    return rows.mapInArrow(run, "tree int, leaf int, id long, v array<double>")


def visits(queries: DataFrame, shared, probes: int) -> DataFrame:
    """(tree, leaf, id, v): each query in every leaf that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                found = [forest.search(v, probes) for v in unpacked(part.column(1))]
                owner = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
                tree = pa.array([t for f in found for t, _ in f], pa.int32())
                leaf = pa.array([x for f in found for _, x in f], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [tree, leaf, *[c.take(owner) for c in part.columns]],
                    ["tree", "leaf", "id", "v"],
                )

    return queries.mapInArrow(run, "tree int, leaf int, id long, v array<double>")


def in_blocks(rows: DataFrame, asked: DataFrame, seed: int) -> DataFrame:
    """Rows and queries of each leaf, dealt into blocks: (tree, leaf, part, turn,
    is_row, id, v). A leaf of many rows has several parts and one of many queries
    several turns; every row meets every query of the leaf in just one block."""
    size = F.ceil(F.col("n") / BLOCK).cast("int")
    parts = rows.groupBy("tree", "leaf").agg(F.count("*").alias("n"))
    parts = parts.select("tree", "leaf", size.alias("parts"))
    turns = asked.groupBy("tree", "leaf").agg(F.count("*").alias("n"))
    turns = turns.select("tree", "leaf", size.alias("turns"))
    grid = written(parts.join(turns, ["tree", "leaf"]), "leaf-blocks")
    side = F.broadcast(grid) if is_small(grid) else grid
    hashed = F.xxhash64("id", "v", F.lit(seed))
    stored = rows.join(side, ["tree", "leaf"]).select(
        "tree", "leaf", F.pmod(hashed, "parts").cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"),
        F.lit(True).alias("is_row"), "id", "v",
    )
    seeking = asked.join(side, ["tree", "leaf"]).select(
        "tree", "leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.pmod(hashed, "turns").cast("int").alias("turn"),
        F.lit(False).alias("is_row"), "id", "v",
    )
    return stored.unionByName(seeking)


def best_of_block(k: int):
    """For ``applyInArrow``: each query's best ``k`` of the block's rows."""

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        is_row = block["is_row"].to_numpy(zero_copy_only=False)
        ids = block["id"].to_numpy()
        vectors = unpacked(block["v"].combine_chunks())
        row_ids, row_vectors = ids[is_row], vectors[is_row]
        order = np.argsort(row_ids, kind="stable")
        row_ids, row_vectors = row_ids[order], row_vectors[order]
        out: list[tuple[np.ndarray, ...]] = []
        asked, asked_vectors = ids[~is_row], vectors[~is_row]
        for first in range(0, len(asked), 256):
            scores = products(asked_vectors[first : first + 256], row_vectors)
            for own, score in zip(asked[first : first + 256], scores):
                score[row_ids == own] = -np.inf
                at = np.argsort(-score, kind="stable")[:k]
                at = at[score[at] > -np.inf]
                out.append((np.full(len(at), own), row_ids[at], score[at]))
        columns = [np.concatenate(c) if out else np.empty(0) for c in zip(*out)] or [[]] * 3
        return pa.table(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))],
            ["query_id", "vec_id", "score"],
        )

    return run


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int = NEAREST,
    probes: int = PROBES,
    row_id: str = "vec_id",
    vector: str = "embedding",
    **options,
) -> DataFrame:
    """The ``k`` nearest rows found for each query: query_id, rank (from 1), vec_id,
    score. Rows of a query's own id are not candidates."""
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    stored = vectors_of(rows, row_id, vector)
    forest = grow_forest(stored, **options)
    if forest is None:
        return empty
    asked = vectors_of(queries, row_id, vector).distinct()
    shared = spark.sparkContext.broadcast(forest)
    filed_rows = written(filed(smallest_ids(stored.distinct(), k), shared), "filed")
    visiting = written(visits(asked, shared, probes), "visits")
    blocks = in_blocks(filed_rows, visiting, SEED)
    found = blocks.groupBy("tree", "leaf", "part", "turn").applyInArrow(
        best_of_block(k), "query_id long, vec_id long, score double"
    )
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
