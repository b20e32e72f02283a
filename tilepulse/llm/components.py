"""Connected components of a table of edges, by alternating large and small stars.

Each step is one aggregation (with map-side minima) and one join back, so a node
with very many edges neither lands in one task (adaptive execution splits it) nor
has its neighbours collected. The edges after each round are written to the shared
folder; rounds go on until nothing changes, about the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import written


def _starred(edges: DataFrame, larger: bool) -> DataFrame:
    """One step: every node's larger (or no larger) neighbours are linked to the
    least node among them and itself."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if larger:
        seen = both
    else:
        seen = both.filter("b < a")
    least = seen.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select(F.col("a").alias("_a"), F.least("a", "m").alias("m"))
    joined = seen.join(least, F.col("a") == F.col("_a"))
    if larger:
        linked = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("_a").alias("a"), F.col("m").alias("b"))
        )
    return linked.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node that
    it is connected with. Any type with an order will do for nodes."""
    edges = edges.select("a", "b").filter("a <> b")
    mark = None
    while True:
        edges = written(_starred(_starred(edges, True), False), "stars")
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).head()
        if now == mark:
            break
        mark = now
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
