"""Sharding by extendible hashing, with DataFrame functions only.

A document's hash has 60 bits. A directory indexed by the first ``D`` bits points
to shards; a shard holds the documents that share its first ``depth`` bits, and
only a shard above the byte limit is split on another bit, until each fits.

All depths up to the directory's are summed at once from its cells (there are a
few cells per shard, whatever the number of documents). Cells that still exceed
the limit are the next round's input, a few bits deeper: rounds are few, and each
reads only what the last left over. Neither documents nor cells visit the driver.

What no bit can split: a document larger than the limit is a shard by itself
(``shard_bytes`` tells); rows equal in id and text share all bits and get overflow
pages of at most the limit, numbered by ``page``.

Defined results for odd inputs: null text has 0 bytes, as an empty one; a null id
is hashed as such; repeated rows see above; ties do not arise, as a shard is a
range of hashes; an empty table gives no rows. ``write_shards`` writes extra columns
as they are, none is read, and names starting with ``_shard`` are its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.workspace import written
from .tables import is_small

LIMIT_BYTES = 1 << 20
# Bits of a hash: the first 15 hexadecimal digits of an MD5.
BITS, HEX_DIGITS = 60, 15
# Bits of a directory beyond those that its shards need on average; bits added by
# each further round.
SPARE_BITS, ROUND_BITS = 2, 6
SHARD = ["_shard_depth", "_shard_prefix"]


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def hash_bits(doc_id: Column, text: Column) -> Column:
    key = F.concat(
        F.coalesce(doc_id.cast("string"), F.lit("")),
        F.lit(":"),
        F.md5(F.coalesce(text, F.lit("")).cast("binary")),
    )
    digits = F.substring(F.md5(key.cast("binary")), 1, HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("long")


def prefix(hashed: Column, depth: Column | int) -> Column:
    """The first ``depth`` bits of a hash."""
    shift = F.lit(BITS) - (F.lit(depth) if isinstance(depth, int) else depth)
    return F.call_function("shiftright", hashed, shift.cast("int"))


def sums(size: str = "_bytes", docs: Column | None = None) -> list[Column]:
    """Bytes and documents of a node, and the range of its hashes: a node of one
    hash cannot be split."""
    return [
        F.sum(size).alias("_bytes"),
        F.sum(docs if docs is not None else F.col("_docs")).alias("_docs"),
        F.min("_low").alias("_low"),
        F.max("_high").alias("_high"),
    ]


def shard_leaves(cells: DataFrame, least: int, most: int, limit: int) -> DataFrame:
    """The shards of depths ``least..most`` above the given cells of depth
    ``most``: nodes that are final while their parents are not."""
    deep = F.explode(F.sequence(F.lit(least), F.lit(most))).alias("_shard_depth")
    climbed = cells.select("*", deep).withColumn(
        "_shard_prefix",
        F.call_function("shiftright", "_cell", (F.lit(most) - F.col("_shard_depth")).cast("int")),
    )
    nodes = climbed.groupBy(*SHARD).agg(*sums())
    final = nodes.filter((F.col("_bytes") <= limit) | (F.col("_low") == F.col("_high")))
    parents = final.select(
        (F.col("_shard_depth") + 1).alias("_d"), F.col("_shard_prefix").alias("_p")
    )
    above = F.call_function("shiftright", "_shard_prefix", F.lit(1))
    same = (F.col("_shard_depth") == F.col("_d")) & (above == F.col("_p"))
    return final.join(parents, same, "left_anti")


def shard_directory(sizes: DataFrame, limit: int = LIMIT_BYTES) -> list[tuple[int, DataFrame]]:
    """From rows of (``_hash``, ``_bytes``): a directory for each round, as (bits,
    table). A table maps ``_cell``, that many first bits of a hash, to a shard
    (depth, prefix) and its bytes and documents; a hash is listed in one of them."""
    total, count = sizes.agg(F.sum("_bytes"), F.count("*")).head()
    if not count:
        return []
    most = min(BITS, SPARE_BITS + max(0, math.ceil(math.log2(max(1, total) / limit))))
    least, rest, rounds = 0, sizes, []
    while True:
        cells = (
            rest.withColumn("_cell", prefix(F.col("_hash"), most))
            .withColumns({"_low": F.col("_hash"), "_high": F.col("_hash")})
            .groupBy("_cell")
            .agg(*sums(docs=F.lit(1)))
        )
        cells = written(cells, "cells")
        leaves = written(shard_leaves(cells, least, most, limit), "shards")
        spread = F.lit(most) - F.col("_shard_depth")
        first = F.call_function("shiftleft", F.col("_shard_prefix"), spread.cast("int"))
        width = F.call_function("shiftleft", F.lit(1).cast("long"), spread.cast("int"))
        entries = leaves.select(
            F.explode(F.sequence(first, first + width - 1)).alias("_cell"),
            *SHARD,
            F.col("_bytes").alias("_shard_bytes"),
            F.col("_docs").alias("_shard_docs"),
            (F.col("_low") == F.col("_high")).alias("_shard_single"),
        )
        entries = written(entries.join(cells.select("_cell"), "_cell", "left_semi"), "directory")
        rounds.append((most, entries))
        over = cells.join(entries, "_cell", "left_anti").select("_cell")
        if most == BITS or over.isEmpty():
            return rounds
        rest = rest.withColumn("_cell", prefix(F.col("_hash"), most))
        rest = written(rest.join(over, "_cell", "left_semi").drop("_cell"), "unsplit")
        least, most = most + 1, min(BITS, most + ROUND_BITS)


def assigned(rows: DataFrame, directory: list[tuple[int, DataFrame]], limit: int) -> DataFrame:
    """Rows with ``_hash`` and ``_bytes`` get ``_shard_depth, _shard_prefix,
    _shard_bytes, _shard_docs, _shard_page``."""
    found = None
    for bits, entries in directory:
        side = F.broadcast(entries) if is_small(entries) else entries
        part = rows.withColumn("_cell", prefix(F.col("_hash"), bits))
        part = part.join(side, "_cell").drop("_cell")
        found = part if found is None else found.unionByName(part)
    if found is None:
        empty = "0 _shard_depth, 0L _shard_prefix, 0L _shard_bytes, 0L _shard_docs, 0 _shard_page"
        return rows.selectExpr("*", *empty.split(", ")).limit(0)
    paged = F.col("_shard_single") & (F.col("_shard_docs") > 1) & (F.col("_shard_bytes") > limit)
    if not any(not t.filter(paged).isEmpty() for _, t in directory):
        return found.withColumn("_shard_page", F.lit(0)).drop("_shard_single")
    plain = found.filter(~paged).withColumn("_shard_page", F.lit(0))
    equal = with_pages(found.filter(paged), limit)
    return plain.unionByName(equal).drop("_shard_single")


def with_pages(rows: DataFrame, limit: int) -> DataFrame:
    """Overflow pages for rows of equal hash, which are equal rows, however many:
    dealt evenly over tasks, numbered in each, and shifted by the counts of the
    tasks before. A page's ``_shard_bytes`` and ``_shard_docs`` are its own."""
    dealt = written(
        rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
        .withColumn("_part", F.spark_partition_id()),
        "equal-rows",
    )
    here = Window.partitionBy("_hash", "_part")
    before = Window.partitionBy("_hash").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_hash", "_part").agg(F.count("*").alias("_n"))
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    shifts = counts.select("_hash", "_part", shift)
    nth = F.row_number().over(here.orderBy("_bytes")) - 1 + F.col("_before")
    fits = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("_bytes")))
    left = F.col("_shard_docs") - F.col("_shard_page") * fits
    return (
        dealt.join(shifts, ["_hash", "_part"])
        .withColumn("_shard_page", F.floor(nth / fits).cast("int"))
        .withColumn("_shard_docs", F.least(fits, left))
        .withColumn("_shard_bytes", F.col("_shard_docs") * F.col("_bytes"))
        .drop("_part", "_before")
    )


def shard_plan(
    docs: DataFrame, limit: int = LIMIT_BYTES, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_bytes, and its shard: depth (bits), shard (their value),
    page, shard_bytes, shard_docs. The texts are read once and never shuffled."""
    hashed = hash_bits(F.col(doc_id), F.col(text)).alias("_hash")
    rows = docs.select(F.col(doc_id).alias("_id"), hashed, text_bytes(F.col(text)).alias("_bytes"))
    rows = written(rows, "hashes")
    found = assigned(rows, shard_directory(rows.select("_hash", "_bytes"), limit), limit)
    return found.select(
        F.col("_id").alias("doc_id"),
        F.col("_bytes").alias("n_bytes"),
        F.col("_shard_depth").alias("depth"),
        F.col("_shard_prefix").alias("shard"),
        F.col("_shard_page").alias("page"),
        F.col("_shard_bytes").alias("shard_bytes"),
        F.col("_shard_docs").alias("shard_docs"),
    )


def write_shards(
    docs: DataFrame,
    path: str,
    limit: int = LIMIT_BYTES,
    doc_id: str = "doc_id",
    text: str = "text",
) -> None:
    """Write the documents as one Parquet folder per shard."""
    hashed, size = hash_bits(F.col(doc_id), F.col(text)), text_bytes(F.col(text))
    rows = docs.select(F.struct("*").alias("_row"), hashed.alias("_hash"), size.alias("_bytes"))
    sizes = written(rows.select("_hash", "_bytes"), "hashes")
    found = assigned(rows, shard_directory(sizes, limit), limit)
    bits = F.lpad(F.bin("_shard_prefix"), F.col("_shard_depth"), F.lit("0"))
    name = F.concat_ws("-", F.lit("shard"), bits, F.col("_shard_page"))
    (
        found.select("_row.*", name.alias("_shard"))
        .repartition("_shard")
        .write.partitionBy("_shard")
        .parquet(path)
    )
