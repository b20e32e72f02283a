"""Mixing sources to target weights.

Tokens are summed per source, each source gets a target, and a source's rate is
target / size. A document is emitted ``floor(rate)`` times, and once more with a
probability equal to the fraction that is left, decided by a hash of the document
and a seed: the same documents give the same mix, whatever the partitions.

Defined results for odd inputs:

- null text: size 0; an empty text likewise. Such documents follow their source's
  rate (they add no words); a source without words has target 0 and rate 0.
- null source: a source of its own, the last in order. A null id is hashed as such.
- repeated rows (equal id and text) are decided alike.
- ties: sources of equal names are one source, so there are none.
- empty table: no rows. Extra columns are passed on by ``mix`` and never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import written
from .tables import is_small, numbered

# Words: runs of anything but the six ASCII white-space characters.
WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 20
HASH_DIGITS = 13


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def chance(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the document and the seed: 52 bits of an MD5."""
    key = F.concat(
        F.lit(f"{seed}:"),
        F.coalesce(doc_id.cast("string"), F.lit("")),
        F.lit(":"),
        F.md5(F.coalesce(text, F.lit("")).cast("binary")),
    )
    digits = F.substring(F.md5(key.cast("binary")), 1, HASH_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**HASH_DIGITS))


def source_targets(
    sizes: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """(_source, _source_size) with ``_target``: sources in code point order, null
    last, have ``weights`` in turn and share ``share`` of all words. No target
    exceeds ``most`` times its source's size; the excess is shared again by weight
    until none does.

    Sharing again multiplies the targets of all sources below their cap alike, so
    only that multiplier is carried from round to round; each round is one
    aggregation of the table of sources, and one that caps no further source is
    the last.
    """
    order = [F.col("_source").asc_nulls_last()]
    turn = F.pmod(F.col("_place"), F.lit(len(weights))).cast("int")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), turn)
    cap = F.lit(most) * F.col("_source_size")
    weighed = numbered(sizes, order, "_place").select(
        "_source", "_source_size", weight.alias("_weight"), cap.alias("_cap")
    )
    weighed = written(weighed, "mix-weights")
    total = weighed.agg(F.sum("_source_size")).head()[0] or 0
    wanted = min(share, most) * total
    level, capped = 0.0, -1
    while True:
        over = F.col("_cap") < F.lit(level) * F.col("_weight")
        found = weighed.agg(
            F.count_if(over).alias("n"),
            F.sum(F.when(over, F.col("_cap"))).alias("caps"),
            F.sum(F.when(~over, F.col("_weight"))).alias("weights"),
        ).head()
        if found["n"] == capped or not found["weights"]:
            break
        capped, level = found["n"], (wanted - (found["caps"] or 0.0)) / found["weights"]
    target = F.least(F.col("_cap"), F.lit(level) * F.col("_weight"))
    return weighed.select("_source", "_source_size", target.alias("_target"))


def mix_plan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with how often each document is taken: all its columns as the
    struct ``row``, and ``size, source_size, target, copies``.

    The documents are not shuffled: only sums per source are (after a map-side
    sum, so a hot source costs nothing), and the table of targets is broadcast if
    its measured size allows, else joined on the source, where adaptive execution
    splits hot keys.
    """
    sizes = docs.groupBy(F.col(source).alias("_source")).agg(
        F.sum(word_count(F.col(text))).alias("_source_size")
    )
    targets = written(source_targets(sizes, weights, share, most), "mix-targets")
    if is_small(targets, "_source"):
        targets = F.broadcast(targets)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(source).alias("_own"),
        word_count(F.col(text)).alias("size"),
        chance(F.col(doc_id), F.col(text), seed).alias("_chance"),
    )
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size"))
    rate = F.coalesce(rate, F.lit(0.0))
    whole = F.floor(rate)
    extra = (F.col("_chance") < rate - whole).cast("long")
    joined = rows.join(targets, F.col("_own").eqNullSafe(F.col("_source")))
    return joined.select(
        "row",
        "size",
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (whole + extra).alias("copies"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: the columns of ``docs``, each row as often as taken."""
    plan = mix_plan(docs, **options).filter("copies > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return plan.select("row", copies.alias("_copy")).select("row.*")
