"""Spelling variants: words one edit apart, and the frequent form each belongs to.

Two words one edit apart share their first half or their last half (of the longer
one). So every word is filed under its first half and under its last; what is left of
the words of one group is a sorted list. The list is scanned once for all words of the
group: the three cells of a banded edit matrix are kept per word and depth, a list
entry goes on from the depth of the prefix that it shares with the entry before it,
and a word whose cells all exceed one edit is left out of the whole range of entries
with that prefix. A range left to one word only is skipped.

A group of more than ``GROUP`` words is filed again by the halves of what is left, as
often as needed: with two characters left, an alphabet of 90 allows no larger group.
Every pair is reported by one group only, so nothing is compared or counted twice.

Defined results for odd inputs:

- null or empty text, or one without letters: no words. A null id counts as "".
- very long words are words; they are filed by halves like others.
- ties between forms of equal count go to the smaller word (by code points).
- repeated rows count as often as they occur.
- empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import broadcast_if_small
from ..sources.workspace import written

BREAK = "[^A-Za-zÀ-ÿ]+"
# One (document, run) in so many loses a character.
DAMAGE = 199
LEAST_LENGTH, LEAST_COUNT = 6, 5
# A form occurs so many times as often as its variant.
RATIO = 5
# Most words of a group: at least 1 + 90 + 90 * 90.
GROUP = 8_192
FAR = 9


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    lowered = F.translate(F.col(text), ascii_uppercase, ascii_lowercase)
    runs = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc"),
        F.explode(F.split(lowered, BREAK)).alias("run"),
    ).filter(F.length("run") >= LEAST_LENGTH)
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "doc", "run").cast("binary")).alias("hash"))
    place = F.pmod("hash", F.length("run").cast("long")).cast("int")
    cut = F.concat(F.expr("left(run, place)"), F.expr("substring(run, place + 2)"))
    words = hashed.withColumn("place", place).select(
        F.when(F.col("hash") % DAMAGE == 0, cut).otherwise(F.col("run")).alias("word")
    )
    counted = words.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


# Filing words under their halves.

KEY = ["path", "head", "tail"]


def filed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, path, head, tail) filed once more, under the halves of what lies
    between head and tail. ``path`` says how: "f3b2" is three characters in front, then two
    at the end. Words of different lengths have halves in common as both are tried."""
    left = F.length("word") - F.length("head") - F.length("tail")
    halves = F.array_distinct(F.array(F.expr("left div 2"), F.expr("(left + 1) div 2")))
    each = (
        rows.withColumn("left", left)
        .withColumn("half", F.explode(halves))
        .withColumn("side", F.explode(F.array(F.lit("f"), F.lit("b"))))
        .filter("side = 'f' or half > 0")
    )
    front = F.length("head") + F.when(F.col("side") == "f", F.col("half")).otherwise(0)
    back = F.length("tail") + F.when(F.col("side") == "b", F.col("half")).otherwise(0)
    placed = each.withColumn("front", front.cast("int")).withColumn("back", back.cast("int"))
    return placed.select(
        "word",
        "n",
        F.concat("path", "side", F.col("half").cast("string")).alias("path"),
        F.expr("left(word, front)").alias("head"),
        F.expr("right(word, back)").alias("tail"),
    )


def small_groups(words: DataFrame, most: int = GROUP) -> DataFrame:
    """Rows (word, n, path, head, tail) whose groups hold ``most`` words at most."""
    empty = [F.lit("").alias(c) for c in KEY]
    rows, parts = filed(words.select("word", "n", *empty)), []
    while True:
        sizes = rows.groupBy(*KEY).count().filter(F.col("count") > most)
        large = written(sizes.select(*KEY), "large-groups")
        if large.isEmpty():
            break
        large = broadcast_if_small(large)
        parts.append(rows.join(large, KEY, "left_anti"))
        rows = filed(rows.join(large, KEY, "left_semi"))
    for part in parts:
        rows = rows.unionByName(part)
    return rows


# Scanning the list of a group.


def codes(words: list[str]) -> np.ndarray:
    """A row of code points for each word, -1 around it."""
    lengths = [len(w) for w in words]
    out = np.full((len(words), max(lengths) + 4), -1, np.int32)
    for row, word, n in zip(out, words, lengths):
        row[1 : n + 1] = np.frombuffer(word.encode("utf-32-le"), np.int32)
    return out


def one_edit(middles: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in a sorted list of different texts that are one edit apart, each
    pair both ways round."""
    text = codes(middles)
    size = np.array([len(m) for m in middles])
    count = len(middles)
    everyone = np.arange(count)
    # Per depth: the words still near, and their cells for one character less than the
    # depth, as many, and one more.
    rows = [(everyone, np.full(count, FAR), np.zeros(count, int), np.ones(count, int))]
    asked, found = [], []
    dead = None  # entries that share this many characters with the last are skipped
    for k, entry in enumerate(middles):
        shared = 0
        if k:
            before = middles[k - 1]
            limit = min(len(before), len(entry))
            while shared < limit and before[shared] == entry[shared]:
                shared += 1
            if dead is not None and shared >= dead:
                continue
        dead = None
        depth = min(shared, len(rows) - 1)
        del rows[depth + 1 :]
        while depth < len(entry):
            who, less, same, more = rows[-1]
            char = text[k, depth + 1]
            columns = text[who, depth : depth + 3]
            differ = columns != char
            new_less = np.minimum(less + differ[:, 0], same + 1)
            new_same = np.minimum(np.minimum(same + differ[:, 1], more + 1), new_less + 1)
            new_more = np.minimum(more + differ[:, 2], new_same + 1)
            near = np.minimum(np.minimum(new_less, new_same), new_more) <= 1
            depth += 1
            rows.append((who[near], new_less[near], new_same[near], new_more[near]))
            if len(rows[-1][0]) < 2:  # the entry itself is always near
                dead = depth
                break
        if dead is not None:
            continue
        who, less, same, more = rows[-1]
        gap = size[who] - len(entry)
        cost = np.where(gap == 0, same, np.where(gap == -1, less, np.where(gap == 1, more, FAR)))
        hits = who[cost == 1]
        if len(hits):
            asked.append(hits)
            found.append(np.full(len(hits), k))
    if not asked:
        return everyone[:0], everyone[:0]
    return np.concatenate(asked), np.concatenate(found)


def own_pairs(path: str, words: list[str], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which pairs are this group's to report: at each filing the longer word has
    the half that was filed, and for last halves, the first ones differ."""
    own = np.ones(len(one), bool)
    left, front = np.array([len(w) for w in words]), 0
    for side, digits in re.findall(r"([fb])(\d+)", path):
        half = int(digits)
        own &= np.maximum(left[one], left[two]) // 2 == half
        if side == "f":
            front += half
        else:
            number: dict[str, int] = {}
            first = [number.setdefault(w[front : front + half], len(number)) for w in words]
            first = np.array(first)
            own &= first[one] != first[two]
        left = left - half
    return own


def near_words(group: list[tuple], path: str, head: str, tail: str) -> list[tuple]:
    """(word, n_near, best_n, best) of the words of a group that have near ones in it."""
    middles, counts = [g[0] for g in group], np.array([g[1] for g in group])
    one, two = one_edit(middles)
    words = [head + m + tail for m in middles]
    own = own_pairs(path, words, one, two)
    one, two = one[own], two[own]
    if not len(one):
        return []
    rank = np.empty(len(words), int)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[two], -counts[two], one))
    one, two = one[order], two[order]
    starts = np.flatnonzero(np.append(True, one[1:] != one[:-1]))
    sizes = np.diff(np.append(starts, len(one)))
    return [
        (words[one[s]], n, int(counts[two[s]]), words[two[s]])
        for s, n in zip(starts.tolist(), sizes.tolist())
    ]


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form): how many near words a word has, and the most
    frequent of them. Words without any are left out."""
    front, back = F.length("head"), F.length("tail")
    middle = F.substring(F.col("word"), front + 1, F.length("word") - front - back)
    lists = (
        small_groups(words)
        .select(*KEY, middle.alias("middle"), "n")
        .repartition(*KEY)
        .sortWithinPartitions(*KEY, "middle")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        held: list[tuple] = []
        for key, group in groupby(rows, key=lambda r: r[:3]):
            entries = [r[3:] for r in group]
            if len(entries) > 1:
                held += near_words(entries, *key)
            if len(held) >= 4_096:
                yield packed(held)
                held = []
        yield packed(held)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 4
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(arrays, ["word", "n_near", "form_n", "form"])

    found = lists.mapInArrow(run, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), best)
        .select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain, found by steps of doubling
    length. A chain is short, as counts rise fivefold along it."""
    steps = forms.select("word", F.col("form").alias("root"))
    while True:
        steps = written(steps, "steps")  # both sides of the join are plain reads
        further = steps.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        joined = steps.join(further, F.col("root") == F.col("via"), "left")
        if joined.filter("beyond is not null").isEmpty():
            return steps
        steps = joined.select("word", F.coalesce("beyond", "root").alias("root"))


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root), a row for each word."""
    words = written(vocabulary(docs, doc_id, text), "words")
    near = words.join(neighbours(words), "word", "left")
    often = F.col("form_n") >= RATIO * F.col("n")
    known = written(
        near.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(often, F.col("form")).alias("form"),
            F.when(often, F.col("form_n")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(known.filter("form is not null"))
    return known.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
