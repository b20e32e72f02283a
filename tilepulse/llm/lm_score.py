"""Scoring texts by a causal self-attention model on subword ids.

A text is its words and one end. Words are cut into subwords by a public byte-level
rank file; the model gives the probability of each subword from those before it, as
that of the subword's class times that of the subword in its class. The latter, with the
subword before it, and the probability of a class right after a given subword are counted
over all training texts. The attention part, trained in numpy, adds to the logits of the classes what the context
beyond the last subword tells: embeddings (drawn from the same counts), positions,
causal attention, an output layer.

Windows of ``WINDOW`` subwords overlap; each subword is scored once, in the first
window that holds it, so all but the first ones see at least ``WINDOW - STRIDE``
before them. Training takes every subword of every training text once, in windows that do
not overlap: a round takes one in ``SHARE`` of a text's windows, the next round the next
ones. Each task goes on from the weights of the round before, and the weights of all tasks
are averaged by the subwords that they saw.

What grows with the corpus stays in tables: word counts, pairs of subwords, encoded texts,
rare words and rare pairs per text (joined by word and by pair, as only frequent ones fit a
broadcast). The driver and the tasks hold what the vocabulary bounds: class counts,
embeddings and some thousand weights.

Defined results for odd inputs: a null text is an empty one (one token, its end); a
null id counts as ""; very long texts are windows like others; repeated rows each get
their row and each count in training; without training texts all counts are 0 and
every subword is as likely as any; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workspace import written
from . import bpe
from .tables import BROADCAST_BYTES
from .whitening import State, added, summed

FOLDS, HELD_OUT = 7, 2
WINDOW, STRIDE = 32, 26
WIDTH = 16
# Classes: so many of single subwords, the most frequent ones and the end; so many in all.
SINGLE, CLASSES = 48, 64
# So many parts of the windows are trained in turn, in so many rounds.
SHARE, ROUNDS = 2, 2
RATE, DECAYS, TRAIN_BATCH = 0.003, (0.9, 0.99), 32
# Windows scored at once, documents whose ids are counted at once, words encoded as one text.
BATCH, SLICE, WORDS = 64, 512, 50_000
# Rows of a product of matrices that are multiplied at once.
ROWS = 512
# Documents whose windows are trained one after the other, or scored.
FEW = 64
# Documents counted or encoded at once: the more, the less often the same word is.
ENCODED_SLICE = 1_536
# Words from this length on are encoded in pieces.
LONG_WORD = 4_096
# What each pair of subwords gives to those not seen.
DISCOUNT = 0.75
# Pairs of subwords, and words of several slices, that a task counts at once.
HELD_PAIRS, HELD_WORDS = 4_000_000, 1_000_000
# Greatest logit, and what keeps an empty sum from dividing.
MOST_LOGIT, TINY = np.float32(20.0), np.float32(1e-30)


def is_held_out(doc_id: str) -> Column:
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS == HELD_OUT


def word_lists(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of some texts, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    sizes = np.diff(lists.offsets.to_numpy())
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    text_of = np.repeat(np.arange(len(sizes)), sizes)[real.to_numpy(zero_copy_only=False)]
    return words.filter(real).dictionary_encode(), np.bincount(text_of, minlength=len(sizes))


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


# Words: counts of all training tokens.


def token_counts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(word, n) of the training texts; the end is the word ""."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], 0
        for batch in slices(batches, ENCODED_SLICE):
            words, _ = word_lists(batch.column(0))
            names = pa.concat_arrays([words.dictionary, pa.array([""])])
            often = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            counts = pa.array(np.append(often, batch.num_rows).astype(np.int64))
            held.append(pa.RecordBatch.from_arrays([names, counts], ["word", "n"]))
            number += len(names)
            if number >= HELD_WORDS:
                yield from merged(held)
                held, number = [], 0
        if held:
            yield from merged(held)

    def merged(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        groups = pa.Table.from_batches(held).group_by("word", use_threads=False)
        return groups.aggregate([("n", "sum")]).rename_columns(["word", "n"]).to_batches()

    train = docs.filter(~is_held_out(doc_id)).select(text)
    return train.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, size: Column) -> tuple[pa.Table, DataFrame | None]:
    """The rows of greatest ``n``, as many as the bound of a broadcast allows: all from some
    count on. A few hundred sums tell which. The others, if there are any, stay a table."""
    level = F.floor(F.log2("n") * 8).alias("level")
    levels = counts.groupBy(level).agg(F.sum(size).alias("size"), F.min("n").alias("n"))
    least, total, others = 1 << 62, 0, None
    for row in levels.orderBy(F.desc("level")).collect():
        total += row["size"]
        if total > BROADCAST_BYTES:
            others = counts.filter(F.col("n") < least)
            break
        least = row["n"]
    return counts.filter(F.col("n") >= least).toArrow(), others


class Subwords:
    """Words to subword ids. Most are encoded many at a time, as one text: no match of the
    pattern reaches across a space behind a character which is not white space (see ``bpe``),
    and only the first subword of a word starts with its space."""

    def __init__(self, path: str, pattern: str):
        self.encoding = bpe.encoding(path, pattern)
        self.core = self.encoding._core_bpe  # half the time for a short text
        ranks = self.encoding._mergeable_ranks
        self.leads = np.zeros(max(ranks.values()) + 1, bool)
        self.leads[[i for token, i in ranks.items() if token.startswith(b" ")]] = True

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after the other, and how many each has."""
        apart = [i for i, w in enumerate(words) if len(w) >= LONG_WORD or w[-1].isspace()]
        found, sizes, at = [np.empty(0, "<u2")], [np.empty(0, np.int64)], 0
        for stop in [*apart, len(words)]:
            for start in range(at, stop, WORDS):
                part = words[start : min(start + WORDS, stop)]
                ids = np.array(self.core.encode_ordinary(" " + " ".join(part)), "<u2")
                found.append(ids)
                sizes.append(np.diff(np.append(np.flatnonzero(self.leads[ids]), len(ids))))
            if stop < len(words):
                found.append(self.alone(words[stop]))
                sizes.append(np.array([len(found[-1])]))
            at = stop + 1
        return np.concatenate(found), np.concatenate(sizes)

    def alone(self, word: str) -> np.ndarray:
        if len(word) < LONG_WORD:
            return np.array(self.core.encode_ordinary(" " + word), "<u2")
        ids = [i for p in bpe.pieces(" " + word) for i in bpe.encode_piece(self.encoding, p)]
        return np.array(ids, "<u2")


class Frequent(NamedTuple):
    """The most frequent words, their counts and their subwords, encoded once for all texts."""

    words: pa.Array
    number: np.ndarray
    ids: np.ndarray
    sizes: np.ndarray


def frequent_words(counts: DataFrame, path: str, pattern: str) -> Frequent:
    found, _ = most_frequent(counts.filter("word <> ''"), F.octet_length("word") + 16)
    words = found.column("word").combine_chunks().cast(pa.string())
    own = Subwords(path, pattern).ids(words.to_pylist())
    return Frequent(words, found.column("n").to_numpy(), *own)


def strings(words: pa.Array) -> list[str]:
    """As ``to_pylist`` in a fraction of its time."""
    return words.to_numpy(zero_copy_only=False).tolist()


def hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(hash, strings(words)), np.int64, len(words))


class Places:
    """Finds some words among others, whose hashes are sorted once."""

    def __init__(self, words: pa.Array):
        parts = [hashes(words.slice(start, WORDS)) for start in range(0, len(words), WORDS)]
        found = np.concatenate([np.empty(0, np.int64), *parts])
        self.words, self.order = words, np.argsort(found)
        self.hashes = found[self.order]

    def of(self, names: pa.Array) -> np.ndarray:
        """The place of each name, or the number of words. Of words with the same hash one is
        found; the others count as not there, which only means that they are looked up later."""
        none, found = len(self.words), hashes(names)
        by_hash = np.argsort(found)  # neighbours are found near each other
        at = np.empty(len(found), np.int64)
        at[by_hash] = np.append(self.order, none)[np.searchsorted(self.hashes, found[by_hash])]
        same = pc.fill_null(pc.equal(self.words.take(pa.array(at, mask=at == none)), names), False)
        return np.where(same.to_numpy(zero_copy_only=False), at, none)


def concatenated(ids: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words, of these sizes, in an order, and how many each has."""
    starts = np.cumsum(sizes) - sizes
    lengths = sizes[order]
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[order] - ends + lengths, lengths)
    return ids[at], lengths


ENCODED = (
    "row long, {id}, held_out boolean, n_tokens long, known long, logs double, ids binary, "
    "words array<string>, often array<long>"
)


def encoded(
    docs: DataFrame, doc_id: str, text: str, counts: DataFrame, path: str, pattern: str
) -> DataFrame:
    """A row per text: its subword ids (with the end), its tokens among the frequent words
    and the sum of log10(count + 1) of those, its other words and how often it has each.
    Written, so that a row keeps its number."""
    from pyspark import TaskContext

    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(frequent_words(counts, path, pattern))
    end = len(bpe.encoding(path, pattern)._mergeable_ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = held.value
        most = len(frequent.number)
        logs = np.append(np.log10(frequent.number + 1.0), 0.0)
        subwords, places = Subwords(path, pattern), Places(frequent.words)
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, ENCODED_SLICE):
            count = batch.num_rows
            tokens, sizes = word_lists(batch.column("text"))
            names, place = tokens.dictionary, tokens.indices.to_numpy().astype(np.int64)
            found = places.of(names)
            text_of = np.repeat(np.arange(count), sizes)
            others = np.flatnonzero(found == most)
            own = subwords.ids(strings(names.take(pa.array(others))))
            spelt = found.copy()
            spelt[others] += np.arange(len(others))
            both = (np.concatenate(parts) for parts in zip((frequent.ids, frequent.sizes), own))
            ids, lengths = concatenated(*both, spelt[place])
            ids_of = np.bincount(text_of, lengths, count).astype(np.int64)
            stops = np.cumsum(ids_of)
            ids = np.insert(ids, stops, end)
            stops += np.arange(1, count + 1)
            raw = ids.astype("<u2").tobytes()
            bounds = [0, *(2 * stops).tolist()]
            known = found[place] < most
            pairs, often = np.unique((text_of * len(names) + place)[~known], return_counts=True)
            ends = np.append(0, np.cumsum(np.bincount(pairs // max(len(names), 1), minlength=count)))
            ends = pa.array(ends.astype(np.int32))
            columns = [
                pa.array(row + np.arange(count)),
                batch.column("doc_id"),
                batch.column("held_out"),
                pa.array(sizes.astype(np.int64) + 1),
                pa.array(np.bincount(text_of, known, count).astype(np.int64)),
                pa.array(np.bincount(text_of, logs[found[place]], count)),
                pa.array([raw[a:b] for a, b in zip(bounds, bounds[1:])], pa.binary()),
                pa.ListArray.from_arrays(ends, names.take(pa.array(pairs % max(len(names), 1)))),
                pa.ListArray.from_arrays(ends, pa.array(often.astype(np.int64))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names_of)
            row += count

    rows = docs.select(
        F.col(doc_id).alias("doc_id"), is_held_out(doc_id).alias("held_out"), F.col(text).alias("text")
    )
    schema = ENCODED.format(id=f"doc_id {dict(rows.dtypes)['doc_id']}")
    names_of = [f.split()[0] for f in schema.split(", ")]
    return written(rows.mapInArrow(run, schema), "encoded")


# Subwords: classes, tables and embeddings, counted over all training texts.


def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of some texts one after the other, and the length of each."""
    for batch in slices(batches):
        texts = batch.column("ids")
        lengths = pc.binary_length(texts).to_numpy().astype(np.int64) // 2
        yield np.frombuffer(b"".join(texts.to_pylist()), "<u2").astype(np.int64), lengths


def inputs_of(ids: np.ndarray, lengths: np.ndarray, begin: int) -> np.ndarray:
    """What precedes each subword: the one before, or the begin of the text."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(lengths) - lengths] = begin
    return before


def pair_counts(texts: DataFrame, begin: int) -> DataFrame:
    """(at, n): how often a subword follows another, ``before * 65536 + subword``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], 0
        for ids, lengths in sequences(batches):
            held.append(((inputs_of(ids, lengths, begin) << 16) + ids).astype(np.uint32))
            number += len(ids)
            if number >= HELD_PAIRS:
                yield packed(held)
                held, number = [], 0
        if held:
            yield packed(held)

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        pairs, often = np.unique(np.concatenate(held), return_counts=True)
        columns = [pa.array(column.astype(np.int64)) for column in (pairs, often)]
        return pa.RecordBatch.from_arrays(columns, ["at", "n"])

    found = texts.select("ids").mapInArrow(run, "at long, n long")
    return written(found.groupBy("at").agg(F.sum("n").alias("n")), "pairs")


def counted(pairs: DataFrame, size: int, places) -> np.ndarray:
    """Sums of the counts of pairs at each of ``places(before, ids)``, of numbers below
    ``size``: in the tasks, then by number; as many come back as the vocabulary allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in batches:
            pair, often = (batch.column(c).to_numpy() for c in ("at", "n"))
            for at in places(pair >> 16, pair & 0xFFFF):
                np.add.at(sums, at, often)
        used = np.flatnonzero(sums)
        for start in range(0, len(used), 1 << 16):
            part = used[start : start + (1 << 16)]
            arrays = [pa.array(part), pa.array(sums[part])]
            yield pa.RecordBatch.from_arrays(arrays, ["at", "n"])

    found = pairs.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    table = found.toArrow()
    out = np.zeros(size, np.int64)
    out[table.column("at").to_numpy()] = table.column("n").to_numpy()
    return out


class Tables(NamedTuple):
    """What the counts give, by subword: its class, its log probability in the class, the
    log probabilities of the next class, an embedding. The last row stands for the begin.
    ``pairs`` are frequent pairs by ``slots``, each slot's from ``starts`` on, and one that is
    none; ``follow`` is the log probability of the second in its class after the first; for
    pairs never seen, ``rest`` by first and class comes on top of ``inside``. Rare pairs count
    as such here, and what they gain by having been seen is joined, see ``gains``."""

    of: np.ndarray
    inside: np.ndarray
    after: np.ndarray
    embedding: np.ndarray
    pairs: np.ndarray
    starts: np.ndarray
    follow: np.ndarray
    rest: np.ndarray

    def in_class(self, ids: np.ndarray, before: np.ndarray, missed: list | None = None) -> np.ndarray:
        """Log probability of each subword in its class; where there is no frequent pair, its
        place and the pair are added to ``missed``."""
        key = ((before << 16) + ids).astype(np.uint32)
        slot = slots(key, len(self.starts) - 1)
        at = self.starts[slot]
        left = np.flatnonzero(self.pairs[at] != key)
        while len(left):
            left = left[at[left] + 1 < self.starts[slot[left] + 1]]
            at[left] += 1
            left = left[self.pairs[at[left]] != key[left]]
        logs = self.follow[at].astype(float)
        rare = np.flatnonzero(self.pairs[at] != key)
        if missed is not None:
            missed.append((rare, key[rare]))
        ids, before = ids[rare], before[rare]
        logs[rare] = self.inside[ids] + self.rest[before, self.of[ids]]
        return logs


def slots(pairs: np.ndarray, number: int) -> np.ndarray:
    """Which of a number of slots, a power of two, some pairs belong to."""
    return (pairs * np.uint32(0x9E3779B1)) >> np.uint32(33 - number.bit_length())


def pair_logs(
    pairs: np.ndarray,
    often: np.ndarray,
    of: np.ndarray,
    inside: np.ndarray,
    cells: tuple[np.ndarray, np.ndarray] | None = None,
) -> tuple:
    """``pairs``, ``starts``, ``follow`` and ``rest`` of the tables: counts of pairs less
    ``DISCOUNT`` each; what that leaves goes to all subwords of the class by their own counts.
    ``cells`` are the number and the counts of all pairs by first and class, if these are not all."""
    number = 2 << len(pairs).bit_length()
    slot = slots(pairs.astype(np.uint32), number)
    order = np.lexsort((pairs, slot))
    pairs, often = pairs[order], often[order].astype(float)
    starts = np.searchsorted(slot[order], np.arange(number + 1)).astype(np.int32)
    cell = (pairs >> 16) * CLASSES + of[pairs & 0xFFFF]
    size = len(of) * CLASSES
    if cells is None:
        cells = np.bincount(cell, minlength=size), np.bincount(cell, often, size)
    left, total = DISCOUNT * cells[0], cells[1]
    follow = np.log((often - DISCOUNT + left[cell] * np.exp(inside[pairs & 0xFFFF])) / total[cell])
    share = np.where(total > 0, left / np.maximum(total, 1), 1.0)
    rest = np.log(share).astype(np.float32).reshape(-1, CLASSES)
    keys = np.append(pairs, 0xFFFFFFFF).astype(np.uint32)
    return keys, starts, np.append(follow, 0.0).astype(np.float32), rest


def gains(others: DataFrame, of: np.ndarray, inside: np.ndarray, number: np.ndarray) -> DataFrame:
    """(at, gain): what the log probability of pairs beyond a broadcast exceeds that of pairs
    never seen by, given the number of all pairs by first and class."""
    left = (DISCOUNT * number).astype(np.float32)
    held = others.sparkSession.sparkContext.broadcast((of.astype(np.uint8), inside, left))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, inside, left = held.value
        for batch in batches:
            pair, often = (batch.column(c).to_numpy() for c in ("at", "n"))
            ids = pair & 0xFFFF
            shared = left[(pair >> 16) * CLASSES + of[ids]] * np.exp(inside[ids])
            columns = [batch.column("at"), pa.array(np.log1p((often - DISCOUNT) / shared))]
            yield pa.RecordBatch.from_arrays(columns, ["at", "gain"])

    return written(others.select("at", "n").mapInArrow(run, "at long, gain double"), "gains")


def by_rank(counts: np.ndarray, single: int, end: int) -> np.ndarray:
    """The most frequent subwords and the end are classes of their own, the others one."""
    of = np.full(len(counts), single)
    first = [end, *(i for i in np.argsort(-counts, kind="stable") if i != end)][:single]
    of[first] = np.arange(len(first))
    return of


def grouped(features: np.ndarray, weights: np.ndarray, groups: int, rounds: int = 12) -> np.ndarray:
    """Weighted k-means with fixed starts: the heaviest rows."""
    centres = features[np.argsort(-weights, kind="stable")[:groups]].copy()
    for _ in range(rounds):
        near = (features @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        for g in range(len(centres)):
            own = weights * (near == g)
            if own.sum():
                centres[g] = own @ features / own.sum()
    return near


def tables(texts: DataFrame, end: int) -> tuple[Tables, DataFrame | None]:
    """What the counts of all pairs give, and the ``gains`` of those beyond a broadcast."""
    begin, size = end + 1, end + 2
    # All that is counted here follows from the pairs, so the texts are read once for it.
    following = pair_counts(texts, begin)
    total = counted(following, size, lambda before, ids: [ids])
    wide = CLASSES
    coarse = by_rank(total, wide - 1, end)

    def both_sides(before: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
        follows = before * (2 * wide) + coarse[ids]
        leads = ids * (2 * wide) + wide + np.where(before == begin, 0, coarse[before])
        return [follows, leads]

    sides = counted(following, size * 2 * wide, both_sides).reshape(size, 2, wide).astype(float)
    usual = sides.sum(0) + 1.0
    usual /= usual.sum(1, keepdims=True)
    sides += 5 * usual  # rare subwords are near the average
    features = np.sqrt(sides / sides.sum(2, keepdims=True)).reshape(size, -1)
    weights = total + 0.01
    centred = features - weights @ features / weights.sum()
    _, axes = np.linalg.eigh(centred.T @ (centred * weights[:, None]))
    embedding = centred @ axes[:, ::-1][:, :WIDTH]
    embedding /= np.sqrt((weights @ embedding**2) / weights.sum()) + 1e-6

    of = by_rank(total, SINGLE, end)
    others = np.flatnonzero(of == SINGLE)
    of[others] = SINGLE + grouped(features[others], np.sqrt(weights[others]), CLASSES - SINGLE)

    def next_class(before: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
        return [before * CLASSES + of[ids]]

    follows = counted(following, size * CLASSES, next_class)
    after = follows.reshape(size, CLASSES).astype(float)
    overall = after.sum(0) + 1
    after += 3 * overall / overall.sum()
    after /= after.sum(1, keepdims=True)
    smooth = total + 1.0
    smooth[begin] = 0  # it never follows anything
    inside = np.log(np.maximum(smooth, 1e-300) / np.bincount(of, smooth, CLASSES)[of])
    frequent, others = most_frequent(following, F.lit(8))
    at, often = frequent.column("at").to_numpy(), frequent.column("n").to_numpy()
    cells = gained = None
    if others is not None:
        once = following.withColumn("n", F.lit(1).cast("long"))
        cells = counted(once, size * CLASSES, next_class), follows
        gained = gains(others, of, inside, cells[0])
    found = Tables(
        of.astype(np.uint8),
        inside,
        np.log(after).astype(np.float32),
        embedding.astype(np.float32),
        *pair_logs(at, often, of, inside, cells),
    )
    return found, gained


# The attention model.

SHAPES = {"place": (WINDOW, WIDTH), "qkv": (WIDTH, 3 * WIDTH), "out": (WIDTH, CLASSES), "bias": (CLASSES,)}
# Greatest logits of the places that a place attends to.
CAUSAL = np.where(np.tril(np.ones((WINDOW, WINDOW), bool)), MOST_LOGIT, np.float32(-np.inf))
# Where rows of as many classes start, for so many places.
ROW_STARTS = np.arange(max(BATCH, TRAIN_BATCH) * WINDOW) * CLASSES


def first_weights() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(1)
    scale = {"place": 0.1, "qkv": 0.25, "out": 0.0, "bias": 0.0}
    return {k: (rng.normal(size=s) * scale[k]).astype(np.float32) for k, s in SHAPES.items()}


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in SHAPES]).astype(float)


def unflat(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[k], at = values[at : at + n].reshape(shape).astype(np.float32, copy=False), at + n
    return out


def numbered_windows(lengths: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of texts one after the other: its text, and its place in that."""
    number = np.maximum(0, -(-(lengths - WINDOW) // stride)) + 1
    text = np.repeat(np.arange(len(lengths)), number)
    return text, np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)


def windows(
    lengths: np.ndarray, stride: int = STRIDE, chosen: np.ndarray | slice = slice(None)
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts one after the other: a row of places per window, or per chosen one, which of
    them lie in the window's text, and which are scored there."""
    text, nth = (a[chosen] for a in numbered_windows(lengths, stride))
    start = nth * stride
    inner = start[:, None] + np.arange(WINDOW)
    there = inner < lengths[text][:, None]
    first = np.where(nth == 0, 0, WINDOW - stride)
    scored = there & (np.arange(WINDOW) >= first[:, None])
    base = np.cumsum(lengths) - lengths
    last = (base + lengths - 1)[text][:, None]
    return np.minimum(base[text][:, None] + inner, last), there, scored


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b``, so many rows at a time as BLAS multiplies without copying them first."""
    out = np.empty((len(a), b.shape[1]), np.float32)
    for start in range(0, len(a), ROWS):
        np.matmul(a[start : start + ROWS], b, out=out[start : start + ROWS])
    return out


def crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a.T @ b``, likewise."""
    return sum(a[start : start + ROWS].T @ b[start : start + ROWS] for start in range(0, len(a), ROWS))


def parted(qkv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return qkv[:, :WIDTH], qkv[:, WIDTH : 2 * WIDTH], qkv[:, 2 * WIDTH :]


def forward(tables: Tables, weights: dict[str, np.ndarray], x: np.ndarray, first: int = 0) -> tuple:
    """Embeddings, the same transposed, queries, attention with its sums, what it takes of the
    embeddings, and the output for windows of inputs; queries and what follows from them from
    the ``first`` place on. The products of queries and keys and the values are taken of the
    embeddings themselves: weights of keys go into those of queries, those of values come last."""
    e = np.take(tables.embedding, x, axis=0)
    e += weights["place"]
    turned = np.ascontiguousarray(e.transpose(0, 2, 1))
    wq, wk, wv = parted(weights["qkv"])
    q = (e.reshape(-1, WIDTH) @ (wq @ wk.T)).reshape(e.shape)[:, first:]
    a = np.matmul(q, turned)
    np.minimum(a, CAUSAL[first:], out=a)
    np.exp(a, out=a)
    total = (a.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32)).reshape(*a.shape[:2], 1) + TINY
    taken = np.matmul(a, e)
    h = (taken.reshape(-1, WIDTH) @ wv).reshape(taken.shape)
    h /= total
    h += e[:, first:]
    return e, turned, q, a, total, taken, h


def class_logits(tables: Tables, weights, h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of all classes after ``x``, given the output ``h``.
    The bias is left out: as it is the same everywhere, sums over classes are weighted by it."""
    g = times(h, weights["out"])
    if g.max(initial=0) > MOST_LOGIT:
        np.minimum(g, MOST_LOGIT, out=g)
    g += np.take(tables.after, x, axis=0)
    return g


def class_logs(tables: Tables, weights, h: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple:
    """Log probability of each class ``y`` after ``x`` given the output ``h``, and of all."""
    g = class_logits(tables, weights, h, x)
    own = np.take(g, ROW_STARTS[: len(g)] + y) + np.take(weights["bias"], y)
    np.exp(g, out=g)
    total = g @ np.exp(weights["bias"])
    return own - np.log(total), g, total


def gradients(tables: Tables, weights, x, y, used) -> dict[str, np.ndarray]:
    """Of the mean log loss of the classes ``y`` at the places ``used``."""
    e, turned, q, a, sums, taken, h = forward(tables, weights, x)
    wq, wk, wv = parted(weights["qkv"])
    hs, flat_y, flat_used = h.reshape(-1, WIDTH), y.ravel(), used.ravel().astype(np.float32)
    flat_used /= flat_used.sum()
    g = class_logits(tables, weights, hs, x.ravel())
    np.exp(g, out=g)
    # Rows are divided by their sum, and classes weighted, where they are fewest numbers.
    scale = np.exp(weights["bias"])
    total = g @ scale
    g.reshape(-1)[ROW_STARTS[: len(g)] + flat_y] -= total / np.take(scale, flat_y)
    share = flat_used / total
    back = times(g, np.ascontiguousarray((weights["out"] * scale).T))
    back *= share[:, None]
    # Attention weights are exponentials over their sum: it divides what comes back to them.
    shared = back / sums.reshape(-1, 1)
    into = shared @ wv.T
    # What attention weights of one place share cancels: its sum follows from its output.
    ds = np.matmul(into.reshape(e.shape), turned)
    own = (shared * (h - e).reshape(-1, WIDTH)) @ np.ones(WIDTH, np.float32)
    ds -= own.reshape(*sums.shape)
    ds *= a
    asked = np.matmul(ds, e)
    pairs = e.reshape(-1, WIDTH).T @ asked.reshape(-1, WIDTH)
    heard = q.reshape(-1, WIDTH).T @ ds.reshape(-1, WINDOW) + into.T @ a.reshape(-1, WINDOW)
    return {
        "place": back.reshape(e.shape).sum(0) + asked.sum(0) @ (wk @ wq.T) + heard.T,
        "qkv": np.concatenate([pairs @ wk, pairs.T @ wq, taken.reshape(-1, WIDTH).T @ shared], axis=1),
        "out": (crossed(g, hs * share[:, None]) * scale[:, None]).T,
        "bias": share @ g * scale,
    }


class Adam:
    """Moves weights that are parts of one vector."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.vector, self.step = flat(weights).astype(np.float32), 0
        self.weights = unflat(self.vector)
        self.first, self.second = np.zeros_like(self.vector), np.zeros_like(self.vector)

    def move(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        a, b = DECAYS
        g = np.concatenate([grads[k].ravel() for k in SHAPES])
        self.first += (1 - a) * (g - self.first)
        np.multiply(g, g, out=g)
        self.second += (1 - b) * (g - self.second)
        size = np.sqrt(self.second / (1 - b**self.step)) + 1e-8
        self.vector -= RATE / (1 - a**self.step) * self.first / size


def due(rows: np.ndarray, lengths: np.ndarray, nth: int, share: int) -> np.ndarray:
    """Which windows of texts with these numbers are trained in the nth round: every window
    in one of ``share`` rounds that follow each other."""
    text, place = numbered_windows(lengths, WINDOW)
    return (rows[text] + place) % share == nth % share


def trained(texts: DataFrame, found: Tables, end: int, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Weights after some rounds over the training texts (row, ids)."""
    weights, share = first_weights(), min(SHARE, rounds)
    # Workers hold what training reads of the tables, a third of them.
    found = found._replace(inside=None, pairs=None, starts=None, follow=None, rest=None)
    for nth in range(rounds):
        held = texts.sparkSession.sparkContext.broadcast((found, weights))

        def make(batches: Iterator[pa.RecordBatch]) -> State | None:
            tables, start = held.value
            adam, seen = Adam(start), 0
            waiting, number = [], 0
            for batch in slices(batches, FEW):
                rows = batch.column("row").to_numpy()
                for ids, lengths in sequences(iter([batch])):
                    before = inputs_of(ids, lengths, end + 1)
                    at, there, _ = windows(lengths, WINDOW, due(rows, lengths, nth, share))
                    waiting.append((before[at], tables.of[ids[at]], there))
                    number += len(at)
                if number >= TRAIN_BATCH:
                    seen += steps(tables, adam, waiting)
                    waiting, number = [], 0
            if number:
                seen += steps(tables, adam, waiting)
            return (np.array([seen]), flat(adam.weights) * seen) if seen else None

        def steps(tables: Tables, adam: Adam, waiting: list) -> int:
            x, y, used = (np.concatenate(parts) for parts in zip(*waiting))
            for start in range(0, len(x), TRAIN_BATCH):
                part = slice(start, start + TRAIN_BATCH)
                adam.move(gradients(tables, adam.weights, x[part], y[part], used[part]))
            return int(used.sum())

        state = summed(texts.select("row", "ids"), make, added)
        if state is not None:
            weights = unflat(state[1] / state[0][0])
    return weights


def text_logs(
    tables: Tables, weights, ids: np.ndarray, lengths: np.ndarray, begin: int, missed: list | None = None
) -> np.ndarray:
    """Log10 probability of each text, every subword scored in one window; for ``missed`` see
    ``Tables.in_class``."""
    before, of = inputs_of(ids, lengths, begin), tables.of[ids]
    at, _, scored = windows(lengths)
    logs = np.zeros(len(ids))
    begins = scored[:, 0]  # a text's first window is scored from its first place on
    for those, first in (begins, 0), (~begins, WINDOW - STRIDE):
        chosen, use = at[those], scored[those, first:]
        for start in range(0, len(chosen), BATCH):
            part = slice(start, start + BATCH)
            x, place = before[chosen[part]], chosen[part, first:].ravel()
            h = forward(tables, weights, x, first)[-1].reshape(-1, WIDTH)
            found = class_logs(tables, weights, h, x[:, first:].ravel(), of[place])[0]
            logs[place[use[part].ravel()]] = found[use[part].ravel()]
    logs += tables.in_class(ids, before, missed)
    return np.add.reduceat(logs, np.cumsum(lengths) - lengths) / np.log(10) if len(lengths) else logs


def rare_pairs(missed: list, lengths: np.ndarray) -> list[pa.Array]:
    """For texts one after the other: the pairs of each that are not frequent, and how often it
    has each."""
    place, pair = missed[0]
    text = np.searchsorted(np.cumsum(lengths), place, side="right")
    found, often = np.unique((text << 32) + pair, return_counts=True)
    ends = np.searchsorted(found, np.arange(len(lengths) + 1) << 32)
    ends = pa.array(ends.astype(np.int32))
    columns = [pa.array(found & 0xFFFFFFFF), pa.array(often.astype(np.int64))]
    return [pa.ListArray.from_arrays(ends, c) for c in columns]


def scores(
    docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: see the contract of the query for the columns."""
    end = len(bpe.encoding(path, pattern)._mergeable_ranks)
    counts = written(token_counts(docs, doc_id, text), "token-counts")
    sums = counts.agg(F.sum("n"), F.count("*"), F.max(F.when(F.col("word") == "", F.col("n")))).head()
    total, distinct, ends = (int(v or 0) for v in sums)
    texts = encoded(docs, doc_id, text, counts, path, pattern)

    def zipped(name: str, lists: str) -> Column:
        return F.inline(F.arrays_zip(F.col(lists).alias(name), F.col("often").alias("n")))

    rare = texts.select("row", zipped("word", "words"))
    rare = rare.join(counts.select("word", F.col("n").alias("c")), "word")
    rare = rare.groupBy("row").agg(
        F.sum("n").alias("rare"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_logs")
    )
    train = texts.filter("not held_out")
    found, gained = tables(train, end)
    held = docs.sparkSession.sparkContext.broadcast((found, trained(train, found, end)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, weights = held.value
        for batch in slices(batches, FEW):
            for ids, lengths in sequences(iter([batch])):
                missed = None if all_held else []
                own = [pa.array(text_logs(tables, weights, ids, lengths, end + 1, missed))]
                if not all_held:
                    own += rare_pairs(missed, lengths)
                columns = [batch.column(c) for c in kept.names]
                yield pa.RecordBatch.from_arrays([*columns, *own], schema.names)

    rows = texts.select("row", "doc_id", "held_out", "n_tokens", "known", "logs", "ids")
    kept = rows.drop("ids").schema
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType())])
    all_held = gained is None
    if all_held:
        scored = rows.mapInArrow(run, schema)
    else:
        for name in ("pairs", "often"):
            schema = schema.add(name, T.ArrayType(T.LongType()))
        scored = written(rows.mapInArrow(run, schema), "scored")  # else it would run twice
        gain = scored.select("row", zipped("at", "pairs")).join(gained, "at").groupBy("row")
        gain = gain.agg((F.sum(F.col("n") * F.col("gain")) / float(np.log(10))).alias("gain"))
        scored = scored.join(gain, "row", "left")
        scored = scored.withColumn("score", F.col("score") + F.coalesce("gain", F.lit(0.0)))
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) + float(np.log10(ends + 1))
    return scored.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare", F.lit(0)) + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"),
        "score",
    )
