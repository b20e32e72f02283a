"""Quality rules by distribution divergence.

A document's histogram over character classes, and that over the common words of
its language, are compared with those of all documents of the language by the
Jensen-Shannon distance (the square root of the divergence in bits, 0 to 1). A
document far from its language's reference is rejected. Short documents, and those
of a language with little text, are far by chance: the distance of words still kept
widens by what sampling adds to it, and the classes of a language are joined by those
of ``PRIOR_CHARS`` characters of all languages. So neither comparison begins or ends
at a size of the table. A text is compared with its reference less its own counts.

The references are counts over all distinct texts of a language, so that a text is
no more usual for having copies: each task sums what it reads, the sums are added per
language, and the words beyond the ``COMMON`` most frequent of a language stand for
one, "any other". The tasks get back that many words per language: those of the
languages with most text, up to a bound, in a broadcast, the others in a join. Hashes
tell which texts may have copies; only those travel, once from each task.

Defined results for odd inputs:

- null text: no words; it fails the least length and is rejected, as is an empty one.
- null language: a language of its own. The only text of a language is compared with
  the classes of the other languages, and kept by them if there are none.
- repeated rows each get their row; their text counts once in its language's reference.
- ties among common words go to the smaller word (by bytes).
- empty table: no rows. Extra columns are kept by ``keep_good`` and never read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.workspace import written
from .tables import BROADCAST_BYTES, local_table

# Counted rules.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
REPEAT_WINDOW = 3
SYMBOLS = "#*$%&|<>"
# Divergence: farthest still kept of long texts, and the least length judged by classes.
FARTHEST_CLASSES = 0.31
FARTHEST_WORDS = 0.44
LEAST_CHARS = 200
# Share of the divergence expected of two samples that a text is allowed on top.
NOISE = 0.5
# Characters of all languages that count in a language's classes.
PRIOR_CHARS = 20_000
# Words of a language that its reference names.
COMMON = 100
# Documents that Python handles at once.
SLICE = 512
# Words a task counts before it hands its sums on.
HELD_WORDS = 200_000
# Places of the table of repeated hashes, a bit each; those in a row of it, as Spark has it.
PLACES, ROW_PLACES = 1 << 25, 1 << 15

CLASSES = ["lower", "upper", "digit", "blank", "line", "stop", "symbol", "control", "other"]


def class_table() -> np.ndarray:
    """The class of each byte. Of a character beyond ASCII its first byte is
    "other" and the bytes that go on are left out."""
    kinds = np.full(256, CLASSES.index("symbol"))
    kinds[[*range(32), 127]] = CLASSES.index("control")
    for name, chars in (
        ("lower", range(ord("a"), ord("z") + 1)),
        ("upper", range(ord("A"), ord("Z") + 1)),
        ("digit", range(ord("0"), ord("9") + 1)),
        ("blank", b" \t"),
        ("line", b"\n\r"),
        ("stop", b".,;:!?'\"()-"),
        ("other", range(0xC0, 0x100)),
    ):
        kinds[list(chars)] = CLASSES.index(name)
    kinds[0x80:0xC0] = len(CLASSES)
    return kinds


BYTE_CLASS = class_table()


def class_counts(raw: bytes) -> np.ndarray:
    """Characters per class."""
    kinds = BYTE_CLASS[np.frombuffer(raw, np.uint8)]
    return np.bincount(kinds, minlength=len(CLASSES) + 1)[: len(CLASSES)]


def common_form(word: bytes) -> bytes:
    """A word as it is looked up: lower case, without sentence marks around it."""
    return word.lower().strip(b".,;:!?'\"()-")


def js_distance(counts: np.ndarray, reference: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms that aren't empty."""
    p, q = counts / counts.sum(), reference / reference.sum()
    middle = (p + q) / 2

    def bits(x):
        used = x > 0
        return float((x[used] * np.log2(x[used] / middle[used])).sum())

    return max(0.0, (bits(p) + bits(q)) / 2) ** 0.5


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window of words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids = np.fromiter((number[w] for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    keys = ids[:n]
    for i in range(1, window):
        keys = keys * len(number) + ids[i : i + n]
        if i + 1 < window or len(number) ** 2 >= 1 << 31:
            keys = np.unique(keys, return_inverse=True)[1]
    _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[back] > 1)
    covered = np.zeros(len(words), bool)
    for i in range(window):
        covered[starts + i] = True
    return int(covered.sum())


def counted_rules(text: str) -> dict[str, int | bool]:
    """The counts of a text, and whether they alone reject it."""
    raw = text.encode()
    words = raw.split()
    seen: set[str] = set()
    dup_lines = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            if line in seen:
                dup_lines += 1
            seen.add(line)
    repeat = repeated_words(words)
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(text.count(c) for c in " \t\n\v\f\r"),
        "n_symbols": sum(text.count(c) for c in SYMBOLS),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat,
        "base_failed": len(words) < LEAST_WORDS
        or 100 * repeat > MOST_REPEATED_PERCENT * len(words),
    }


class Reference:
    """Histograms of one language; ``pooled`` are the class counts of all languages."""

    def __init__(self, classes: list[int], words: dict[bytes, int], total: int, pooled: np.ndarray):
        self.classes = np.array(classes, float)
        self.place = {word: i for i, word in enumerate(words)}
        self.words = np.array([*words.values(), total - sum(words.values())], float)
        self.pooled = pooled

    def distances(self, raw: bytes) -> tuple[float | None, float | None, float]:
        """Of a text's classes and common words from those of the other texts, None
        where the text is too short or there are none; farthest words still kept."""
        classes, words = class_counts(raw), raw.split()
        of_classes, of_words, farthest = None, None, FARTHEST_WORDS
        pooled = np.maximum(self.pooled - classes, 0)
        if classes.sum() >= LEAST_CHARS and pooled.sum():
            others = np.maximum(self.classes - classes, 0)
            of_classes = js_distance(classes, others + PRIOR_CHARS * pooled / pooled.sum())
        counts = np.zeros(len(self.words))
        for word, n in Counter(words).items():
            counts[self.place.get(common_form(word), len(self.place))] += n
        others = np.maximum(self.words - counts, 0)
        if len(words) >= LEAST_WORDS and others.sum():
            of_words = js_distance(counts, others)
            # Two samples of one distribution over k values diverge by (k - 1)(1/n + 1/m) / 8 nats.
            chance = COMMON / (8 * np.log(2)) * (1 / len(words) + 1 / others.sum())
            farthest = (FARTHEST_WORDS**2 + NOISE * chance) ** 0.5
        return of_classes, of_words, farthest


def distinct_texts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(text, lang) of the documents, each pair once. One whose hash shares no place
    with a repeated hash is the only one of its kind and stays where it is read; the
    others are compared whole."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    hashed = rows.select(F.xxhash64("lang", "text").alias("hash")).groupBy("hash").count()
    # Spark numbers the rows of such a table and the places in all of them from 1.
    place = F.pmod("hash", F.lit(PLACES)) + 1
    filled = hashed.filter("count > 1").groupBy(F.bitmap_bucket_number(place).alias("row"))
    table = np.zeros((PLACES // ROW_PLACES, ROW_PLACES // 8), np.uint8)
    for r in filled.agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect():
        table[r["row"] - 1] = np.frombuffer(r["bits"], np.uint8)
    # The rows of the table, at most 4 MB in all, meet the documents as a broadcast.
    bits = [(i, row.view("<i8").tolist()) for i, row in enumerate(table) if row.any()]
    if not bits:
        return rows
    filled = local_table(docs.sparkSession, bits, "_row long, _bits array<bigint>")
    at = F.pmod(F.xxhash64("lang", "text"), F.lit(PLACES))
    placed = rows.withColumn("_at", at).withColumn("_row", F.expr(f"_at div {ROW_PLACES}"))
    bit = F.expr(f"getbit(get(_bits, cast(_at % {ROW_PLACES} div 64 as int)), cast(_at % 64 as int)) = 1")
    marked = placed.join(F.broadcast(filled), "_row", "left").select(
        "text", "lang", F.coalesce(bit, F.lit(False)).alias("_shared")
    )
    alone = marked.filter("not _shared").drop("_shared")
    return alone.unionByName(marked.filter("_shared").drop("_shared").distinct())


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def language_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, kind, name, n) over all documents: characters per class, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sums: defaultdict[tuple, int] = defaultdict(int)
            for words, language in zip(*(c.to_pylist() for c in batch.columns)):
                raw = (words or "").encode()
                for name, n in zip(CLASSES, class_counts(raw).tolist()):
                    sums[language, "class", name.encode()] += n
                for word, n in Counter(raw.split()).items():
                    sums[language, "word", common_form(word)] += n
                if len(sums) >= HELD_WORDS:
                    yield packed(sums)
                    sums.clear()
            yield packed(sums)

    def packed(sums: dict[tuple, int]) -> pa.RecordBatch:
        columns = list(zip(*((*key, n) for key, n in sums.items()))) or [[]] * 4
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64()]
        arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(arrays, ["lang", "kind", "name", "n"])

    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    found = rows.mapInArrow(run, "lang string, kind string, name binary, n long")
    return found.groupBy("lang", "kind", "name").agg(F.sum("n").alias("n"))


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per language: its class counts, its common words and how many words
    it has in all."""
    counts = written(language_counts(docs, text, lang), "language-counts")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "name")
    top = (
        counts.filter("kind = 'word' and length(name) > 0")
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= COMMON)
        .groupBy(F.col("lang").alias("_lang"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "name", "n"))).alias("words"))
    )
    totals = counts.groupBy("lang").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "word", F.col("n"))), F.lit(0)).alias("total"),
        *[
            F.sum(F.when((F.col("kind") == "class") & (F.col("name") == name.encode()), F.col("n")))
            .alias(name)
            for name in CLASSES
        ],
    )
    return totals.join(top, totals["lang"].eqNullSafe(top["_lang"]), "left").drop("_lang")


def text_references(
    docs: DataFrame, text: str, lang: str
) -> tuple[dict[str | None, Reference], DataFrame, np.ndarray]:
    """The references of the languages with most text, as many as the bound of a
    broadcast allows; a table of all the others; the class counts of all. Each distinct
    text counts once."""
    found = language_references(distinct_texts(docs, text, lang), "text", "lang")
    table = written(found, "language-references")
    sums = table.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in CLASSES]).head()
    pooled = np.array(sums, float)
    most = BROADCAST_BYTES // (64 * COMMON + 256)
    first = table.orderBy(F.desc("total"), "lang").limit(most + 1).collect()
    known = {row["lang"]: reference_of(row.asDict(), pooled) for row in first[:most]}
    rest = table.limit(0)
    if len(first) > most:  # what comes after the last of the first
        last, name = first[most]["total"], first[most]["lang"]
        tied = F.coalesce(F.col("lang") >= F.lit(name), F.lit(name is None))
        rest = table.filter((F.col("total") < last) | ((F.col("total") == last) & tied))
    return known, rest, pooled


def reference_of(row: dict, pooled: np.ndarray) -> Reference:
    words = {bytes(w["name"]): w["n"] for w in row["words"] or []}
    return Reference([row[c] or 0 for c in CLASSES], words, row["total"], pooled)


def verdict(text: str, reference: Reference | None) -> dict:
    """All columns of a document: counts, distances, kept."""
    rules = counted_rules(text)
    near = reference.distances(text.encode()) if reference else (None, None, 0.0)
    far = (near[0] or 0.0) > FARTHEST_CLASSES or (near[1] or 0.0) > near[2]
    return rules | {
        "class_distance": near[0],
        "word_distance": near[1],
        "kept": not rules["base_failed"] and not far,
    }


def with_verdicts(
    docs: DataFrame,
    text: str,
    lang: str,
    make: Callable[[pa.RecordBatch, list[dict]], pa.RecordBatch],
    schema: T.StructType,
) -> DataFrame:
    """What ``make`` makes of some documents and their verdicts. Columns go by their
    places, so their names may be any."""
    known, rest, pooled = text_references(docs, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast((known, pooled))
    at, of = docs.columns.index(text), len(docs.columns)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pooled = shared.value
        for batch in slices(batches):
            languages = batch.column(of).to_pylist()
            if batch.num_columns > of + 1:
                rows = batch.column(of + 1).to_pylist()
                references = [None if r is None else reference_of(r, pooled) for r in rows]
            else:
                references = [known.get(language) for language in languages]
            pairs = zip(batch.column(at).to_pylist(), references)
            yield make(batch, [verdict(words or "", reference) for words, reference in pairs])

    names = [f"c{i}" for i in range(of)]
    rows = docs.withColumn("_language", F.col(lang).cast("string")).toDF(*names, "language")
    if rest.isEmpty():
        return rows.mapInArrow(judged, schema)
    other = rest.select(F.col("lang").alias("language"), F.struct(*rest.columns).alias("reference"))
    # A language here has fewer words than each of the known ones: no row of the join is hot.
    there = rows["language"].eqNullSafe(other["language"])
    rare = rows.join(other, there).select(*names, rows["language"], "reference")
    usual = rows.join(other, there, "left_anti")
    return usual.mapInArrow(judged, schema).unionByName(rare.mapInArrow(judged, schema))


COLUMNS = T.StructType(
    [
        *[
            T.StructField(c, T.LongType())
            for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        ],
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("class_distance", T.DoubleType()),
        T.StructField("word_distance", T.DoubleType()),
        T.StructField("kept", T.BooleanType()),
    ]
)
ARROW = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64()} | {
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(),
    "class_distance": pa.float64(),
    "word_distance": pa.float64(),
    "kept": pa.bool_(),
}


def quality(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """One row per document: doc_id and its counts, distances and verdict. The
    documents are read four times; of their texts only copies are shuffled."""

    def make(batch: pa.RecordBatch, found: list[dict]) -> pa.RecordBatch:
        arrays = [pa.array([r[c] for r in found], kind) for c, kind in ARROW.items()]
        return pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *ARROW])

    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    schema = T.StructType([rows.schema["doc_id"], *COLUMNS.fields])
    return with_verdicts(rows, "text", "lang", make, schema)


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that are kept, with all their columns as they were."""
    width = len(docs.columns)
    names = [f"c{i}" for i in range(width)]

    def make(batch: pa.RecordBatch, found: list[dict]) -> pa.RecordBatch:
        own = pa.RecordBatch.from_arrays(batch.columns[:width], names)
        return own.filter(pa.array([r["kept"] for r in found], pa.bool_()))

    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema)])
    return with_verdicts(docs, text, lang, make, schema).toDF(*docs.columns)
