import random
from collections import Counter, defaultdict

import numpy as np
import odd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from tilepulse.llm import quality, queries

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def plain_counts(text):
    words = text.translate({c: " " for c in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    marked = {i + j for i, w in enumerate(windows) if w in often for j in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    return [
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(marked),
        len(words) < 50 or 100 * len(marked) > 50 * len(words),
    ]


def test_counts_equal_plain_ones():
    rng = random.Random(3)
    stock = ["a", "b", "ab", "\n", "\n", " ", "\t", "\v", "\x1c", "\x85", "é", "#", "|x", "\r\n", " "]
    for _ in range(4000):
        text = "".join(rng.choices(stock, k=rng.randint(0, 60)))
        assert list(quality.counted_rules(text).values()) == plain_counts(text), text


def test_distance_is_that_of_the_definition():
    p, q = np.array([1.0, 1, 0]), np.array([0.0, 1, 1])
    assert quality.js_distance(p, p) == 0 and abs(quality.js_distance(p, q) ** 2 - 0.5) < 1e-12
    assert abs(quality.js_distance(np.array([3.0, 0]), np.array([0.0, 9])) - 1) < 1e-12


def plain_references(docs):
    classes, words = defaultdict(lambda: np.zeros(len(quality.CLASSES))), defaultdict(Counter)
    for text, lang in dict.fromkeys(docs):  # copies count once
        raw = (text or "").encode()
        classes[lang] += quality.class_counts(raw)
        words[lang].update(map(quality.common_form, raw.split()))
    out, pooled = {}, sum(classes.values())
    for lang, counts in words.items():
        ranked = sorted((-n, w) for w, n in counts.items() if w)[: quality.COMMON]
        out[lang] = quality.Reference(
            classes[lang], {w: -n for n, w in ranked}, sum(counts.values()), pooled
        )
    return out


@pytest.mark.parametrize("bound", [quality.BROADCAST_BYTES, 2 * (64 * quality.COMMON + 256)])
def test_query_9(spark, monkeypatch, bound):
    """All references in a broadcast, or those of two languages, the others in a join."""
    monkeypatch.setattr(quality, "BROADCAST_BYTES", bound)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()
    known = plain_references([(r.text, r.lang) for r in docs])
    texts = {r.doc_id: (r.text, r.lang) for r in docs}
    rows = queries.QUERIES["op9_quality"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text, lang = texts[r.doc_id]
        assert [r[c] for c in COLUMNS] == plain_counts(text)
        assert r.kept == quality.verdict(text, known[lang])["kept"]


def judged(sf, only=lambda doc_id: True):
    """(doc_id, label, kept) of the labelled documents that pass the counted rules."""
    docs = pq.read_table(f"/root/testdata/{sf}/documents.parquet").to_pandas()
    labels = pq.read_table(f"/root/testdata/{sf}/labels.parquet").to_pandas()
    docs = docs[[only(i) for i in docs.doc_id]]
    known = plain_references(zip(docs.text, docs.lang))
    both = docs.merge(labels, on="doc_id")
    rows = zip(both.doc_id, both.text, both.lang, both.quality)
    found = [(i, q, quality.verdict(t, known[x])) for i, t, x, q in rows]
    return [(i, q, v["kept"]) for i, q, v in found if not v["base_failed"]]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_labelled_documents(sf):
    rows = judged(sf)
    assert all(kept for _, q, kept in rows if q == 1)  # clean documents stay
    assert not any(kept for _, q, kept in rows if q == 0)


def test_a_document_is_judged_alike_in_tables_of_two_sizes():
    large = {i: kept for i, _, kept in judged("sf0.01")}
    small = {i: kept for i, _, kept in judged("sf0.01", lambda i: i % 8 == 3)}
    assert len(small) > 30 and False in small.values()
    assert all(large[i] == kept for i, kept in small.items())


def test_the_only_text_of_a_language():
    rng = random.Random(5)
    usual = [(odd.prose(rng, 400), "en") for _ in range(20)]
    clean, junk = odd.prose(rng, 400), " ".join(f"#{i * 7919 % 9973:04d}" for i in range(400))
    known = plain_references([*usual, (clean, "da"), (junk, "nb")])
    assert quality.verdict(clean, known["da"])["kept"]
    assert not quality.verdict(junk, known["nb"])["kept"]
    assert quality.verdict(clean, plain_references([(clean, "da")])["da"])["kept"]


@pytest.mark.parametrize("doc_id", [None, "clean"])
def test_copies_do_not_become_the_reference(spark, doc_id):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    french = docs.filter("lang = 'fr'").join(labels, "doc_id").orderBy("doc_id").collect()
    junk = " ".join(f"#{i * 7919 % 9973:04d}" for i in range(400))
    copied = next(r.text for r in french if r.quality == 1 and len(r.text) > 1500) if doc_id else junk
    # A third of all rows; of both tables one text is the same, so both have the same texts.
    third = spark.range(500).select((F.col("id") + 10**9).alias("doc_id"), F.lit(copied).alias("text"), F.lit("fr").alias("lang"))
    alone = {r.doc_id: r for r in quality.quality(docs.union(third.limit(1))).collect()}
    among = quality.quality(docs.union(third)).collect()
    assert len(among) == 1500
    assert all(r == alone[r.doc_id] for r in among if r.doc_id < 10**9)
    good = {r.doc_id for r in french if r.quality == 1}
    assert all(r.kept for r in among if r.doc_id in good and not r.base_failed)
    assert quality.keep_good(docs.union(third)).count() == sum(r.kept for r in among)


def test_distinct_texts_are_those_of_a_plain_distinct(spark):
    docs = odd.documents(spark)
    got = Counter(map(tuple, quality.distinct_texts(docs).collect()))
    assert got == Counter({(r[1], r[2]) for r in odd.rows()})


def test_odd_documents(spark):
    docs = odd.documents(spark)
    found = quality.quality(docs).collect()
    assert len(found) == len(odd.rows())
    counts = {(r.doc_id, r.n_words): r for r in found}
    assert counts[4, 0].base_failed and not counts[4, 0].kept and counts[6, 0].base_failed
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in found) > 0
    assert quality.quality(odd.none(spark)).count() == 0
    assert quality.keep_good(odd.none(spark)).count() == 0


def test_more_languages_than_a_broadcast_holds(spark, monkeypatch):
    rng = random.Random(4)
    junk = " ".join(f"#{i * 7919 % 9973:04d}" for i in range(200))
    rows = [(i, odd.prose(rng, 80), f"tag{i % 200}") for i in range(600)]
    rows += [(600, junk, "tag7"), (601, odd.prose(rng, 80), None), (602, odd.prose(rng, 9_000), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    known = plain_references([(t, x) for _, t, x in rows])
    want = {i: quality.verdict(t, known[x]) for i, t, x in rows}
    monkeypatch.setattr(quality, "BROADCAST_BYTES", 3 * (64 * quality.COMMON + 256))
    assert {r.doc_id: r.kept for r in quality.quality(docs).collect()} == {i: v["kept"] for i, v in want.items()}
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {i for i, v in want.items() if v["kept"]}
    assert not want[600]["kept"] and want[601]["kept"]


def test_one_python_worker_a_task(spark):
    docs = odd.documents(spark)
    plan = quality.language_counts(quality.distinct_texts(docs))._jdf.queryExecution().executedPlan()
    assert "ArrowEvalPython" not in plan.toString() and "MapInArrow" in plan.toString()
