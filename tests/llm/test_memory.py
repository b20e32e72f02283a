"""What Python workers hold of a batch."""

import tracemalloc

import pyarrow as pa
import pytest

from conftest import SMALL
from pyspark.sql import functions as F
from tilepulse.llm import near_dedup, quality, tables

TEXTS, CHARS = 4_000, 8_000


@pytest.fixture(scope="module")
def batch():
    texts = [(f"{i:07d} " * (CHARS // 8)).encode() for i in range(TEXTS)]
    ids = pa.array(range(TEXTS), pa.int64())
    return pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], ["id", "content", "raw"])


def held(rows):
    """Most bytes of Python and NumPy while the rows, which are counted, are made."""
    tracemalloc.start()
    try:
        count = sum(out.num_rows for out in rows)
        return count, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("sequences", [False, True])
def test_near_duplicates_hold_few_texts_of_a_batch(batch, sequences):
    count, most = held(near_dedup.described(iter([batch]), sequences))
    assert count == TEXTS and most < TEXTS * CHARS / 4


def test_rows_are_made_from_few_texts_of_a_batch(batch):
    schema = pa.schema([("id", pa.int64()), ("size", pa.int64())])
    rows = tables.per_row([batch], schema, lambda ident, content, raw: (ident, len(raw)))
    count, most = held(rows)
    assert count == TEXTS and most < TEXTS * CHARS / 4


def test_remembered_words_are_bounded(monkeypatch):
    """Hashes are the same whether or not a word was forgotten meanwhile."""
    words = [b"w%d" % (i * i % 977) for i in range(5_000)]
    want = near_dedup.Words().hashes(words)
    monkeypatch.setattr(near_dedup, "MEMORY", 16)
    memory = near_dedup.Words()
    assert (memory.hashes(words) == want).all() and len(memory.known) <= 16


def plan(df):
    return df._jdf.queryExecution().toString()


def test_tables_of_the_driver_need_no_other_workers(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    found = tables.numbered(docs.select("doc_id"), [F.col("doc_id")], "place")
    assert "ExistingRDD" not in plan(found)
    places = [r.place for r in found.orderBy("doc_id").collect()]
    assert places == list(range(docs.count()))
    twice = docs.unionByName(docs)
    texts = quality.distinct_texts(twice)
    assert "ExistingRDD" not in plan(texts)
    assert texts.count() == docs.select("text", "lang").distinct().count()


def test_a_table_of_the_driver_keeps_nulls_and_kinds(spark):
    rows = [(1, [1 << 62, -(1 << 63)]), (2, None), (None, [])]
    df = tables.local_table(spark, rows, "a long, b array<bigint>")
    assert df.dtypes == [("a", "bigint"), ("b", "array<bigint>")]
    assert [tuple(r) for r in df.collect()] == rows
    assert tables.local_table(spark, [], "a long").count() == 0
