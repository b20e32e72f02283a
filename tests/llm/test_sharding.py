import hashlib
from collections import defaultdict

import odd
import pytest

from tilepulse.llm import sharding


def hash_of(doc_id, text):
    inner = hashlib.md5((text or "").encode()).hexdigest()
    key = f"{'' if doc_id is None else doc_id}:{inner}"
    return int(hashlib.md5(key.encode()).hexdigest()[:15], 16)


def plain_shards(rows, limit):
    """(id, bytes) -> (depth, prefix), by splitting what does not fit."""
    items = [(hash_of(r[0], r[1]), len((r[1] or "").encode())) for r in rows]
    out, todo = {}, [(0, 0, items)]
    while todo:
        depth, prefix, held = todo.pop()
        if sum(n for _, n in held) <= limit or len({h for h, _ in held}) < 2:
            out |= {h: (depth, prefix) for h, _ in held}
            continue
        for bit in (0, 1):
            part = [(h, n) for h, n in held if h >> (59 - depth) & 1 == bit]
            todo.append((depth + 1, prefix * 2 + bit, part))
    return out


@pytest.mark.parametrize("limit", [100, 1_000, 20_000, 10**9])
def test_shards_equal_splitting_one_by_one(spark, limit):
    rows = odd.rows()
    found = sharding.shard_plan(odd.documents(spark), limit).collect()
    want = plain_shards(rows, limit)
    assert len(found) == len(rows)
    expected = sorted(want[hash_of(r[0], r[1])] for r in rows)
    assert sorted((r.depth, r.shard) for r in found) == expected
    held = defaultdict(list)
    for r in found:
        held[r.depth, r.shard, r.page].append(r)
    for part in held.values():
        total = sum(r.n_bytes for r in part)
        assert {r.shard_bytes for r in part} == {total} and {r.shard_docs for r in part} == {len(part)}
        assert total <= limit or len(part) == 1


def test_equal_rows_get_pages(spark):
    rows = [(1, "abcd")] * 50 + [(2, "x" * 30), (3, "y" * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sharding.shard_plan(docs, 20).collect()
    pages = defaultdict(int)
    for r in found:
        if r.doc_id == 1:
            pages[r.page] += 1
            assert r.shard_bytes == 4 * r.shard_docs <= 20
    assert sorted(pages) == list(range(10)) and set(pages.values()) == {5}


def test_many_rounds(spark):
    """A directory that starts too small is deepened, only where it must be."""
    docs = spark.createDataFrame([(i, "z" * (i % 90)) for i in range(600)], "doc_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for limit in (90, 700):
        found = sharding.shard_plan(docs, limit).collect()
        want = plain_shards(rows, limit)
        texts = dict(rows)
        assert all((r.depth, r.shard) == want[hash_of(r.doc_id, texts[r.doc_id])] for r in found)


def test_written_shards(spark, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(odd.documents(spark), path, 20_000)
    found = spark.read.parquet(path)
    assert found.count() == len(odd.rows()) and set(odd.documents(spark).columns) <= set(found.columns)
    assert sharding.shard_plan(odd.none(spark)).count() == 0


def test_no_python_runs(spark):
    plan = sharding.shard_plan(odd.documents(spark), 1000)._jdf.queryExecution().executedPlan()
    assert "Python" not in plan.toString() and "Arrow" not in plan.toString()
