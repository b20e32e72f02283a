import random
from collections import defaultdict

import numpy as np
import odd
import pytest

from conftest import SMALL
from tilepulse.llm import components, near_dedup, queries


def labelled(text):
    words = text.lower().encode().split()
    k = min(5, len(words))
    seen, out = defaultdict(int), []
    for i in range(len(words) - k + 1 if words else 0):
        mer = tuple(words[i : i + k])
        out.append((mer, seen[mer]))
        seen[mer] += 1
    return out


def common(a, b):
    """Longest common subsequence, by the whole table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def plain_classes(docs):
    """Classes of (id, text) by comparing all pairs that share a k-mer."""
    mers = [labelled(t or "") for _, t in docs]
    where, parent = defaultdict(list), list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, m in enumerate(mers):
        for x in m:
            where[x].append(i)
    pairs = {(i, j) for owners in where.values() for i in owners for j in owners if i < j}
    for i, j in pairs:
        both = len(mers[i]) + len(mers[j])
        shared = len(set(mers[i]) & set(mers[j]))
        if shared / (both - shared) >= 0.8:
            n = common(mers[i], mers[j])
            if n / (both - n) >= 0.8:
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[root(i)].append(i)
    return groups


def test_query_1(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in queries.QUERIES["op1_near_dedup"](spark, SMALL).collect()}
    for group in plain_classes([(r.doc_id, r.text) for r in docs]).values():
        ids = [docs[i].doc_id for i in group]
        for i in ids:
            assert (found[i].class_id, found[i].class_size) == (min(ids), len(ids))


def test_alignment_equals_the_whole_table():
    rng = random.Random(5)
    for _ in range(300):
        a = [rng.randrange(30) for _ in range(rng.randint(1, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            j = rng.randrange(len(b) + 1)
            b[j : j + rng.randint(0, 2)] = [rng.randrange(30) for _ in range(rng.randint(0, 2))]
        if not b:
            continue
        _, aligned = near_dedup.similarity(np.array(a, np.uint64), np.array(b, np.uint64))
        n = common(a, b)
        exact = n / (len(a) + len(b) - n)
        assert aligned <= exact + 1e-12  # labels may forbid what plain k-mers allow
        if len(set(a)) == len(a) and len(set(b)) == len(b) and exact >= 0.8:
            assert abs(aligned - exact) < 1e-12


def test_order_matters():
    words = [f"w{i}" for i in range(200)]
    turned = words[100:] + words[:100]
    memory = near_dedup.Words()
    a, b = [near_dedup.kmers(memory.hashes([w.encode() for w in t])) for t in (words, turned)]
    jaccard, aligned = near_dedup.similarity(a, b)
    assert jaccard > 0.9 and aligned < 0.4


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)]
    edges += [(500, 500 + i) for i in range(1, 60)] + [(700 + i, 701 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components.components(df).collect()}
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in parent if x not in alone}


def test_a_large_group_of_copies_of_copies(spark):
    """A chain: each text is near the one before, the first and last are not."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(60):
        docs.append((i, " ".join(words)))
        words[rng.randrange(300)] = f"x{i}"
    docs += [(1000 + i, odd.prose(rng, 120)) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
    for group in plain_classes(docs).values():
        ids = [docs[i][0] for i in group]
        assert {found[i] for i in ids} == {min(ids)}


@pytest.mark.parametrize("block", [2_048, 7])
def test_many_loose_copies_of_one_text(spark, monkeypatch, block):
    """Copies with one to six changes: some near each other, some near none."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
    groups = plain_classes(docs)
    assert 1 < len(groups) < 120
    for group in groups.values():
        assert {found[docs[i][0]] for i in group} == {min(docs[i][0] for i in group)}


def test_odd_documents(spark):
    docs = odd.documents(spark)
    rows = near_dedup.classes(docs).collect()
    assert len(rows) == len(odd.rows())
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[1].class_id, by_id[2].class_id, by_id[3].class_id) == (1, 1, 1)
    assert by_id[1].class_size == 4
    assert all((by_id[i].class_id, by_id[i].class_size) == (i, 1) for i in (4, 5, 6, 7, 8, 20))
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    gone = [(2,), (3,), (3,)]
    want = sorted((r[0] is None, r[0] or 0) for r in odd.rows() if (r[0],) not in gone)
    assert ids == want
    assert near_dedup.classes(odd.none(spark)).count() == 0
    assert near_dedup.keep_first(odd.none(spark)).count() == 0


@pytest.mark.parametrize("copies", [2, 5])
def test_repeated_rows_leave_one(spark, copies):
    rng = random.Random(2)
    text = odd.prose(rng, 80)
    docs = [(1, text, i) for i in range(copies)] + [(2, odd.prose(rng, 80), 0)]
    kept = near_dedup.keep_first(spark.createDataFrame(docs, "doc_id long, text string, part int"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]
