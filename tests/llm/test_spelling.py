import random
import re
import zlib
from collections import Counter, defaultdict

import odd
import pytest

from conftest import SMALL
from tilepulse.llm import queries, spelling


def plain_vocabulary(docs):
    words = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}


def plain_variants(words):
    """By the texts that a word becomes when it loses a character, or has one replaced."""
    shorter, replaced = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            shorter[w[:i] + w[i + 1 :]].add(w)
            replaced[w[:i], w[i + 1 :]].add(w)
    near = defaultdict(set)
    for w in words:
        near[w] |= shorter[w]
        for longer in shorter[w]:
            near[longer].add(w)
        for i in range(len(w)):
            near[w] |= replaced[w[:i], w[i + 1 :]] - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return out


COLUMNS = ["word", "n", "n_near", "form", "form_n", "root"]


def test_query_12(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = plain_variants(plain_vocabulary(docs))
    rows = queries.QUERIES["op12_spelling"](spark, SMALL).select(*COLUMNS).collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    assert sum(f is not None for _, _, _, f, _, _ in want) > 5


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("seed", range(30))
def test_pairs_of_a_list(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "abcdé"
    texts = sorted({"".join(rng.choices(letters, k=rng.randint(0, 7))) for _ in range(60)})
    one, two = spelling.one_edit(texts)
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if distance(a, b) == 1}
    assert len(one) == len(want) and set(zip(one.tolist(), two.tolist())) == want


@pytest.mark.parametrize("most", [3, 12, 8192])
def test_large_groups_are_filed_again(spark, monkeypatch, most):
    """Words of which nearly all share both halves with many others."""
    rng = random.Random(most)
    words = {"".join(rng.choices("ab", k=rng.randint(6, 9))): rng.randint(5, 500) for _ in range(400)}
    words |= {"prefixprefix" + "".join(rng.choices("xyz", k=rng.randint(0, 4))): rng.randint(5, 90) for _ in range(80)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    if most == 3:  # larger than what an alphabet of three allows with two characters left
        most = 13
    groups = spelling.small_groups(df, most)
    assert groups.groupBy(*spelling.KEY).count().filter(f"count > {most}").isEmpty()
    monkeypatch.setattr(spelling, "small_groups", lambda words: groups)
    got = {r.word: (r.n_near, r.form, r.form_n) for r in spelling.neighbours(df).collect()}
    near = {w: [v for v in words if distance(v, w) == 1] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    assert got == {w: (len(near[w]), b, words[b]) for w, b in best.items()}


def test_roots_of_long_chains(spark):
    chain = [(f"word{i}", f"word{i + 1}") for i in range(37)] + [("a", "word20"), ("b", "c")]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert got == {**{f"word{i}": "word37" for i in range(37)}, "a": "word37", "b": "c"}
    assert spelling.roots(spark.createDataFrame([], "word string, form string")).count() == 0


def test_odd_documents(spark):
    rng = random.Random(3)
    words = ["Kleinigkeit", "kleinigkeit", "Übermut", "übermut", "cafés×zwei", "longer" * 3_000]
    texts = [" ".join(rng.choices(words, k=40)) + "1İstanbul_" for _ in range(12)]
    rows = [(i, t, *[None] * (3 + odd.EXTRAS)) for i, t in enumerate(texts)]
    docs = odd.documents(spark).union(spark.createDataFrame(rows, odd.SCHEMA))
    want = plain_variants(plain_vocabulary([(r.doc_id, r.text) for r in docs.collect()]))
    rows = spelling.variants(docs).select(*COLUMNS).collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    assert {"Übermut", "übermut", "kleinigkeit"} < {r.word for r in rows}  # only A-Z is lowered
    assert spelling.variants(odd.none(spark)).count() == 0
