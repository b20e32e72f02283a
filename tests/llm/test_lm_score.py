import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import odd
import public_tokenizers
import pytest

from conftest import SMALL
from tilepulse.llm import lm_score, queries

LARGE = "/root/testdata/sf0.1"
PATH, PATTERN = public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN


def plain_base(docs):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) by the definition."""

    def tokens(text):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall("[^\x20\x09-\x0D]+", lowered) + [None]

    def held_out(doc_id):
        return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2

    counts = Counter(t for i, text in docs if not held_out(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text in docs:
        own = tokens(text)
        base = math.fsum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)
        out.append((i, held_out(i), len(own), sum(counts[t] > 0 for t in own), n, base))
    return out


def same(rows, docs):
    def key(r):
        return (r[0] is None, r[0] or 0, *r[1:5], round(r[5], 6))

    got = sorted((key(tuple(r)[:6]) for r in rows))
    want = sorted(key(r) for r in plain_base(docs))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:6] == w[:6] and abs(g[6] - w[6]) < 1e-5


def test_query_13(spark):
    docs = spark.read.parquet(f"{LARGE}/documents.parquet").select("doc_id", "text").collect()
    rows = queries.QUERIES["op13_lm_score"](spark, LARGE).collect()
    same(rows, docs)
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    held = [r for r in rows if r.held_out]  # better than single words on texts it has not seen
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BROADCAST_BYTES", 2_000)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    same(lm_score.scores(docs, PATH, PATTERN).collect(), docs.collect())


def test_rare_pairs_are_joined(spark, monkeypatch):
    """Pairs beyond a broadcast count as those within it, in training texts and others."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdeé7", k=rng.randint(1, 7))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, range(300, 0, -1), k=rng.randint(0, 120))) for _ in range(150)]
    rows = [(i % 140, t) for i, t in enumerate([*texts, *texts[:5], None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    docs = lm_score.written(docs, "docs")

    def scored():
        return sorted((r.doc_id, r.n_tokens, r.base_score, r.score) for r in lm_score.scores(docs, PATH, PATTERN).collect())

    want = scored()
    for most in (4_000, 0):  # some pairs fit, none does
        monkeypatch.setattr(lm_score, "BROADCAST_BYTES", most)
        got = scored()
        assert len(got) == len(want)
        for g, w in zip(got, want):
            assert g[:2] == w[:2] and abs(g[3] - w[3]) < 1e-5 * max(1, abs(w[3]))


def tables(seed=0, size=120):
    rng = np.random.default_rng(seed)
    of = np.concatenate([np.arange(lm_score.CLASSES), rng.integers(0, lm_score.CLASSES, size - lm_score.CLASSES)])
    smooth = rng.uniform(1, 9, size)
    after = rng.dirichlet(np.ones(lm_score.CLASSES), size)
    inside = np.log(smooth / np.bincount(of, smooth, lm_score.CLASSES)[of])
    pairs = np.unique((rng.integers(0, size, 300) << 16) + rng.integers(0, size - 1, 300))
    logs = lm_score.pair_logs(pairs, rng.integers(1, 50, len(pairs)), of, inside)
    embedding = rng.normal(size=(size, lm_score.WIDTH)).astype(np.float32)
    return lm_score.Tables(of, inside, np.log(after).astype(np.float32), embedding, *logs)


def some_weights(seed=1):
    rng = np.random.default_rng(seed)
    return {k: (0.12 * rng.normal(size=s)).astype(np.float32) for k, s in lm_score.SHAPES.items()}


def plain_log(known, w, before, y):
    """Of the class y after the inputs ``before``, one step at a time in 64 bits."""
    e = known.embedding[before].astype(float) + w["place"][: len(before)]
    q, k, v = np.split(e @ w["qkv"].astype(float), 3, axis=1)
    s = np.exp(k @ q[-1])
    h = e[-1] + s / s.sum() @ v
    g = h @ w["out"] + w["bias"] + known.after[before[-1]]
    return g[y] - np.log(np.exp(g).sum())


def test_each_subword_is_scored_once_from_those_before_it():
    rng = np.random.default_rng(4)
    known, w, begin = tables(), some_weights(), 119
    lengths = np.array([1, 2, 31, 32, 33, 58, 59, 200])
    ids = rng.integers(0, 118, lengths.sum())
    got = lm_score.text_logs(known, w, ids, lengths, begin)
    at = 0
    for n, found in zip(lengths, got):
        own = ids[at : at + n]
        before, total = np.append(begin, own[:-1]), 0.0
        for i in range(n):
            start = 0 if i < lm_score.WINDOW else (i - lm_score.WINDOW) // lm_score.STRIDE * lm_score.STRIDE + lm_score.STRIDE
            total += plain_log(known, w, before[start : i + 1], known.of[own[i]])
            total += known.in_class(own[i : i + 1], before[i : i + 1])[0]
        assert abs(total / math.log(10) - found) < 1e-3 * max(1, abs(found))
        at += n


def test_probabilities_of_the_next_subword_sum_to_one():
    known, w = tables(), some_weights()
    x = np.array([[119, *range(1, lm_score.WINDOW)]])
    h = lm_score.forward(known, w, x)[-1][:, -1]
    logs = [lm_score.class_logs(known, w, h, x[:, -1], np.array([c]))[0][0] for c in range(lm_score.CLASSES)]
    every, last = np.arange(120), np.full(120, x[0, -1])
    assert abs(np.exp(np.array(logs)[known.of] + known.in_class(every, last)).sum() - 1) < 1e-5


@pytest.mark.parametrize("name", lm_score.SHAPES)
def test_gradients(name):
    rng = np.random.default_rng(5)
    known, w = tables(), some_weights()
    x = rng.integers(0, 120, (3, lm_score.WINDOW))
    y = rng.integers(0, lm_score.CLASSES, x.shape)
    used = rng.random(x.shape) < 0.8

    def loss(weights):
        h = lm_score.forward(known, weights, x)[-1].reshape(-1, lm_score.WIDTH)[used.ravel()]
        return -lm_score.class_logs(known, weights, h, x.ravel()[used.ravel()], y.ravel()[used.ravel()])[0].astype(float).mean()

    grads = lm_score.gradients(known, w, x, y, used)[name]
    for _ in range(5):
        direction = rng.normal(size=w[name].shape).astype(np.float32)
        up, down = ({**w, name: w[name] + step * direction} for step in (4e-3, -4e-3))
        slope = (loss(up) - loss(down)) / 8e-3
        assert abs(slope - (grads * direction).sum()) < 2e-3 + 0.02 * abs(slope)


def test_training_learns_from_the_context(spark, monkeypatch):
    """Texts whose next class depends on the subword four before, not on the last."""
    monkeypatch.setattr(lm_score, "SHARE", 1)
    rng = np.random.default_rng(6)
    known = tables()
    flatter = known._replace(after=np.full_like(known.after, -math.log(lm_score.CLASSES)))
    texts = []
    for row in range(300):
        seed = list(rng.integers(0, lm_score.CLASSES, 4))
        for _ in range(60):
            seed.append(seed[-4])
        texts.append((row, np.array(seed, "<u2").tobytes()))
    df = spark.createDataFrame(texts, "row long, ids binary").repartition(2)
    ids = np.frombuffer(texts[0][1], "<u2").astype(np.int64)
    before = lm_score.text_logs(flatter, lm_score.first_weights(), ids, np.array([64]), 119)[0]
    after = lm_score.text_logs(flatter, lm_score.trained(df, flatter, 118, rounds=6), ids, np.array([64]), 119)[0]
    assert after > before + 5


def test_odd_documents(spark):
    docs = odd.documents(spark)
    rows = lm_score.scores(docs, PATH, PATTERN).collect()
    same(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert len({r.score for r in rows if r.n_tokens == 1}) == 1  # null, empty, white space
    assert lm_score.scores(odd.none(spark), PATH, PATTERN).count() == 0
    alone = docs.filter(lm_score.is_held_out("doc_id")).limit(2)  # nothing to learn from
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in lm_score.scores(alone, PATH, PATTERN).collect())


def test_words_are_split_as_defined():
    import pyarrow as pa

    rng = random.Random(1)
    texts = ["".join(rng.choices(["A", "bb", " ", "\n", "\t", "\v", "\f", "\r", "\x1c", "\x85", "É"], k=12)) for _ in range(500)]
    words, sizes = lm_score.word_lists(pa.array([*texts, None]))
    got, at = words.to_pylist(), 0
    for text, n in zip(texts, sizes):
        assert got[at : at + n] == re.findall("[^\x20\x09-\x0D]+", text.replace("A", "a"))
        at += n


def test_every_training_subword_is_learned_from_once(spark, monkeypatch):
    seen, summed = [], lm_score.summed

    def counting(*args):
        state = summed(*args)
        seen.append(0 if state is None else int(state[0][0]))
        return state

    monkeypatch.setattr(lm_score, "summed", counting)
    rng = np.random.default_rng(7)
    lengths = [1, 31, 32, 33, 64, 65, 500, *rng.integers(1, 200, 90).tolist()]
    texts = [(row, rng.integers(0, 118, n).astype("<u2").tobytes()) for row, n in enumerate(lengths)]
    df = spark.createDataFrame(texts, "row long, ids binary").repartition(3)
    lm_score.trained(df, tables(), 118)
    assert sum(seen) == sum(lengths)


def test_each_window_is_trained_in_one_round():
    lengths, rows = np.array([1, 32, 33, 200, 64]), np.array([5, 6, 9, 1 << 40, 3])
    at, _, scored = lm_score.windows(lengths, lm_score.WINDOW)
    for share in (1, 2, 3):
        times = np.zeros(lengths.sum(), int)
        for nth in range(share):
            chosen = lm_score.due(rows, lengths, nth, share)
            np.add.at(times, at[chosen][scored[chosen]], 1)
        assert (times == 1).all()


def test_words_encoded_together_as_alone(monkeypatch):
    monkeypatch.setattr(lm_score, "WORDS", 7)
    rng = random.Random(2)
    parts = ["a", "é", "7", "'s", "\xa0", "\x85", "\x1c", "　", "#", "́", "😀", "\x00"]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(3000)]
    words += ["x" * 5000, "\xa0" * 5000, "end"]
    subwords = lm_score.Subwords(PATH, PATTERN)
    ids, sizes = subwords.ids(words)
    alone = [list(subwords.core.encode_ordinary(" " + w)) if len(w) < 100 else subwords.alone(w).tolist() for w in words]
    assert sizes.tolist() == [len(a) for a in alone] and ids.tolist() == sum(alone, [])
    assert [len(part) for part in subwords.ids([])] == [0, 0]


def test_pairs_are_found_by_their_slots():
    rng = np.random.default_rng(8)
    size = 500
    of = np.concatenate([np.arange(lm_score.CLASSES), rng.integers(0, lm_score.CLASSES, size - lm_score.CLASSES)])
    inside = np.log(rng.uniform(0.1, 1, size))
    after, embedding = np.zeros((size, lm_score.CLASSES)), np.zeros((size, lm_score.WIDTH))
    before, ids = (rng.integers(0, size - 1, 20_000) for _ in range(2))
    for n in (0, 1, 2, 30_000):
        pairs = np.unique((rng.integers(0, size, n) << 16) + rng.integers(0, size - 1, n))
        logs = lm_score.pair_logs(pairs, rng.integers(1, 50, len(pairs)), of, inside)
        known = lm_score.Tables(of, inside, after, embedding, *logs)
        assert np.diff(known.starts).sum() == len(pairs)
        follow = dict(zip(known.pairs.tolist()[:-1], known.follow.tolist()))
        assert sorted(follow) == pairs.tolist()
        plain = [follow.get((b << 16) + i, inside[i] + known.rest[b, of[i]]) for b, i in zip(before.tolist(), ids.tolist())]
        assert np.array_equal(known.in_class(ids, before), plain)


def test_words_are_counted_over_slices(spark, monkeypatch):
    rng = random.Random(3)
    texts = [(f"{i}", " ".join(rng.choices("abcdefgh", k=9)).replace("h", f"w{i}")) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id string, text string").coalesce(1)
    want = Counter(w for i, t in texts if zlib.crc32(i.encode()) % 7 != 2 for w in [*t.split(), ""])
    for held in (1, 40, 1_000_000):
        monkeypatch.setattr(lm_score, "ENCODED_SLICE", 16)
        monkeypatch.setattr(lm_score, "HELD_WORDS", held)
        assert dict(map(tuple, lm_score.token_counts(docs, "doc_id", "text").collect())) == want


def test_frequent_words_are_encoded_once(spark, monkeypatch):
    """Each word that fits the broadcast is encoded there, not again in each slice of a task."""
    encoded, ids = [], lm_score.Subwords.ids
    monkeypatch.setattr(lm_score.Subwords, "ids", lambda self, words: encoded.extend(words) or ids(self, words))
    counts = spark.createDataFrame([("the", 5), ("subwords", 3), ("", 9), ("é", 1)], "word string, n long")
    found = lm_score.frequent_words(counts, PATH, PATTERN)
    assert sorted(encoded) == sorted(found.words.to_pylist()) == ["subwords", "the", "é"]
    core = lm_score.Subwords(PATH, PATTERN).core
    assert found.ids.tolist() == [i for w in found.words.to_pylist() for i in core.encode_ordinary(" " + w)]
    docs = spark.createDataFrame([("1", "The subwords of the É é")], "doc_id string, text string")
    row = lm_score.encoded(docs, "doc_id", "text", counts, PATH, PATTERN).head()
    want = [i for w in "the subwords of the É é".split() for i in core.encode_ordinary(" " + w)]
    assert np.frombuffer(row.ids, "<u2").tolist()[:-1] == want and row.known == 4 and sorted(row.words) == ["of", "É"]


def test_scoring_attends_from_scored_places_only(monkeypatch):
    """Windows after a text's first ask nothing of the places that the window before has scored."""
    asked, forward = [], lm_score.forward

    def counting(*args):
        found = forward(*args)
        asked.append(found[-1].shape[0] * found[-1].shape[1])
        return found

    monkeypatch.setattr(lm_score, "forward", counting)
    n = lm_score.WINDOW + 9 * lm_score.STRIDE
    ids = np.random.default_rng(9).integers(0, 118, n)
    lm_score.text_logs(tables(), some_weights(), ids, np.array([n]), 119)
    assert sum(asked) == n


def test_products_some_rows_at_a_time():
    """BLAS gets as few rows at once as it multiplies without copying them first."""
    rng = np.random.default_rng(10)
    for n in (1, lm_score.ROWS, lm_score.ROWS + 1, 3 * lm_score.ROWS):
        a, b, c = (rng.normal(size=s).astype(np.float32) for s in ((n, 16), (16, 64), (n, 64)))
        assert np.allclose(lm_score.times(a, b), a @ b, atol=1e-4)
        assert np.allclose(lm_score.crossed(a, c), a.T @ c, atol=1e-2)
    assert lm_score.ROWS * lm_score.WIDTH * lm_score.CLASSES < 1_000_000


def test_the_bias_is_not_added_place_by_place():
    """It weighs the sums over classes; probabilities are those of logits that hold it."""
    known, w = tables(), some_weights()
    other = {**w, "bias": w["bias"] + np.linspace(-2, 2, lm_score.CLASSES, dtype=np.float32)}
    rng = np.random.default_rng(11)
    h = rng.normal(size=(200, lm_score.WIDTH)).astype(np.float32)
    x, y = rng.integers(0, 120, 200), rng.integers(0, lm_score.CLASSES, 200)
    plain = lm_score.class_logits(known, other, h, x)
    assert np.array_equal(plain, lm_score.class_logits(known, w, h, x))
    full = np.exp(plain.astype(float) + other["bias"])
    want = np.log(full[np.arange(200), y] / full.sum(1))
    assert np.abs(lm_score.class_logs(known, other, h, x, y)[0] - want).max() < 1e-5


def test_frequent_words_are_hashed_once(monkeypatch):
    """However many slices look words up; a hash that two words share misleads nobody."""
    import pyarrow as pa

    monkeypatch.setattr(lm_score, "WORDS", 7)
    words = [f"w{i * i}é" for i in range(40)]
    rng, hashed, plain = random.Random(12), [], lm_score.hashes
    monkeypatch.setattr(lm_score, "hashes", lambda part: hashed.extend(part.to_pylist()) or plain(part))
    places = lm_score.Places(pa.array(words))
    assert hashed == words
    for n in (0, 1, 100):
        names = rng.choices([*words, "w", "none", "w1"], k=n)
        want = [words.index(w) if w in words else 40 for w in names]
        assert places.of(pa.array(names, pa.string())).tolist() == want
    assert lm_score.Places(pa.array([], pa.string())).of(pa.array(["a"])).tolist() == [0]
    monkeypatch.setattr(lm_score, "hashes", lambda part: np.array([len(w) % 2 for w in part.to_pylist()], np.int64))
    found = lm_score.Places(pa.array(words)).of(pa.array([*words, "none"]))
    assert set(found.tolist()) <= {*range(41)} and found[-1] == 40
    assert all(f in (i, 40) for i, f in enumerate(found[:-1].tolist())) and (found < 40).sum() == 2


def test_training_is_sent_what_it_reads(spark, monkeypatch):
    sent, kind = [], type(spark.sparkContext)
    broadcast = kind.broadcast
    monkeypatch.setattr(kind, "broadcast", lambda self, value: sent.append(value) or broadcast(self, value))
    texts = [(row, np.arange(60, dtype="<u2").tobytes()) for row in range(4)]
    lm_score.trained(spark.createDataFrame(texts, "row long, ids binary"), tables(), 118)
    held = {name for known, _ in sent for name, value in known._asdict().items() if value is not None}
    assert len(sent) == lm_score.ROUNDS and held == {"of", "after", "embedding"}
