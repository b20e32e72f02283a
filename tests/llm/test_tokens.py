import hashlib
import random
import struct

import odd
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from conftest import SMALL
from tilepulse.llm import bpe, queries, token_counts

RANKS = public_tokenizers.path(queries.RANKS)
VOCABULARY = public_tokenizers.path(queries.VOCABULARY)
PIECES = [
    "a", "B", "é", "é", " ", "\n", "  ", "　", "\x1c", "\x85", "<|endoftext|>",
    "<|ENDOFTEXT|>", "<|startoftext|>", "'s", "'", "1", "½", "Σ", "ΑΣ", "İ", "ß", "<", "|", "😀",
    "‍", "ﬁ", "한", "中", "\x00", "\t", "don't", "٣", "﻿", "the", "x!!", "3.14",
]


def texts(n, most, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, most))) for _ in range(n)]


def expected_ids(text):
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    return enc.encode_ordinary(text)


def test_pieces_encode_as_the_whole_text():
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for text in texts(3000, 30, 2):
        cut = [i for piece in bpe.pieces(text, 3) for i in bpe.encode_piece(enc, piece)]
        assert cut == enc.encode_ordinary(text) and bpe.decode(enc, cut) == text.encode()
        assert "".join(bpe.pieces(text, 3)) == text


def test_long_runs_of_white_space_are_one_match():
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for text in (" " * 9000 + "x", "a" + "\n" * 8192, "a" + " " * 8500 + "b" + "\t" * 8300):
        assert bpe.encode(enc, text) == enc.encode_ordinary(text)
    assert bpe.decode(enc, bpe.encode(enc, " " * 200_000)) == b" " * 200_000


def check_round_trip(rows, given):
    want = []
    for doc_id, text in given:
        ids = expected_ids(text or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        digests = [hashlib.sha256(b).hexdigest() for b in (packed, (text or "").encode())]
        want.append((doc_id, len(ids), *digests))
    key = lambda r: (r[0] is None, r[0], r[1:])
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)


def test_odd_texts_come_back(spark):
    found = bpe.round_trip(odd.documents(spark), RANKS, public_tokenizers.PATTERN).collect()
    check_round_trip(found, [r[:2] for r in odd.rows()])
    assert bpe.round_trip(odd.none(spark), RANKS, public_tokenizers.PATTERN).count() == 0
    kept = bpe.encoded(odd.documents(spark), RANKS, public_tokenizers.PATTERN).collect()
    assert {bytes(r.decoded).decode() for r in kept} == {r[1] or "" for r in odd.rows()}


def test_query_5(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    check_round_trip(queries.QUERIES["op5_byte_bpe"](spark, SMALL).collect(), docs)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def count(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_counts_of_odd_pieces(library):
    own = token_counts.Counter(VOCABULARY)
    for text in texts(6000, 12, 3):
        assert own.count(text) == count(library, text), text


def test_whole_tokens_are_proven(library):
    own = token_counts.Counter(VOCABULARY)
    assert len(own.whole) > 30_000
    for token in random.Random(4).sample(sorted(own.whole), 300):
        assert len(library.model.tokenize(token)) == 1


def test_memory_is_bounded(monkeypatch, library):
    monkeypatch.setattr(token_counts, "MEMORY", 50)
    own = token_counts.Counter(VOCABULARY)
    for text in texts(400, 12, 5):
        assert own.count(text) == count(library, text)
        assert max(len(own.known), len(own.merged)) <= 50


def test_counts_of_odd_documents(spark, library):
    found = token_counts.token_counts(odd.documents(spark), VOCABULARY, limit=100).collect()
    want = []
    for doc_id, text, *_ in odd.rows():
        n = count(library, text or "")
        want.append((doc_id, len((text or "").encode()), n, n > 100))
    key = lambda r: (r[0] is None, r[0], r[1:])
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)
    assert token_counts.token_counts(odd.none(spark), VOCABULARY).count() == 0


def test_query_6(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.QUERIES["op6_token_counts"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = count(library, docs[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 2048)
