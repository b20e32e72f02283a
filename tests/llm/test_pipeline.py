import hashlib
import struct
from collections import Counter

import public_tokenizers

import corpus_pipeline
from conftest import SMALL
from test_near_dedup import plain_classes
from test_pii import plain_spans
from test_quality import plain_references
from tilepulse.llm import bpe, mixing, pii, quality
from tilepulse.llm.queries import RANKS


def test_stages_equal_the_same_by_hand(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    known = plain_references([(r.text, r.lang) for r in table])
    docs = [r for r in table if quality.verdict(r.text, known[r.lang])["kept"]]
    groups = plain_classes([(r.doc_id, r.text) for r in docs]).values()
    docs = sorted((min((docs[i] for i in g), key=lambda r: r.doc_id) for g in groups), key=lambda r: r.doc_id)
    weights = pii.trained()
    clean = []
    for r in docs:
        spans = pii.find(r.text, weights)[1]
        assert set(plain_spans(r.text)) <= set(spans)
        clean.append((r.doc_id, pii.redact(r.text, spans), r.lang, r.source))
    frame = spark.createDataFrame(clean, "doc_id long, text string, lang string, source string")
    plan = mixing.mix_plan(frame).select("row.doc_id", "row.text", "copies").collect()
    enc = bpe.encoding(public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    want = Counter()
    for doc_id, text, copies in plan:
        ids = enc.encode_ordinary(text)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        digests = [hashlib.sha256(b).hexdigest() for b in (packed, text.encode())]
        want[doc_id, len(ids), *digests] += copies
    got = Counter(map(tuple, corpus_pipeline.run(spark, SMALL).collect()))
    assert got == +want and len(got) > 50


def test_stages_hand_on_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).dtypes == docs.dtypes
