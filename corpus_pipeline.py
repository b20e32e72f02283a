"""From raw documents to token ids: rules, near-duplicates, personal data, mix, encoding.

Each stage is a function of (spark, docs, sf_dir) and works on all that the one before
kept; what it returns is written and read again as the next one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilepulse.llm import bpe, mixing, near_dedup, pii, quality
from tilepulse.llm.queries import RANKS
from tilepulse.llm.tables import table
from tilepulse.sources.workspace import written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def first_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest doc_id."""
    return near_dedup.keep_first(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind, and their new lengths."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document taken, one row each time it is: how many, and
    digests of the ids and of the bytes they decode to."""
    path = public_tokenizers.path(RANKS)
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", good_documents),
    ("near-duplicates", first_of_each),
    ("personal data", without_personal_data),
    ("source mix", mixed),
    ("byte-level BPE", encoded),
]

# Near-duplicate classes, span scores and merges have no SQL form; tests/llm holds the
# stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = written(docs, "stage")
    return docs
