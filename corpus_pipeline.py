"""Training-corpus pipeline over ``documents``: one stage after the other, each by one operator.

1. quality: documents that the quadratic discriminant rejects go;
2. near duplicates: of each group of SimHash-linked documents the one with the smallest id stays;
3. personal data: spans are replaced by their kind (text and n_chars change);
4. mixing: each document occurs as often as the mix of sources takes it;
5. packing: the pieces of all documents with their sequences and offsets.

Every stage reads what its predecessor has written, whole.  All but the last return the columns
of documents.  An empty table, or nulls in any column, pass through every stage as the
operators define them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hitfeed.llm.common import discard, materialize, read, store  # noqa: F401
from hitfeed.llm.entropy_mix import mixed_documents
from hitfeed.llm.packing import pack_documents
from hitfeed.llm.pii_weak import redact
from hitfeed.llm.qda_quality import keep_quality
from hitfeed.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, read(spark, sf_dir, "labels"), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, shingle=4, radius=4)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs, accept=0.9)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs, weights=(5, 2, 1), cap=3)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024)


STAGES = [
    ("quality", quality),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

#: The classifier, the fingerprints and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again, and removed once the next
    stage has read it (the last when the driver ends)."""
    docs, path = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        done = path
        docs, path = store(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if done:
            discard(spark, done)
    return docs
