"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hitfeed.llm import bitsliced_topk, divergence, entropy_mix, fim_chunks
from hitfeed.llm.bottomk import edited_fingerprints
from hitfeed.llm.common import read
from hitfeed.llm.embedding_itq import embedding_components
from hitfeed.llm.langid_crossparse import predict_languages
from hitfeed.llm.packing import pack_documents
from hitfeed.llm.pii_weak import personal_data
from hitfeed.llm.qda_quality import quality_scores
from hitfeed.llm.secret_scan import secrets
from hitfeed.llm.simhash import simhash_components
from hitfeed.llm.token_count import token_counts

Query = Callable[[SparkSession, str], DataFrame]


def op1_embedding_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(read(spark, sf_dir, "embeddings"), threshold=0.9)


def op2_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=0.3)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(read(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read(spark, sf_dir, "documents"), k=256, shingle=5)


def op6_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix.mix(read(spark, sf_dir, "documents"), weights=(5, 2, 1), cap=3)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(read(spark, sf_dir, "documents"), fdr=0.01)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read(spark, sf_dir, "documents"), accept=0.9)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"), shingle=4, radius=4)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024)


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"), min_docs=10, top=10)


def op12_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced_topk.top_inner_products(read(spark, sf_dir, "embeddings"), every=20, k=20, scale=64)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_chunks.fim_digests(read(spark, sf_dir, "documents"), salt="7:", rate=100, spm=50)


QUERIES: dict[str, Query] = {
    "op1_embedding_itq": op1_embedding_itq,
    "op2_quality_qda": op2_quality_qda,
    "op3_language": op3_language,
    "op4_token_counts": op4_token_counts,
    "op5_fingerprints": op5_fingerprints,
    "op6_entropy_mix": op6_entropy_mix,
    "op7_secret_scan": op7_secret_scan,
    "op8_pii": op8_pii,
    "op9_simhash": op9_simhash,
    "op10_packing": op10_packing,
    "op11_divergence_audit": op11_divergence_audit,
    "op12_bitsliced_topk": op12_bitsliced_topk,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES: dict[str, str] = {
    "op6_entropy_mix": entropy_mix.ORACLE,
    "op11_divergence_audit": divergence.ORACLE,
    "op12_bitsliced_topk": bitsliced_topk.ORACLE,
    "op13_fill_in_middle": fim_chunks.ORACLE,
}
