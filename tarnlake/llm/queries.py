"""The queries of this subpackage: thin contract views over its operators, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm import bpe, decontaminate, fingerprints, jaccard, languages, sanitize, token_counts, toxicity, urls, wavelet
from tarnlake.llm.shared import read


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(read(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_pairs(read(spark, sf_dir, "documents"))


def op4_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitize.digests(sanitize.find(read(spark, sf_dir, "documents")))


def op5_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.train_and_score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.train_and_identify(read(spark, sf_dir, "documents"))


def op7_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return wavelet.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), ids=False)


def op8_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


def op9_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_decontaminate": op2_decontaminate,
    "op3_fingerprints": op3_fingerprints,
    "op4_sanitize": op4_sanitize,
    "op5_toxicity_cnn": op5_toxicity_cnn,
    "op6_language_bitmask": op6_language_bitmask,
    "op7_wavelet_matrix": op7_wavelet_matrix,
    "op8_url_trees": op8_url_trees,
    "op9_bpe_encode_decode": op9_bpe_encode_decode,
    "op10_token_counts": op10_token_counts,
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": jaccard.ORACLE_SQL,
    "op2_decontaminate": decontaminate.ORACLE_SQL,
}
