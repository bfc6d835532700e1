"""The training-data pipeline: STAGES applied one after another to ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
all but the last return the columns of ``docs``.  Names of the input may clash with the
stages' own: decisions are joined by a key of (doc_id, text), never by the other columns.
A null doc_id or text, repeated rows, and an empty table pass through every stage as the
operators' modules define.  A column of the input must not be called ``__stage_key``
(ValueError).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm import bpe, decontaminate, jaccard, sanitize, toxicity
from tarnlake.llm.shared import materialize, maybe_broadcast, read, row_key, shared_dir
from tarnlake.sources.staging import scope

MAX_BROADCAST = 200_000  #: keys of rejected documents that are broadcast; more join by shuffle
_KEY = "__stage_key"


def _key() -> Column:
    return row_key(F.col("doc_id").cast("long"), F.col("text"))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` less the rows whose key is in ``rejected`` (one column, _KEY)."""
    if _KEY in docs.columns:
        raise ValueError(f"a column is called {_KEY}")
    gone = maybe_broadcast(materialize(rejected, "rejected"), MAX_BROADCAST)
    return docs.withColumn(_KEY, _key()).join(gone, _KEY, "left_anti").select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels beside the documents."""
    model = toxicity.train(toxicity.labelled_texts(docs, read(spark, sf_dir, "labels")))
    keyed = docs.select(_key().alias("doc_id"), "text")  # the operator passes its id through
    scored = toxicity.score(keyed, model)
    return _without(docs, scored.filter("predicted = 1").select(F.col("doc_id").alias(_KEY)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar documents stays: the one of the smallest doc_id.

    Rows equal in doc_id and text are one document: of such repeats one stays too.
    """
    grouped = materialize(jaccard.groups(docs).filter("group is not null").select("group", "doc_id", "place"), "groups")
    # a null id comes last; among equal ids with different texts the smallest key stays
    stay = grouped.groupBy("group").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("stay"))
    stay = materialize(stay.filter("n > 1").drop("n"), "stay")  # written, so that the join can split a large group
    gone = grouped.join(stay, "group").filter("place <> stay.place").select(F.col("place").alias(_KEY)).distinct()
    rest = _without(docs, gone)
    repeats = docs.select(_key().alias(_KEY)).groupBy(_KEY).agg(F.count("*").alias("n")).filter("n > 1")
    if repeats.isEmpty():
        return rest
    return rest.withColumn(_KEY, _key()).dropDuplicates([_KEY]).select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, however long they are."""
    keyed = docs.select(_key().alias("doc_id"), "text")
    judged = decontaminate.contamination(keyed, read(spark, sf_dir, "benchmark"))
    return _without(docs, judged.filter("n_hit > 0").select(F.col("doc_id").alias(_KEY)))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced; every document stays."""
    return sanitize.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every kept text, and what they decode to."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxic),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", leaks),
    ("pii_sanitisation", personal_data),
    ("bpe_encode_decode", tokenize),
]

#: Not expressible in SQL: a learned score and BPE merges; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    What a stage writes besides its result is removed when the result is written.
    """
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
