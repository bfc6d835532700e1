"""The operators on streams: predicates on any stream, and a log followed as it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions.predicates import Expr, compile_predicate
from tarnlake.sources.log import RecordType


def follow(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Log records from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def filter_stream(stream: DataFrame, predicate: Expr, semantics: str = "exact") -> DataFrame:
    return stream.filter(compile_predicate(predicate, stream, semantics))


def committed_inserts(log: DataFrame, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Inserts of a log stream once their transaction's COMMIT has arrived.

    ``log`` needs an event time column.  State is bounded: an insert waits at most
    ``late`` for its commit (or a commit for its inserts), by watermark.
    """
    timed = log.withWatermark(time, late)
    inserts = timed.filter(F.col("type") == int(RecordType.INSERT))
    commits = timed.filter(F.col("type") == int(RecordType.COMMIT)).select(F.col("txn_id").alias("_id"), F.col(time).alias("_at"))
    limit = F.expr(f"INTERVAL {late}")
    near = (F.col("_at") >= F.col(time) - limit) & (F.col("_at") <= F.col(time) + limit)
    return inserts.join(commits, (F.col("txn_id") == F.col("_id")) & near, "inner").drop("_id", "_at")
