"""Recovery as relational algebra over the log.

Analysis finds the ids with a COMMIT anywhere; redo keeps the inserts of those ids whose
table exists, in log order.  Rebuilding overwrites, so running it again changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.schema import MAX_ROW_BYTES, Schema, TypeId
from tarnlake.sources.catalog import Catalog
from tarnlake.sources.log import RecordType


def committed_ids(log: DataFrame) -> DataFrame:
    return log.filter(F.col("type") == int(RecordType.COMMIT)).select("txn_id").distinct()


def redo(log: DataFrame, tables: list[str]) -> DataFrame:
    """Insert records that recovery replays, of all known tables."""
    inserts = log.filter((F.col("type") == int(RecordType.INSERT)) & F.col("table_name").isin(tables))
    return inserts.join(committed_ids(log), "txn_id", "left_semi")


def _redoable(tables: list[str], fits: Column) -> Column:
    return (F.col("type") == int(RecordType.INSERT)) & F.col("table_name").isin(tables) & fits


def stats(log: DataFrame, tables: list[str], fits: Column | None = None) -> DataFrame:
    """One row of five counters. Per transaction first (partial sums, one shuffle), then over all.

    Every transaction without COMMIT counts as uncommitted, an aborted one too.
    """
    fits = F.lit(True) if fits is None else fits
    insert = F.col("type") == int(RecordType.INSERT)
    per = log.groupBy("txn_id").agg(
        F.count("*").alias("n"),
        F.max((F.col("type") == int(RecordType.COMMIT)).cast("int")).alias("committed"),
        F.sum(insert.cast("long")).alias("inserts"),
        F.sum(_redoable(tables, fits).cast("long")).alias("good"),
    )
    redone = F.when(F.col("committed") == 1, F.col("good")).otherwise(0)
    total = [
        F.sum("n").alias("records_scanned"),
        F.sum("committed").alias("txns_committed"),
        F.sum(1 - F.col("committed")).alias("txns_uncommitted"),
        F.sum(redone).alias("inserts_redone"),
        F.sum(F.col("inserts") - redone).alias("inserts_skipped"),
    ]
    out = per.agg(*total)
    return out.select(*[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in out.columns])


def decode(records: DataFrame, schema: Schema, strict: bool = True) -> DataFrame:
    """Rows of insert records of one table, with ``pos``. A bad row fails the job, or is dropped if not strict."""
    kinds = {TypeId.INTEGER: (pa.int64(), "bigint"), TypeId.VARCHAR: (pa.string(), "string")}
    names = [f"c{i}" for i in range(len(schema))]
    arrow = [kinds[c.type][0] for c in schema.columns]
    ddl = ", ".join([f"{n} {kinds[c.type][1]}" for n, c in zip(names, schema.columns, strict=True)] + ["pos bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data, pos in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows.append((*schema.decode(data), pos))
                except ValueError:
                    if strict:
                        raise
            columns = zip(*rows, strict=True) if rows else [[]] * (len(names) + 1)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, [*arrow, pa.int64()], strict=True)], names=[*names, "pos"])

    return records.select("tuple", "pos").mapInArrow(run, ddl).toDF(*[c.name for c in schema.columns], "pos")


def recover(catalog: Catalog, log: DataFrame, strict: bool = True) -> tuple[DataFrame, int]:
    """Rebuild every table of a catalog from the log. Returns the statistics and the next transaction id.

    A table's new content becomes visible as a whole, also to catalogs opened later, and its rows stay
    before all rows inserted afterwards.
    """
    tables = [*catalog.tables]
    kept = redo(log, tables).filter(F.length("tuple") <= MAX_ROW_BYTES)
    for name, info in catalog.tables.items():
        rows = decode(kept.filter(F.col("table_name") == name), info.schema, strict).orderBy("pos").drop("pos")
        catalog.rebuild(name, rows)
    last = log.agg(F.max("txn_id")).first()[0]
    return stats(log, tables, F.length("tuple") <= MAX_ROW_BYTES), (last or 0) + 1
