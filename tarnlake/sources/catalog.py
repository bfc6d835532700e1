"""Tables and unique indexes over Parquet batches, with atomic publication.

A table is a sequence of batches; a batch's folder name is its number, so (folder, file, row)
is insertion order.  A batch counts once its manifest has been published by a rename;
files without one are never read.  Inserts are buffered by the caller (a list of rows or
a DataFrame) and become one batch, never one job per row.  The rows of a session's open and aborted
transactions follow its batches.

A RID is (batch, place): the batch's number, and the row's place in it or, for pending rows
(batch ``PENDING``), among the pending.

An index over a key is, for every batch, its entries ``key, rid`` of first rows, range-partitioned and
sorted by the key, so that a look-up reads the row groups that may hold the key and no others.
Batches published later are indexed when an index is next used.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.schema import Schema, TypeId
from tarnlake.sources import files

REBUILT = "r"  #: ends the number of a batch that stands for all before it
PENDING = "~pending"  #: sorts after every batch
INDEX_GROUP_BYTES = 262_144  #: row groups of sorted entries


@dataclass(frozen=True)
class Rid:
    """Where a row lies; rows in the order of their RIDs are in insertion order."""

    batch: str
    place: int


@dataclass
class TableInfo:
    name: str
    schema: Schema
    path: str
    batches: list[str] = field(default_factory=list)
    pending: dict[int, list[tuple]] = field(default_factory=dict)  #: by transaction, rows of this session that no batch holds

    def pending_rows(self) -> list[tuple]:
        return [r for rows in self.pending.values() for r in rows]


@dataclass(frozen=True)
class IndexInfo:
    name: str
    table: str
    key: int


class Catalog:
    """Names are case-sensitive and live in one namespace per kind."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables: dict[str, TableInfo] = {}
        self.indexes: dict[str, IndexInfo] = {}
        self._sorted: dict[str, set[str]] = {}  #: by folder of entries, the batches known to be in it

    # -- tables ---------------------------------------------------------------

    def create_table(self, name: str, schema: Schema) -> TableInfo:
        """Register a table; batches already published under its path are its rows. ValueError if the name exists."""
        if name in self.tables:
            raise ValueError(f"table {name} exists")
        path = f"{self.root}/{name}"
        done = sorted(n.removesuffix(".ok") for n in files.listing(self.spark, f"{path}/manifest") if n.endswith(".ok"))
        rebuilt = [n for n in done if n.endswith(REBUILT)]
        # a rebuilt batch stands for all before it
        self.tables[name] = TableInfo(name, schema, path, [n for n in done if not rebuilt or n >= rebuilt[-1]])
        return self.tables[name]

    def get_table(self, name: str) -> TableInfo | None:
        return self.tables.get(name)

    def insert_rows(self, name: str, rows: Iterable[Sequence[object]]) -> list[Rid | None]:
        """Publish rows as one batch, in their order. Returns each row's RID; None for a row that does not fit and is refused.

        KeyError without such a table, ValueError if a row does not match the schema (then nothing is inserted).
        """
        table = self.tables[name]
        rows = [tuple(r) for r in rows]
        fits = [table.schema.fits(r) for r in rows]
        good = [r for r, ok in zip(rows, fits, strict=True) if ok]
        batch = self._publish_rows(table, good) if good else ""
        place = iter(range(len(good)))
        return [Rid(batch, next(place)) if ok else None for ok in fits]

    def _publish_rows(self, table: TableInfo, rows: list[tuple]) -> str:
        """One batch of rows that are known to fit, through Arrow."""
        kinds = {TypeId.INTEGER: pa.int64(), TypeId.VARCHAR: pa.string()}
        columns = [pa.array([r[i] for r in rows], kinds[c.type]) for i, c in enumerate(table.schema.columns)]
        frame = self.spark.createDataFrame(pa.Table.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))]))
        return self._publish(table, frame.coalesce(1).toDF(*[c.name for c in table.schema.columns]))

    def append(self, name: str, rows: DataFrame) -> None:
        """Publish a DataFrame as one batch (bulk path; written in parallel, in its partitions' order)."""
        table = self.tables[name]
        target = table.schema.to_spark()
        if len(rows.columns) != len(target):
            raise ValueError(f"{len(target)} columns expected, {len(rows.columns)} given")
        self._publish(table, rows.toDF(*[f"c{i}" for i in range(len(target))]).select(*[F.col(f"c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(target)]))

    def _publish(self, table: TableInfo, frame: DataFrame, mark: str = "") -> str:
        batch = f"{int(table.batches[-1][:12]) + 1 if table.batches else 1:012d}{mark}"
        frame.write.mode("overwrite").parquet(f"{table.path}/batch={batch}")
        files.publish(self.spark, f"{table.path}/manifest/{batch}.ok", b"")
        table.batches.append(batch)
        return batch

    def rebuild(self, name: str, rows: DataFrame) -> None:
        """Publish ``rows`` as the table's whole content: one batch that stands for all before it, from one manifest on."""
        table = self.tables[name]
        batch = self._publish(table, rows, REBUILT)
        table.batches[:] = [batch]

    def _scan(self, table: TableInfo) -> DataFrame:
        if not table.batches:
            return self.spark.createDataFrame([], table.schema.to_spark())
        return self.spark.read.schema(table.schema.to_spark()).parquet(*[f"{table.path}/batch={b}" for b in table.batches])

    def committed(self, name: str) -> DataFrame:
        """Rows of published batches."""
        return self._scan(self.tables[name])

    def table(self, name: str) -> DataFrame:
        """The session's view: published rows and those of its own open or aborted transactions."""
        table = self.tables[name]
        rows, pending = self._scan(table), table.pending_rows()
        return rows.union(self.spark.createDataFrame(pending, table.schema.to_spark())) if pending else rows

    def fetch(self, name: str, rid: Rid) -> tuple | None:
        """The row at a RID, or None."""
        table = self.tables[name]
        if rid.batch == PENDING:
            rows = table.pending_rows()
            return rows[rid.place] if 0 <= rid.place < len(rows) else None
        if rid.batch not in table.batches:
            return None
        found = self._numbered(table, rid.batch).filter(F.col("_place") == rid.place).drop("_place").first()
        return tuple(found) if found is not None else None

    def _numbered(self, table: TableInfo, batch: str) -> DataFrame:
        """Rows of a batch as ``c0, c1, ..`` with ``_place``: their place over the batch's files in order."""
        read = self.spark.read.schema(table.schema.to_spark()).parquet(f"{table.path}/batch={batch}")
        names = [f"c{i}" for i in range(len(table.schema))]
        rows = read.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")).toDF(*names, "_file", "_row")
        sizes = rows.groupBy("_file").agg(F.max("_row").alias("_n"))  # one row per file
        before = F.coalesce(F.sum(F.col("_n") + 1).over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return rows.join(F.broadcast(sizes.select("_file", before.alias("_before"))), "_file").select(*names, (F.col("_before") + F.col("_row")).alias("_place"))

    def count_rows(self, name: str) -> int:
        """Rows of the session's view; -1 without such a table."""
        return self.table(name).count() if name in self.tables else -1

    # -- indexes --------------------------------------------------------------

    def create_index(self, name: str, table: str, column: str) -> IndexInfo:
        """Register a unique index over an integer column; ValueError if the name exists or the column cannot be a key."""
        if name in self.indexes:
            raise ValueError(f"index {name} exists")
        if table not in self.tables:
            raise ValueError(f"no table {table}")
        schema = self.tables[table].schema
        key = schema.index_of(column)
        if key < 0:
            raise ValueError(f"no column {column} in {table}")
        if schema[key].type is not TypeId.INTEGER:
            raise ValueError("index keys are integers")
        self.indexes[name] = IndexInfo(name, table, key)
        return self.indexes[name]

    def get_index(self, name: str) -> IndexInfo | None:
        return self.indexes.get(name)

    def _indexed(self, info: IndexInfo) -> DataFrame:
        """Sorted entries of all batches and of pending rows: key, rid, and the row; each batch's first row of a key."""
        table = self.tables[info.table]
        names = [f"c{i}" for i in range(len(table.schema))]
        folder = f"{self.root}/_index/{info.table}.{info.key}"  # by key, so that indexes of one key share it
        done = self._sorted.setdefault(folder, set())
        if not done.issuperset(table.batches):
            done.update(n.removesuffix(".ok") for n in files.listing(self.spark, f"{folder}/manifest") if n.endswith(".ok"))
        for batch in table.batches:
            if batch not in done:
                rid = F.struct(F.lit(batch).alias("batch"), F.col("_place").alias("place"))
                rows = self._numbered(table, batch).select(F.col(f"c{info.key}").alias("key"), rid.alias("rid"), F.struct(*names).alias("row"))
                first = rows.groupBy("key").agg(F.min("rid").alias("rid"), F.min_by("row", "rid").alias("row"))
                sorted_ = first.repartitionByRange("key").sortWithinPartitions("key")
                sorted_.write.mode("overwrite").option("parquet.block.size", INDEX_GROUP_BYTES).parquet(f"{folder}/batch={batch}")
                files.publish(self.spark, f"{folder}/manifest/{batch}.ok", b"")
                done.add(batch)
        shape = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(table.schema.to_spark())])
        entry = T.StructType([T.StructField("key", T.LongType()), T.StructField("rid", T.StructType([T.StructField("batch", T.StringType()), T.StructField("place", T.LongType())])), T.StructField("row", shape)])
        pending = [(r[info.key], (PENDING, i), r) for i, r in enumerate(table.pending_rows())]
        if not table.batches:
            return self.spark.createDataFrame(pending, entry)
        rows = self.spark.read.schema(entry).parquet(*[f"{folder}/batch={b}" for b in table.batches])
        return rows.union(self.spark.createDataFrame(pending, entry)) if pending else rows

    def index(self, name: str) -> DataFrame:
        """The index's entries: ``key, rid``, the first inserted row of each key, in the session's view."""
        return self._indexed(self.indexes[name]).groupBy("key").agg(F.min("rid").alias("rid"))

    def lookup(self, name: str, value: int) -> DataFrame:
        """The first inserted row of a key, or none; row-group statistics of the sorted entries leave few rows to read."""
        info = self.indexes[name]
        first = self._indexed(info).filter(F.col("key") == value).orderBy("rid").limit(1)
        return first.select("row.*").toDF(*[c.name for c in self.tables[info.table].schema.columns])

    def lookup_many(self, name: str, keys: DataFrame) -> DataFrame:
        """The first inserted row of each of ``keys`` (one column): one semi-join for all."""
        info = self.indexes[name]
        wanted = self._indexed(info).join(keys.toDF("key").distinct(), "key", "left_semi")
        first = wanted.groupBy("key").agg(F.min_by("row", "rid").alias("row"))
        return first.select("row.*").toDF(*[c.name for c in self.tables[info.table].schema.columns])

    def index_summary(self, name: str) -> DataFrame:
        """One row: entries, least and greatest key."""
        return self.index(name).agg(F.count("*").alias("entries"), F.min("key").alias("least"), F.max("key").alias("greatest"))
