"""The operators as functions from DataFrames to DataFrames; all are lazy.

Catalyst plans them: filters and column sets reach the scans, sorts are range exchanges with
spilling sorts, and the join is a sort-merge join whose sides adaptive execution may split.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.predicates import Expr, column_of, compile_predicate, positional
from tarnlake.schema import TypeId, type_id


@dataclass(frozen=True)
class SortKey:
    ordinal: int
    ascending: bool = True


def column_at(df: DataFrame, ordinal: int) -> Column:
    if not 0 <= ordinal < len(df.columns):
        raise IndexError(f"no column {ordinal} among {len(df.columns)}")
    return column_of(df, ordinal)


def _renamed(df: DataFrame, like: DataFrame) -> DataFrame:
    return df if df.columns == like.columns else df.toDF(*like.columns)


def filter_rows(df: DataFrame, predicate: Expr, semantics: str = "exact") -> DataFrame:
    """Rows for which the predicate is true; the schema is unchanged, and its names may be equal."""
    own = positional(df)
    return _renamed(own.filter(compile_predicate(predicate, own, semantics)), df)


def sort_rows(df: DataFrame, keys: Sequence[SortKey]) -> DataFrame:
    """Rows in lexicographic order of the keys (strings bytewise); ties in any order; without keys unchanged."""
    if not keys:
        return df
    own = positional(df)
    return _renamed(own.orderBy(*[column_at(own, k.ordinal).asc() if k.ascending else column_at(own, k.ordinal).desc() for k in keys]), df)


def merge_join(left: DataFrame, right: DataFrame, left_key: int, right_key: int, semantics: str = "sql") -> DataFrame:
    """Inner sort-merge equi-join on one integer key; right columns are renamed ``r_<name>``.

    Inputs need no order.  A string key is a TypeError; with ``exact`` semantics every
    string key reads as 0, so the result is the Cartesian product.
    Add ``sort_rows`` where the order of the result matters.
    """
    kinds = [type_id(df.schema.fields[k].dataType) for df, k in ((left, left_key), (right, right_key))]
    # positional names until the end, since left and renamed right names may still clash
    width = len(left.columns)
    names = [*left.columns, *[f"r_{c}" for c in right.columns]]
    a = left.toDF(*[f"c{i}" for i in range(width)])
    b = right.toDF(*[f"c{i}" for i in range(width, len(names))])
    if kinds[0] is TypeId.INTEGER and kinds[1] is TypeId.INTEGER:
        joined = a.hint("merge").join(b, F.col(f"c{left_key}") == F.col(f"c{width + right_key}"), "inner")
    elif semantics == "exact" and TypeId.VARCHAR in kinds:
        zero = F.lit(0).cast("bigint")
        x = F.col(f"c{left_key}").cast("bigint") if kinds[0] is TypeId.INTEGER else zero
        y = F.col(f"c{width + right_key}").cast("bigint") if kinds[1] is TypeId.INTEGER else zero
        joined = a.filter(x == 0).crossJoin(b) if kinds[0] is TypeId.INTEGER else a.crossJoin(b.filter(y == 0) if kinds[1] is TypeId.INTEGER else b)
    else:
        raise TypeError("the join key is an integer column on both sides")
    return joined.toDF(*names)


# -- rows by position, and unique indexes over a key --------------------------


def with_rid(df: DataFrame) -> DataFrame:
    """``df`` (read from files) with ``_rid``: the file and the row's place in it, which is insertion order within a file."""
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("_rid"))


def fetch(df: DataFrame, file: str, row: int) -> DataFrame:
    """The row at a position, or none."""
    return df.filter((F.col("_metadata.file_path") == file) & (F.col("_metadata.row_index") == row))


def index_scan(df: DataFrame, key: int, value: int, order: Column | None = None) -> DataFrame:
    """The first inserted row with this integer key, or none.

    The filter reaches the scan; on files sorted by the key, row-group statistics
    leave a few thousand rows to read.
    """
    if type_id(df.schema.fields[key].dataType) is not TypeId.INTEGER:
        raise TypeError("index keys are integers")
    place = order if order is not None else F.struct("_metadata.file_path", "_metadata.row_index")
    found = df.select("*", place.alias("_place")).filter(column_at(df, key) == value)
    return found.orderBy("_place").limit(1).drop("_place")


def index_entries(df: DataFrame, key: int, order: str | Column = "_rid") -> DataFrame:
    """The unique index over a key: ``key`` and the least ``order`` of its rows; a partial aggregate, then one shuffle."""
    place = F.col(order) if isinstance(order, str) else order
    return df.groupBy(column_at(df, key).alias("key")).agg(F.min(place).alias("rid"))


def first_per_key(df: DataFrame, key: int, order: str | Column = "_rid") -> DataFrame:
    """Every key's first inserted row, as all point lookups at once."""
    place = F.col(order) if isinstance(order, str) else order
    row = F.struct(*[column_of(df, i) for i in range(len(df.columns))])
    return df.groupBy(column_at(df, key).alias("_key")).agg(F.min_by(row, place).alias("_row")).select("_row.*")


def lookup_many(df: DataFrame, key: int, keys: DataFrame, order: str | Column = "_rid") -> DataFrame:
    """Point lookups of all of ``keys`` (one column): a semi-join, then the first row of each key."""
    wanted = keys.toDF("_wanted").distinct()
    return first_per_key(df.join(wanted, column_at(df, key) == F.col("_wanted"), "left_semi"), key, order)


def range_scan(df: DataFrame, key: int, low: int, high: int) -> DataFrame:
    """Rows with low <= key <= high in key order."""
    return df.filter(column_at(df, key).between(low, high)).orderBy(column_at(df, key))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))
