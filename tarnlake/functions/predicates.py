"""Predicates over columns by ordinal, compiled once into Spark columns.

Types are known when the plan is built, so the exact rules need no run-time dispatch:

* two integers compare as integers, two strings byte by byte;
* in ``exact`` semantics every string operator other than EQ means NE, and an integer
  compared with a string reads as the empty string; in ``sql`` semantics strings have
  their order and mixed comparisons are a TypeError;
* comparisons and AND/OR yield 1 or 0 and can be compared in turn; an integer is true
  unless 0, a string never is.

A comparison stays a boolean column wherever it is used as one, so filters reach the Parquet
scan; it becomes a bigint only under another comparison.  Other Spark types
compare as Spark compares them, and nulls follow SQL.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.schema import TypeId, type_id


class Op(Enum):
    EQ = "="
    NE = "<>"
    LT = "<"
    LE = "<="
    GT = ">"
    GE = ">="


class Expr:
    """A node; build with the functions below."""


@dataclass(frozen=True)
class ColumnAt(Expr):
    ordinal: int


@dataclass(frozen=True)
class Constant(Expr):
    value: int | str


@dataclass(frozen=True)
class Comparison(Expr):
    left: Expr
    op: Op
    right: Expr


@dataclass(frozen=True)
class Logic(Expr):
    left: Expr
    both: bool  #: AND, else OR
    right: Expr


def col(ordinal: int) -> Expr:
    return ColumnAt(ordinal)


def const_int(value: int) -> Expr:
    return Constant(int(value))


def const_str(value: str) -> Expr:
    return Constant(str(value))


def cmp(left: Expr, op: Op, right: Expr) -> Expr:
    return Comparison(left, op, right)


def and_(left: Expr, right: Expr) -> Expr:
    return Logic(left, True, right)


def or_(left: Expr, right: Expr) -> Expr:
    return Logic(left, False, right)


def not_(e: Expr) -> Expr:
    """True where ``e`` is 0 (a derived form, there is no NOT node)."""
    return Comparison(e, Op.EQ, Constant(0))


@dataclass(frozen=True)
class _Typed:
    """A compiled node: its type (None: passed through) and its boolean or value column."""

    type: TypeId | None
    boolean: Column | None = None
    plain: Column | None = None

    @property
    def value(self) -> Column:
        return self.plain if self.plain is not None else self.boolean.cast("bigint")

    @property
    def truth(self) -> Column:
        if self.boolean is not None:
            return self.boolean
        if self.type is TypeId.VARCHAR:
            return F.lit(False)
        return self.plain != F.lit(0)


def _apply(left: Column, op: Op, right: Column) -> Column:
    match op:
        case Op.EQ:
            return left == right
        case Op.NE:
            return left != right
        case Op.LT:
            return left < right
        case Op.LE:
            return left <= right
        case Op.GT:
            return left > right
        case Op.GE:
            return left >= right


def column_of(df: DataFrame, ordinal: int) -> Column:
    """The column at a position; see ``positional`` for frames with equal names."""
    return F.col(f"`{df.columns[ordinal].replace('`', '``')}`")


def positional(df: DataFrame) -> DataFrame:
    """``df`` itself, or with its columns called by their positions if names are equal (whatever their case)."""
    names = [c.lower() for c in df.columns]
    return df if len(set(names)) == len(names) else df.toDF(*[f"_{i}" for i in range(len(names))])


def _compile(e: Expr, df: DataFrame, semantics: str) -> _Typed:
    match e:
        case ColumnAt(i):
            fields = df.schema.fields
            if not 0 <= i < len(fields):
                raise IndexError(f"no column {i} among {len(fields)}")
            return _Typed(type_id(fields[i].dataType), plain=column_of(df, i))
        case Constant(str() as v):
            return _Typed(TypeId.VARCHAR, plain=F.lit(v))
        case Constant(v):
            return _Typed(TypeId.INTEGER, plain=F.lit(v).cast("bigint"))
        case Logic(a, both, b):
            x, y = _compile(a, df, semantics).truth, _compile(b, df, semantics).truth
            return _Typed(TypeId.INTEGER, boolean=x & y if both else x | y)
        case Comparison(a, op, b):
            return _Typed(TypeId.INTEGER, boolean=_comparison(_compile(a, df, semantics), op, _compile(b, df, semantics), b, semantics))
    raise TypeError(f"not an expression: {e!r}")


def _comparison(x: _Typed, op: Op, y: _Typed, right: Expr, semantics: str) -> Column:
    if x.boolean is not None and right == Constant(0) and op in (Op.EQ, Op.NE):
        return ~x.boolean if op is Op.EQ else x.boolean
    kinds = {x.type, y.type}
    if kinds == {TypeId.INTEGER, TypeId.VARCHAR}:
        if semantics == "sql":
            raise TypeError("an integer and a string do not compare")
        text = x.value if x.type is TypeId.VARCHAR else y.value
        return _apply(text, op if op is Op.EQ else Op.NE, F.lit(""))
    if kinds == {TypeId.VARCHAR} and semantics == "exact" and op is not Op.EQ:
        op = Op.NE
    return _apply(x.value, op, y.value)


def compile_predicate(e: Expr, df: DataFrame, semantics: str = "exact") -> Column:
    """The boolean column that is true where ``e`` is; a frame with equal names must have gone through ``positional``."""
    if semantics not in ("exact", "sql"):
        raise ValueError(f"semantics is exact or sql, not {semantics}")
    return _compile(e, df, semantics).truth


def compile_value(e: Expr, df: DataFrame, semantics: str = "exact") -> Column:
    """The value of ``e``; 1 or 0 for comparisons and AND/OR."""
    return _compile(e, df, semantics).value
