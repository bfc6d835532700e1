"""Table schemas: two exact types, and any other Spark type passed through.

INTEGER is a 64-bit integer and VARCHAR a string; neither is ever null in an exact table.
The binary row form (used only by the log) is each value in order: 8 bytes
little-endian, or a 4-byte length and the UTF-8 bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import types as T

#: A page's bytes, its header and one slot, which bound a stored row.
PAGE_BYTES = 4096
PAGE_HEADER_BYTES = 12
SLOT_BYTES = 8
MAX_ROW_BYTES = PAGE_BYTES - PAGE_HEADER_BYTES - SLOT_BYTES


class TypeId(IntEnum):
    INTEGER = 1
    VARCHAR = 2


def type_id(spark_type: T.DataType) -> TypeId | None:
    """The exact type that a Spark type stands for; None for types passed through."""
    if isinstance(spark_type, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return TypeId.INTEGER
    if isinstance(spark_type, T.StringType):
        return TypeId.VARCHAR
    return None


@dataclass(frozen=True)
class Column:
    name: str
    type: TypeId


class Schema:
    """Ordered columns; names need not be unique, and the first match wins."""

    def __init__(self, columns: Sequence[Column | tuple[str, TypeId]]):
        self.columns = [c if isinstance(c, Column) else Column(*c) for c in columns]

    def __len__(self) -> int:
        return len(self.columns)

    def __getitem__(self, i: int) -> Column:
        return self.columns[i]

    def index_of(self, name: str) -> int:
        """Ordinal of the first column of exactly this name, or -1."""
        return next((i for i, c in enumerate(self.columns) if c.name == name), -1)

    def to_spark(self) -> T.StructType:
        kinds = {TypeId.INTEGER: T.LongType(), TypeId.VARCHAR: T.StringType()}
        return T.StructType([T.StructField(c.name, kinds[c.type], False) for c in self.columns])

    def check(self, row: Sequence[object]) -> None:
        """Raise ValueError unless the row has this schema's number and types of values."""
        if len(row) != len(self.columns):
            raise ValueError(f"{len(self.columns)} values expected, {len(row)} given")
        for value, c in zip(row, self.columns, strict=True):
            good = isinstance(value, int) and not isinstance(value, bool) if c.type is TypeId.INTEGER else isinstance(value, str)
            if not good:
                raise ValueError(f"column {c.name} takes {c.type.name}, not {value!r}")
            if c.type is TypeId.INTEGER and not -(2**63) <= value < 2**63:
                raise ValueError(f"column {c.name}: {value} is not a 64-bit integer")

    def encode(self, row: Sequence[object]) -> bytes:
        self.check(row)
        out = []
        for value, c in zip(row, self.columns, strict=True):
            if c.type is TypeId.INTEGER:
                out.append(struct.pack("<q", value))
            else:
                raw = value.encode("utf-8", "surrogateescape")
                out += [struct.pack("<i", len(raw)), raw]
        return b"".join(out)

    def decode(self, data: bytes) -> tuple[object, ...]:
        """The row in ``data``; ValueError if it is too short; bytes after the last column are ignored."""
        at, row = 0, []
        for c in self.columns:
            value, at = _read(c, data, at)
            row.append(value)
        return tuple(row)

    def decode_column(self, data: bytes, ordinal: int) -> object:
        if not 0 <= ordinal < len(self.columns):
            raise ValueError(f"no column {ordinal}")
        return self.decode(data)[ordinal]

    def fits(self, row: Sequence[object]) -> bool:
        """Whether the encoded row fits into an empty page."""
        return len(self.encode(row)) <= MAX_ROW_BYTES


def _read(c: Column, data: bytes, at: int) -> tuple[object, int]:
    if c.type is TypeId.INTEGER:
        if len(data) < at + 8:
            raise ValueError(f"row ends inside column {c.name}")
        return struct.unpack_from("<q", data, at)[0], at + 8
    if len(data) < at + 4:
        raise ValueError(f"row ends inside column {c.name}")
    size = struct.unpack_from("<i", data, at)[0]
    if size < 0 or len(data) < at + 4 + size:
        raise ValueError(f"row ends inside column {c.name}")
    return data[at + 4 : at + 4 + size].decode("utf-8", "surrogateescape"), at + 4 + size
