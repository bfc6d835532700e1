"""The write-ahead log: binary frames on disk, records as a DataFrame.

A frame is ``lsn, txn_id`` (64 bit), ``type`` and the table name's length (32 bit), the name, ``page_id,
slot_id`` and the tuple's length (32 bit), and the tuple, all little-endian.  Reading
stops at a torn tail.  ``pos``, the byte offset, orders records, since LSNs restart when
a log is reopened.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from enum import IntEnum

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tarnlake.sources import files

SCHEMA = "lsn long, txn_id long, type int, table_name string, page_id int, slot_id int, tuple binary, pos long"
FORMAT = "tarnlake_log"


class RecordType(IntEnum):
    BEGIN = 1
    INSERT = 2
    COMMIT = 3
    ABORT = 4


@dataclass(frozen=True)
class Record:
    lsn: int
    txn_id: int
    type: int
    table_name: str = ""
    page_id: int = -1
    slot_id: int = -1
    tuple: bytes = b""


def to_bytes(r: Record) -> bytes:
    name = r.table_name.encode()
    return struct.pack("<qqii", r.lsn, r.txn_id, r.type, len(name)) + name + struct.pack("<iii", r.page_id, r.slot_id, len(r.tuple)) + r.tuple


def from_stream(stream) -> Iterator[tuple]:
    """(record fields..., pos) of every whole frame."""
    pos = 0
    while len(head := stream.read(24)) == 24:
        lsn, txn, kind, size = struct.unpack("<qqii", head)
        if size < 0:
            return
        name, rest = stream.read(size), stream.read(12)
        if len(name) < size or len(rest) < 12:
            return
        page, slot, length = struct.unpack("<iii", rest)
        if length < 0:
            return
        data = stream.read(length)
        if len(data) < length:
            return
        yield lsn, txn, kind, name.decode("utf-8", "replace"), page, slot, bytes(data), pos
        pos += 36 + size + length


def _open(path: str):
    fs, at = pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return fs, at


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        fs, at = _open(partition.path)
        if fs.get_file_info(at).type == pa.fs.FileType.NotFound:
            return
        with fs.open_input_stream(at) as stream:
            yield from from_stream(stream)


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        fs, at = _open(self.path)
        fs.create_dir(at, recursive=True)
        part = TaskContext.get()
        name = f"{at}/part-{part.partitionId():05d}.log"
        temporary = f"{at}/.part-{part.partitionId():05d}-{part.taskAttemptId()}"
        with fs.open_output_stream(temporary) as out:
            for r in iterator:
                out.write(to_bytes(Record(r.lsn, r.txn_id, r.type, r.table_name, r.page_id, r.slot_id, bytes(r.tuple))))
        fs.move(temporary, name)
        return WriterCommitMessage()


class LogSource(DataSource):
    """``spark.read.format("tarnlake_log").load(file)`` and the matching writer into a folder."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader([p for p in self.options.get("path", "").split(",") if p])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of a binary log file; none if there is no file."""
    spark.dataSource.register(LogSource)
    return spark.read.format(FORMAT).load(path)


class LogManager:
    """Assigns LSNs, buffers frames, and makes them durable when flushed.

    Every flush publishes one segment of the log; segments in name order are the log.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.next_lsn, self.flushed_lsn = 0, -1
        self._segment = len(files.listing(spark, self.path))
        self._buffer: list[Record] = []

    def append(self, txn_id: int, kind: RecordType, table_name: str = "", page_id: int = -1, slot_id: int = -1, data: bytes = b"") -> int:
        lsn = self.next_lsn
        self._buffer.append(Record(lsn, txn_id, int(kind), table_name, page_id, slot_id, data))
        self.next_lsn += 1
        return lsn

    def flush(self) -> None:
        if self._buffer:
            files.publish(self.spark, f"{self.path}/{self._segment:012d}", b"".join(map(to_bytes, self._buffer)))
            self._segment += 1
            self._buffer.clear()
        self.flushed_lsn = self.next_lsn - 1

    def records(self) -> DataFrame:
        """All flushed records with ``pos`` over the segments in order."""
        names = files.listing(self.spark, self.path)
        if not names:
            return self.spark.createDataFrame([], SCHEMA)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import io

            names = [f.strip().split(" ")[0] for f in SCHEMA.split(",")]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
            for b in batches:
                for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    segment = int(path.rpartition("/")[2])
                    rows = [(*r[:-1], (segment << 40) + r[-1]) for r in from_stream(io.BytesIO(content))]
                    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        found = self.spark.read.format("binaryFile").load([f"{self.path}/{n}" for n in names]).select("path", "content")
        return found.mapInArrow(run, SCHEMA)
