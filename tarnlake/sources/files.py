"""Small files and renames on whatever file system a path names, through Hadoop's FileSystem."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def listing(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file, or a folder with all that it holds; nothing if there is none."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def publish(spark: SparkSession, path: str, content: bytes) -> None:
    """Create a file whole or not at all: written under another name, then renamed. Fails if it exists."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    temporary = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
    out = fs.create(temporary, True)
    out.write(bytearray(content))
    out.hsync()
    out.close()
    if fs.exists(p) or not fs.rename(temporary, p):
        fs.delete(temporary, False)
        raise FileExistsError(path)
