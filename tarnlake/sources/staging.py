"""Tables written to the shared folder so that several plans, or rounds, see the same rows.

The folder is ``spark.checkpoint.dir``, which driver and executors share; only where that
is unset and everything runs in one process (tests, one machine) a temporary folder takes its
place; on a cluster an unset folder is an error.  Written tables cut lineage, so a lost
executor costs nothing later.  They stay until the folder is cleared, or until the
``scope`` that they were written in ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tarnlake.sources import files

_open_scopes: list[list[str]] = []


def one_process(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, as with master ``local[n]``."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name inside ``spark.checkpoint.dir``; ValueError if a cluster names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not one_process(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tarnlake-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    for scope in _open_scopes:
        scope.append(path)
    return path


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession, *kept: str) -> Iterator[None]:
    """Remove at its end all folders that ``shared_dir`` has named within it, except ``kept``.

    For callers that have written their result elsewhere; frames read from the folders are void afterwards.
    """
    own: list[str] = []
    _open_scopes.append(own)
    try:
        yield
    finally:
        _open_scopes[:] = [x for x in _open_scopes if x is not own]
        for path in own:
            if path not in kept:
                files.remove(spark, path)
