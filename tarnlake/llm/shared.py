"""What several operators of this subpackage need: shared-folder tables, checked broadcasts, ordered shards.

Nothing here collects rows of documents to the driver.  The driver only ever
receives counts, a bounded number of shard bounds, or a sample whose bound is a
parameter of the operator.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.sources.staging import materialize, one_process, shared_dir  # noqa: F401  operators import them from here

#: The repository, so that Python workers started elsewhere can import the package.
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 250
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 2_000_000


#: Allocator settings of Python workers: freed arrays go back to the system instead of staying with a long-lived worker.
_LEAN = {"MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "131072", "ARROW_DEFAULT_MEMORY_POOL": "system"}


_shipped: set[str] = set()  #: applications that have the package


def _ship(spark: SparkSession) -> None:
    """Give the package to the executors: by path where they are this process, else as an archive."""
    env = spark.sparkContext.environment
    if one_process(spark):
        paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if _ROOT not in paths:
            env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    elif spark.sparkContext.applicationId not in _shipped:
        folder = tempfile.mkdtemp(prefix="tarnlake-")  # of the driver alone, which serves the archive to executors of any time
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "tarnlake"), "zip", _ROOT, "tarnlake"))
        _shipped.add(spark.sparkContext.applicationId)


def prepare(spark: SparkSession, lean: bool = True) -> None:
    """Let Python workers import this package, and bound their memory.

    This sets the session's Arrow batch size (at most ``BATCH_ROWS``, and no further row once it has
    ``BATCH_BYTES``) and, in workers started later, allocator settings.
    """
    _ship(spark)
    env = spark.sparkContext.environment
    if lean:
        env.update({k: v for k, v in _LEAN.items() if k not in env})
    if int(spark.conf.get(_BATCH_ROWS)) > BATCH_ROWS:  # whole texts are large rows
        spark.conf.set(_BATCH_ROWS, str(BATCH_ROWS))
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_BYTES)) > BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


def trim() -> None:
    """Give the system back what this process has freed; without it glibc's malloc keeps arrays of up to 32 MB."""
    with contextlib.suppress(OSError, AttributeError):  # other systems have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the test data as a DataFrame, by whatever file system its path names."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


MAX_BROADCAST_BYTES = 64_000_000

_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)


def fits_broadcast(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether ``df`` was counted to have at most ``max_rows`` rows and ``max_bytes``, as JSON or 8 bytes a number."""
    some = df.limit(max_rows + 1)
    wide = [f.name for f in df.schema if not isinstance(f.dataType, _FIXED)]
    size = F.lit(16 + 8 * len(df.columns))
    if wide:
        size = size + F.octet_length(F.to_json(F.struct(*[f"`{c}`" for c in wide])))
    rows, total = some.agg(F.count("*"), F.sum(size)).first()
    return rows <= max_rows and (total or 0) <= max_bytes


def maybe_broadcast(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast only if it fits; see ``fits_broadcast``."""
    return F.broadcast(df) if fits_broadcast(df, max_rows, max_bytes) else df


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that name a row's content (null text read as empty)."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))))


def crc32_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal text of ``doc_id`` modulo ``modulus`` (null ids count as the text '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


MAX_REGIONS = 256  #: quantile bounds of ordered_shards
MAX_PARTS = 400  #: equal-width parts of a region; with all regions about as many tasks as a stage bears


def ordered_shards(df: DataFrame, key: str, bytes_per_shard: int, size: Column) -> tuple[DataFrame, int]:
    """Add ``_shard``: contiguous ranges of an integer ``key`` holding about ``bytes_per_shard`` each.

    Quantiles of the key cut at most ``MAX_REGIONS`` regions of like size, and equal widths
    cut each into at most ``MAX_PARTS``; so the driver receives few numbers whatever the
    input, and beyond their product shards grow instead (they are read as streams).
    Null keys go to shard 0.  Rows with equal keys share a shard.  Returns the frame
    and the number of shards.
    """
    ranks = [i / MAX_REGIONS for i in range(1, MAX_REGIONS)]
    quantiles = F.percentile_approx(F.col(key), ranks or [0.5], max(10_000, 20 * MAX_REGIONS))
    total, count, least, most, got = df.agg(F.sum(size), F.count(F.col(key)), F.min(key), F.max(key), quantiles).first()
    wanted = max(1, -(-int(total or 0) // bytes_per_shard))
    if not count or wanted == 1:
        return df.withColumn("_shard", F.lit(0)), 1
    regions = min(wanted, MAX_REGIONS)
    bounds = sorted({got[i * MAX_REGIONS // regions - 1] for i in range(1, regions)})
    region = _bucket(F.col(key), bounds)
    parts = min(MAX_PARTS, -(-wanted // regions))
    if parts == 1:
        return df.withColumn("_shard", region), len(bounds) + 1
    low, high = (F.element_at(F.array(*[F.lit(float(x)) for x in ends]), region + 1) for ends in ([least, *bounds], [*bounds, most + 1]))
    part = F.floor((F.col(key).cast("double") - low) * parts / F.greatest(high - low, F.lit(1.0)))
    within = F.when(F.col(key).isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(parts - 1), part)))
    return df.withColumn("_shard", (region * parts + within).cast("int")), (len(bounds) + 1) * parts


def _bucket(key: Column, bounds: list) -> Column:
    """Number of bounds that are at most ``key``, as a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(key.isNull(), F.lit(0)).otherwise(tree(0, len(bounds))).cast("int")


def by_shard(df: DataFrame, shards: int, *order: str) -> DataFrame:
    """Every shard whole in one partition, its rows sorted by ``order``."""
    return df.repartitionById(shards, F.col("_shard")).sortWithinPartitions("_shard", *order)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column with null read as the empty text."""
    return [t or "" for t in column(batch, name)]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut incoming Arrow batches so that one holds at most ``rows`` rows and about ``chars`` bytes of buffers.

    Whole rows only; a single row larger than ``chars`` is a batch of its own.
    """
    for batch in batches:
        n = batch.num_rows
        step = rows
        if n and batch.nbytes > chars:
            step = max(1, min(rows, int(n * chars / batch.nbytes)))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
