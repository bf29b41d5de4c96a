"""What the corpus operators share: session helpers and durable intermediate tables.

Intermediate results are written as Parquet under ``spark.checkpoint.dir`` (a
folder that all executors share), never to a machine-local folder, so a lost
executor costs a re-run of its tasks and nothing else.
"""

from __future__ import annotations

import ctypes
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Characters that separate words in every contract of this subpackage.
SPLIT = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one in the warehouse, which executors share too, only where none is set (tests, local mode)."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_logweave-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(found)
    return found


@contextmanager
def frugal(spark: SparkSession):
    """Inside, shuffle files go as soon as their execution has ended, and texts go to Python in batches of bounded bytes."""
    own = {CLEAN_SHUFFLES: "true", BATCH_BYTES: str(8 << 20)}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def keep(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage durably."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    with frugal(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def discard(*kept: DataFrame) -> None:
    """Delete tables made by ``keep`` that nothing reads any more."""
    for df in kept:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.kept_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def released(run):
    """``run`` for mapInPandas; a worker process that stays for later tasks gives what it has freed back to the system after each."""

    def own(batches):
        try:
            yield from run(batches)
        finally:
            try:
                pa.default_memory_pool().release_unused()
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return own


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets(df: DataFrame, times: int = 4) -> int:
    """Buckets for an exchange of packed arrays; follows the number of input splits."""
    return times * max(32, df.rdd.getNumPartitions())


def input_bytes(df: DataFrame) -> int | None:
    """Size of the tables that a frame reads, by the optimizer's statistics; None where it has none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return size if size < 1 << 55 else None


def words(text: Column) -> Column:
    """``[^\\x20\\x09-\\x0D]+`` of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda w: w != "")
