"""Tables in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _LIBC = None


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder; where the session names none (tests), a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="voltspan-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again, so that lost executors cost no recomputation.

    free: also delete the files that finished shuffles have left.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/voltspan/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if free:
        free_shuffles(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.voltspan_path = path
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Delete what finished shuffles have left; without this, those files stay until the JVM happens to collect."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        for _ in range(6):
            if held.isEmpty():
                break
            time.sleep(0.05)
        if held.isEmpty():
            break


def release(*tables: DataFrame) -> None:
    """Delete materialised tables once all that was made from them is itself a table."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.voltspan_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trim() -> None:
    """Hand freed memory back to the system; a worker that has had a large task would keep it while idle."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def tidy(f):
    """A function for mapInArrow that leaves its worker small."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            _trim()

    return run


def tidy_group(f):
    """A function for a group's table that leaves its worker small."""

    def run(table):
        out = f(table)
        _trim()
        return out

    return run
