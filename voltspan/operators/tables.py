"""Tables in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """A folder that driver and executors share; where none is named (tests), a temporary one of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="voltspan-settled-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/voltspan"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by a table in the shared folder, so that lost executors cost no recomputation."""
    path = f"{shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete settled tables once all that was made from them is itself a table."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.settled_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
