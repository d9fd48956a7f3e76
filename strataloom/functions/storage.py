"""Writing intermediate tables to the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The application's folder in spark.checkpoint.dir; in local mode a temporary one where that is unset.

    Elsewhere the setting must be made, as executors can't read each other's folders. What an application has
    left there can be removed when it has ended: the folder bears its id.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if folder:
        return f"{folder}/{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"


def stored(df: DataFrame, tag: str, codec: str | None = None) -> tuple[DataFrame, str]:
    """What `materialise` returns, and where it is."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """Write df and read it back, which cuts lineage and survives lost executors; with Spark's codec where none is named."""
    return stored(df, tag, codec)[0]


def superseded(spark: SparkSession, path: str) -> None:
    """Delete a table of `stored` that nothing reads any more, and have Spark drop the shuffles of plans that are gone.

    Spark does so itself only when the driver collects its garbage, which in a loop of large shuffles may be too late.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    gc.collect()  # else Python still holds the plans
    spark._jvm.System.gc()
