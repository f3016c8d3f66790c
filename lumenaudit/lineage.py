"""Where lineage ends: tables in the folder that the driver and all executors share; the size of what goes to Python."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def base_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset in local mode (tests), a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = "file://" + os.path.join(tempfile.gettempdir(), f"lumenaudit-{os.getuid()}", spark.sparkContext.applicationId)
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def on_hadoop(spark: SparkSession, uri: str):
    """The path and its file system, as Spark itself opens them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def work_dir(spark: SparkSession, name: str) -> str:
    """A new, unique place for one run; it goes when the driver ends."""
    folder = f"{base_dir(spark)}/lumenaudit/{name}-{uuid.uuid4().hex}"
    path, system = on_hadoop(spark, folder)
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


def drop(spark: SparkSession, uri: str) -> None:
    """Removes a table that nothing reads any more."""
    path, system = on_hadoop(spark, uri)
    system.delete(path, True)


def save(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` and reads it back: lineage ends here and survives the loss of executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What one Arrow batch of rows may have, about; a batch is on hand several times, in the JVM and in Python.
BATCH = 4 << 20
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Ten thousand long texts make no batch: lowers the session's bound on its bytes, if it is higher."""
    told = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_KEY))
    if not 0 < told <= BATCH:
        spark.conf.set(BATCH_KEY, str(BATCH))
