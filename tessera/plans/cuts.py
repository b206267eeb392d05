"""Cutting lineage in bounded loops."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where none is set and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the session's shared folder and read back, so that a loop's plan, and Spark's estimate of its size, stay small.

    A checkpoint would compute df twice and keep the estimate, which grows with every join of a loop. The folder is removed
    when the interpreter ends, as any DataFrame may read it until then.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)
    except Exception:  # noqa: BLE001  the session has ended; its shared folder goes with it
        pass


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{_root(spark)}/{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the shared store has this path."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)
