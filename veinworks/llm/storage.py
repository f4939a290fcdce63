"""The folder all executors share: tables and plain files in it."""

from __future__ import annotations

import gc
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

from veinworks.functions.storage import checkpoint_dir, checkpointed, discard, scratch, small_batches

__all__ = ["checkpoint_dir", "checkpointed", "deleted", "discard", "released", "scratch", "shared_folder", "small_batches", "table"]


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle and checkpoint files of finished rounds.

    The cleaner acts when the driver's JVM finds them unreachable; by default it looks every half hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for plain files, mounted at the same path on the driver and every executor."""
    url = urlparse(checkpoint_dir(spark))
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted shared folder; spark.checkpoint.dir has the scheme {url.scheme!r}")
    path = os.path.join(url.path, f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
