"""Tables kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: A batch lies in memory as rows, in the executor's buffers and in the Python worker, so it must not grow with the texts.
ARROW_BATCH_BYTES = 8_000_000
class _Open(threading.local):
    """The scratch blocks that a thread is in."""

    def __init__(self) -> None:
        self.blocks: list[list[DataFrame]] = []


_scratch = _Open()


def checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder is set where that is unset and Spark runs on one machine. A cluster has to name one."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="veinworks-checkpoints-"))
        configured = sc.getCheckpointDir()
    return configured


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark hands Python batches of ARROW_BATCH_BYTES at most."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(ARROW_BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read again.

    A lost executor costs no recomputation. Unlike ``checkpoint()``, the table brings its real size to the
    planner: there, estimates of joins are products of their inputs', and in a loop their digits multiply
    until the driver's memory is full.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._written_to = path
    if _scratch.blocks:
        _scratch.blocks[-1].append(kept)
    return kept


@contextmanager
def bucketed(df: DataFrame, key: str, buckets: int) -> Iterator[DataFrame]:
    """``df`` written once as a table of ``buckets`` files by a hash of ``key``, which joins and groups by that key read without shuffling it; dropped at the end."""
    spark = df.sparkSession
    name, path = f"bucketed_{uuid.uuid4().hex}", f"{checkpoint_dir(spark)}/bucketed-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
    try:
        kept = spark.table(name)
        kept._written_to = path
        yield kept
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(kept)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``checkpointed`` wrote and nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Delete at its end all tables that ``checkpointed`` wrote within it in this thread; results must have been written out by then."""
    _scratch.blocks.append([])
    try:
        yield
    finally:
        discard(*_scratch.blocks.pop())
