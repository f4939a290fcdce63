"""Incremental ingestion of assertion records with Structured Streaming: an addition to the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veinworks.operators.gates import with_reasons


def validated(spark: SparkSession, path: str, schema: StructType, per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet records with the reasons for which each is not eligible."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return with_reasons(reader.parquet(path))


def accepted(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Eligible records, each key once within the watermark."""
    return stream.where(F.size("reasons") == 0).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_latency(events: DataFrame, time: str = "ts", every: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Count and mean latency by method and tumbling window of event time; late rows are dropped after ``delay``."""
    per = events.withWatermark(time, delay).groupBy(F.window(time, every), "method").agg(F.count("*").alias("runs"), F.avg("latency").alias("mean"))
    return per.select(F.col("window.start").alias("start"), "method", "runs", F.round("mean", 6).alias("mean"))


def batch_sink(path: str):
    """A function for ``foreachBatch``: every batch is a folder of its own, named by its id, and replaces an earlier try.

    A batch that is run again after a failure, whole or in part, leaves the rows of one run.
    """

    def put(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return put
