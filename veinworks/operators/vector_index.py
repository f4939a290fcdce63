"""A kept vector index: blocks of vectors with their ids, checked by digests when it is opened, searched by matrix products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinworks.operators import matrix

#: Vectors in a block.
BLOCK = 1024


def save(rows: DataFrame, path: str, normalise: bool = True) -> None:
    """Write the vectors (evidence_id, vector) to ``path``. Rows without an id or a whole vector are left out; all others have one length, else this fails."""
    kept = rows.where(F.col("evidence_id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    widths = [r[0] for r in kept.select(F.size("vector")).distinct().limit(2).collect()]
    if len(widths) > 1:
        raise ValueError("vectors of several lengths")
    width, kind = (widths or [0])[0], rows.schema["evidence_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x = matrix.vectors_of(batch.column("vector"), width)
                if normalise:
                    length = np.linalg.norm(x, axis=1, keepdims=True)
                    x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
                ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("evidence_id"))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.astype("<f8").tobytes()], pa.binary())], names=["ids", "data"])

    packed = kept.select("evidence_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(pack, f"ids array<{kind}>, data binary")
    packed.withColumn("sha256", F.sha2("data", 256)).write.parquet(f"{path}/blocks")
    told = rows.sparkSession.read.parquet(f"{path}/blocks").agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).cast("long").alias("rows"), *_whole("sha256")).withColumns({"width": F.lit(width), "normalised": F.lit(normalise)})
    told.write.parquet(f"{path}/about")


def _whole(digest: str) -> list:
    """A digest of all blocks that doesn't depend on their order: sums of four parts of theirs."""
    part = lambda k: F.coalesce(F.sum(F.conv(F.substring(digest, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return [F.concat_ws("-", *(part(k) for k in range(4))).alias("digest")]


def load(spark: SparkSession, path: str) -> tuple[DataFrame, int, bool]:
    """The blocks, the vectors' length and whether they are normalised; raises ValueError where blocks or their number differ from what was saved."""
    about, blocks = spark.read.parquet(f"{path}/about").first(), spark.read.parquet(f"{path}/blocks")
    found = blocks.withColumn("_now", F.sha2("data", 256)).agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).cast("long").alias("rows"), *_whole("_now"), F.coalesce(F.count_if(F.col("_now") != F.col("sha256")), F.lit(0)).alias("broken")).first()
    if found["broken"] or (found["rows"], found["digest"]) != (about["rows"], about["digest"]):
        raise ValueError(f"{path}: {found['broken']} blocks differ from their digests; {found['rows']} rows, saved were {about['rows']}")
    return blocks, about["width"], about["normalised"]


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, limit: int = 4_000_000) -> DataFrame:
    """The ``k`` nearest of each query (query_id, query): query_id, evidence_id, score, rank. Queries are dealt into blocks of ``limit`` components; those of another length find nothing."""
    blocks, width, normalised = load(spark, path)
    kind = queries.schema["query_id"].dataType.simpleString()
    key_kind = blocks.schema["ids"].dataType.elementType.simpleString()
    asked = queries.where(F.size("query") == width).select("query_id", F.col("query").cast("array<double>").alias("query"))

    def block(some: list) -> DataFrame:
        sides = np.array([r["query"] for r in some], float).reshape(len(some), width)
        if normalised:
            length = np.linalg.norm(sides, axis=1, keepdims=True)
            sides = np.divide(sides, length, out=np.zeros_like(sides), where=length > 0)

        def parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, Callable[[slice], np.ndarray]]]:
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column("data")[i].as_buffer(), "<f8").reshape(-1, width)
                yield batch.column("ids").slice(i, 1).flatten(), lambda some, x=x: x @ sides[some].T

        return matrix.best_parts(blocks.select("ids", "data"), parts, [r["query_id"] for r in some], kind, k, "evidence_id", key_kind)

    return matrix.united(block(some) for some in matrix.blocks(asked, "query_id", max(1, limit // max(1, width))))
