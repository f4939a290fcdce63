"""Gapless numbers in a given order, without a window that holds all rows or all of one group."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinworks.functions.storage import checkpointed


def numbered(rows: DataFrame, *order: str | Column, name: str = "number") -> DataFrame:
    """Add ``name``: 0, 1, 2, ... in the order given. Rows are dealt by ranges, sorted and written; then each range's base is the sum of those before it.

    The driver reads one count a partition. Rows that are equal in ``order`` are numbered in any order, but once and for
    all, since the table is written first.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = checkpointed(sorted_rows.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = sorted((r["_part"], r["n"]) for r in kept.groupBy("_part").agg(F.count("*").alias("n")).collect())
    bases = dict(zip((p for p, _ in counts), accumulate((n for _, n in counts), initial=0)))
    base = F.create_map(*(F.lit(x) for pair in bases.items() for x in pair))[F.col("_part")] if bases else F.lit(0)
    return kept.withColumn(name, (base + F.col("_row")).cast("long")).drop("_part", "_row")


def numbered_within(rows: DataFrame, group: str, *order: str | Column, name: str = "number") -> DataFrame:
    """Add ``name``: 0, 1, 2, ... in each group; a group may be as large as the table."""
    every = numbered(rows, group, *order, name="_number")
    first = every.groupBy(F.col(group).alias("_group")).agg(F.min("_number").alias("_first"))
    return every.join(first, F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, F.col("_number") - F.col("_first")).drop("_group", "_first", "_number")
