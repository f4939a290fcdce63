"""Joins of intervals: overlaps found through bins, each pair once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinworks.functions.storage import checkpointed

#: Rows of either side in a piece of a cell that has more than their square of pairs, and the most partitions.
SIDE, MOST_PARTS = 2_000, 2_000

def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: float, start: str = "start", end: str = "end", right_start: str = "start", right_end: str = "end") -> DataFrame:
    """All columns of both sides, the right ones under their names with ``other_`` before them, for intervals of equal ``keys`` that touch or overlap.

    Both sides are laid into bins of ``width`` and joined on keys and bin, so a table with many rows is many keys. A pair
    that shares several bins is kept in the first of them only; bins of one key are dealt over tasks by their pairs. Rows with a null bound, or that end before they start,
    meet none.
    """
    named = right.select(*keys, *(F.col(c).alias(f"other_{c}") for c in right.columns if c not in keys))

    def binned(rows: DataFrame, low: str, high: str, first: str) -> DataFrame:
        at = lambda c: F.floor(F.col(c) / width)
        kept = rows.where(F.col(low) <= F.col(high)).withColumn(first, at(low))
        return kept.withColumn("_bin", F.explode(F.sequence(first, at(high))))

    a, b = binned(left, start, end, "_first"), binned(named, f"other_{right_start}", f"other_{right_end}", "_other_first")
    cell = [*keys, "_bin"]
    # keys are few however many rows they have, so both sides of a cell with many pairs are cut, and each cut of one meets each of the other
    sizes = a.groupBy(*cell).agg(F.count("*").alias("_a")).join(b.groupBy(*cell).agg(F.count("*").alias("_b")), cell)
    cuts = lambda n: F.when(F.col("_a") * F.col("_b").cast("double") <= SIDE * SIDE, 1).otherwise(F.ceil(F.col(n) / SIDE)).cast("int")
    cut = checkpointed(sizes.select(*cell, cuts("_a").alias("_left"), cuts("_b").alias("_right"), (F.col("_a") * F.col("_b").cast("double")).alias("_pairs")))
    # Spark joins partitions by their bytes, which say nothing of the pairs in them, so their number is set
    parts = int(min(MOST_PARTS, (cut.agg(F.sum("_pairs")).first()[0] or 0) // (SIDE * SIDE) + 1))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        each = rows.withColumn("_hash", F.xxhash64(*rows.columns)).join(cut.select(*cell, "_left", "_right"), cell)
        placed = each.withColumn(own, F.pmod("_hash", own).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return placed.drop("_hash").repartition(parts, *cell, "_left", "_right")

    met = dealt(a, "_left", "_right").join(dealt(b, "_right", "_left"), [*cell, "_left", "_right"]).where((F.col(start) <= F.col(f"other_{right_end}")) & (F.col(f"other_{right_start}") <= F.col(end)) & (F.col("_bin") == F.greatest("_first", "_other_first")))
    return met.drop("_bin", "_first", "_other_first", "_left", "_right")


def inside(x0: Column, top: Column, x1: Column, bottom: Column, width: float, height: float) -> Column:
    """Whether a box has an area and lies inside the page."""
    return F.coalesce((x0 >= 0) & (top >= 0) & (x1 <= width) & (bottom <= height) & (x1 > x0) & (bottom > top), F.lit(False))


def same_row(boxes: DataFrame, width: float, height: float, bin_height: float = 25.0) -> DataFrame:
    """Pairs (unit_id < other_unit_id) of boxes of one page, table and row group that overlap in height by more than nothing; both lie inside the page.

    Boxes are unit_id, page, table_id, group_id, x0, top, x1, bottom. Boxes without a group meet none.
    """
    whole = boxes.where(inside(F.col("x0"), F.col("top"), F.col("x1"), F.col("bottom"), width, height))
    met = overlapping(whole, whole, ["page", "table_id", "group_id"], bin_height, "top", "bottom", "top", "bottom").where("unit_id < other_unit_id")
    shared = F.least("bottom", "other_bottom") - F.greatest("top", "other_top")
    return met.withColumn("overlap", F.round(shared, 6)).where("overlap > 0").select("page", "table_id", "group_id", "unit_id", "other_unit_id", "overlap")
