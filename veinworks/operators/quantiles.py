"""Exact interpolated quantiles of groups of any size, by rounds of histograms that carry counts instead of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinworks.functions.storage import checkpointed

#: Bins of a round, and how many values a task may sort to end the search in a bin.
BINS, MOST = 1024, 1_000_000


def _keys(by: tuple[str, ...], left: str, right: str) -> Column:
    """Equality of all keys, nulls together."""
    out = F.lit(True)
    for k in by:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def exact_quantiles(rows: DataFrame, by: tuple[str, ...], value: str, shares: tuple[float, ...], most: int = MOST, bins: int = BINS) -> DataFrame:
    """``by``, n and the columns q0, q1, ... of ``shares``, interpolated between neighbouring ranks; values that are null or NaN do not count.

    Where no group has more than ``most`` values this is one aggregation. Else the sought ranks are closed in: every
    round counts the values of each range that holds a rank in equal bins, and takes the bin's least and greatest value
    as the next range. A range ends when its values are equal or are at most ``most``, which one task sorts. Equal
    values can't hold the search up, since a range of one value is found; so each round parts at least two values.
    """
    kept = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).cast("double").alias("_v"))
    sizes = kept.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    if largest <= most:
        return kept.groupBy(*by).agg(F.count("*").alias("n"), *(F.percentile("_v", F.lit(q)).alias(f"q{i}") for i, q in enumerate(shares)))
    kept, sizes = checkpointed(kept), checkpointed(sizes)
    places = [(F.col("n") - 1) * F.lit(q) for q in shares]
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(p), F.ceil(p)) for p in places))))
    state = sizes.select(*by, F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), "lo", "hi", F.col("n").alias("count"))
    state = checkpointed(state)
    while True:
        is_open = (F.col("lo") < F.col("hi")) & (F.col("count") > most)
        wide = state.where(is_open)
        if wide.isEmpty():
            break
        # values may span more than a double holds, so halves are compared
        part = (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        inside = kept.alias("v").join(wide.select(*by, "lo", "hi").distinct().alias("r"), _keys(by, "v", "r") & F.col("_v").between(F.col("lo"), F.col("hi")))
        counted = inside.select(*(F.col(f"v.{k}").alias(k) for k in by), "lo", "hi", "_v", F.least(F.floor(part * bins), F.lit(bins - 1)).alias("bin")).groupBy(*by, "lo", "hi", "bin").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        binned = counted.withColumn("_before", before)
        on = _keys(by, "s", "b") & (F.col("s.lo") == F.col("b.lo")) & (F.col("s.hi") == F.col("b.hi"))
        offset = F.col("rank") - F.col("below")
        moved = wide.alias("s").join(binned.alias("b"), on).where((offset >= F.col("_before")) & (offset < F.col("_before") + F.col("_n")))
        closer = moved.select(*(F.col(f"s.{k}").alias(k) for k in by), "rank", (F.col("below") + F.col("_before")).alias("below"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_n").alias("count"))
        state = checkpointed(state.where(~is_open).unionByName(closer))
    # a range of few values is sorted, its ranks are picked
    few = state.where("lo < hi")
    values = kept.alias("v").join(few.select(*by, "lo", "hi", "below").distinct().alias("r"), _keys(by, "v", "r") & F.col("_v").between(F.col("lo"), F.col("hi")))
    sorted_ = values.select(*(F.col(f"v.{k}").alias(k) for k in by), "lo", "below", "_v").withColumn("rank", F.row_number().over(Window.partitionBy(*by, "lo", "below").orderBy("_v")) - 1 + F.col("below"))
    picked = sorted_.alias("v").join(few.alias("r"), _keys(by, "v", "r") & (F.col("v.rank") == F.col("r.rank")) & (F.col("v.below") == F.col("r.below"))).select(*(F.col(f"r.{k}").alias(k) for k in by), "r.rank", F.col("_v").alias("at"))
    found = state.where("lo = hi").select(*by, "rank", F.col("lo").alias("at")).unionByName(picked)
    table = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "at"))).alias("_at"))
    joined = sizes.alias("s").join(table.alias("t"), _keys(by, "s", "t"))

    def between(p: Column) -> Column:
        low, high = F.col("_at")[F.floor(p)], F.col("_at")[F.ceil(p)]
        return low + (high - low) * (p - F.floor(p))

    return joined.select(*(F.col(f"s.{k}").alias(k) for k in by), "n", *(between(p).alias(f"q{i}") for i, p in enumerate(places)))
