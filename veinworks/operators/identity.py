"""Stable ids, de-duplication, graph layers and integrity rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the separator of an identity's parts.
SEPARATOR = "␟"


def normalised(text: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix and the first twenty hex digits of the SHA-256 of the parts."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws(SEPARATOR, *parts), 256), 1, 20))


def best_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; the order should be total."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def duplicates_removed(rows: DataFrame, keys: list[str]) -> DataFrame:
    per = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    return per.agg(F.sum("_n").cast("long").alias("rows"), F.count("*").alias("kept"), F.sum(F.col("_n") - 1).cast("long").alias("removed"))


def first_seen(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """All rows, with ``duplicate`` true for all but the first of each key."""
    return rows.withColumn("duplicate", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def coverage_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, with the side; a full outer join of distinct keys."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(True))
    joined = a.join(b, keys, "full_outer").where("_l IS NULL OR _r IS NULL")
    return joined.select(*keys, F.when(F.col("_l").isNull(), "right").otherwise("left").alias("only"))


def rule(name: str, severity: str, rows: DataFrame, violated: Column, example: Column) -> DataFrame:
    """One rule as rows evaluated, violations and up to eight least examples."""
    told = rows.agg(F.count("*").alias("evaluated"), F.count_if(violated).alias("violations"))
    worst = rows.where(violated).select(example.cast("string").alias("_e")).distinct().orderBy("_e").limit(8).agg(F.array_join(F.array_sort(F.collect_list("_e")), ",").alias("examples"))
    # both sides are one row
    return told.join(F.broadcast(worst)).select(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), "evaluated", "violations", "examples")


def rules(rows: DataFrame, checks: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """Several rules (name, severity, violated, example) over the same rows, as ``rule`` gives them, in two passes over all.

    Counts are one conditional aggregation. Examples of violations are ranked by rule; ranking keeps the first eight of
    each task before the shuffle.
    """
    names = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.col("_n").alias("evaluated"), F.col(f"_v{i}").alias("violations")) for i, (n, s, _, _) in enumerate(checks)))
    told = rows.agg(F.count("*").alias("_n"), *(F.count_if(v).alias(f"_v{i}") for i, (_, _, v, _) in enumerate(checks))).select(F.inline(names))
    broken = rows.select(F.explode(F.array_compact(F.array(*(F.when(v, F.struct(F.lit(n).alias("rule"), e.cast("string").alias("_e"))) for n, _, v, e in checks)))).alias("_b")).select("_b.*")
    first = broken.withColumn("_r", F.dense_rank().over(Window.partitionBy("rule").orderBy("_e"))).where("_r <= 8").groupBy("rule").agg(F.array_join(F.array_sort(F.collect_set("_e")), ",").alias("examples"))
    return told.join(F.broadcast(first), "rule", "left").select("rule", "severity", "evaluated", "violations", F.coalesce("examples", F.lit("")).alias("examples"))


def report(rules: list[DataFrame]) -> DataFrame:
    """All rules, each with whether it blocks a release."""
    return reduce(DataFrame.unionByName, rules).withColumn("blocking", (F.col("severity") == "error") & (F.col("violations") > 0))


def changed_fields(released: DataFrame, raw: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, changed): the fields in which a released record differs from the raw one (nulls are equal), joined by commas; ``absent`` without one."""
    held = raw.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_raw_{c}") for c in fields))
    differs = F.array_join(F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_raw_{c}")), c) for c in fields))), ",")
    return released.join(held, released[key] == held["_key"], "left").select(key, F.when(F.col("_key").isNull(), "absent").otherwise(differs).alias("changed"))
