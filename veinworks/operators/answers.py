"""Answers: contracts, guards, verification cascades, utilities and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinworks.operators.quantiles import exact_quantiles


def contract_violations(status: Column, citations: Column, allowed: Column, text: Column, limit: int) -> Column:
    """Why an answer is not valid: unknown status, missing or foreign citations, or too long a text."""
    return F.array_compact(F.array(
        F.when(~status.isin("answered", "abstained"), "status"),
        F.when((status == "answered") & (F.size(citations) == 0), "no_citation"),
        F.when(F.size(F.array_except(citations, allowed)) > 0, "foreign_citation"),
        F.when(F.char_length(text) > limit, "too_long"),
    ))


def utility(answerable: Column, status: Column, citations: Column, relevant: Column) -> Column:
    """F1 of citations if the query is answerable and answered; 1 for a right abstention, else 0."""
    hits = F.size(F.array_intersect(citations, relevant))
    f1 = F.coalesce(F.try_divide(2.0 * hits, F.size(citations) + F.size(relevant)), F.lit(0.0))
    return F.round(F.when(answerable & (status == "answered"), f1).when(~answerable & (status == "abstained"), 1.0).otherwise(0.0), 6)


def coverage_guard(points: DataFrame, most: int) -> DataFrame:
    """Direct points, one per claim (the best), at most ``most`` per query."""
    best = points.where("direct").withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "claim_id").orderBy(F.desc("score"), "evidence_id"))).where("_r = 1")
    return best.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "evidence_id"))).where(F.col("position") <= most).drop("_r")


def cascade(votes: DataFrame, mode: str) -> DataFrame:
    """Candidates accepted by mode: ``direct_render`` all; ``stage1_only`` by the first vote; ``stage1_plus_review`` also those that review saves."""
    kept = {"direct_render": F.lit(True), "stage1_only": F.col("first"), "stage1_plus_review": F.col("first") | F.coalesce(F.col("review"), F.lit(False))}[mode]
    return votes.groupBy("query_id").agg(F.count_if(kept).alias("accepted"), F.count("*").alias("candidates"), F.count_if(~F.col("first")).alias("reviewed")).withColumn("mode", F.lit(mode))


def expanded(mask: Column, ids: Column) -> Column:
    """The ids that a 0/1 mask chooses; none of a mask that isn't binary or has another length."""
    sound = F.forall(mask, lambda b: b.isin(0, 1)) & (F.size(mask) == F.size(ids))
    chosen = F.transform(F.filter(F.arrays_zip(mask.alias("b"), ids.alias("i")), lambda x: x["b"] == 1), lambda x: x["i"])
    return F.when(sound, chosen).otherwise(F.slice(ids, 1, 0))


def agreement(pairs: DataFrame, *by: str) -> DataFrame:
    """Mean Jaccard similarity of two id arrays, and how often their first ids agree."""
    jaccard = F.coalesce(F.try_divide(F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))), F.lit(0.0))
    return pairs.groupBy(*by).agg(F.count("*").alias("pairs"), F.round(F.avg(jaccard), 6).alias("jaccard"), F.round(F.avg((F.try_element_at("a", F.lit(1)) == F.try_element_at("b", F.lit(1))).cast("double")), 6).alias("same_first"))


def position_effect(runs: DataFrame, methods: int) -> DataFrame:
    """Latency by the position that a run had among its query's runs, in time order."""
    order = Window.partitionBy("query_id").orderBy("ts", "event_id")
    at = runs.withColumn("position", (F.row_number().over(order) - 1) % methods)
    return exact_quantiles(at, ("position",), "latency", (0.5, 0.95)).select("position", F.col("n").alias("runs"), F.round("q0", 6).alias("p50"), F.round("q1", 6).alias("p95"))


def yields(rows: DataFrame, *by: str) -> DataFrame:
    """Ratios of sums: accepted per candidate, and per minute of the time spent."""
    sums = rows.groupBy(*by).agg(F.sum("accepted").cast("long").alias("accepted"), F.sum("candidates").cast("long").alias("candidates"), F.sum("seconds").alias("_s"))
    return sums.select(*by, "accepted", "candidates", F.round(F.try_divide("accepted", "candidates"), 6).alias("rate"), F.round(F.try_divide(F.col("accepted") * 60.0, "_s"), 6).alias("per_minute"))


def rendered(template: Column, head: Column, tail: Column, limit: int) -> Column:
    """A claim from its relation's template, cut to ``limit`` characters and ended by one full stop."""
    text = F.replace(F.replace(template, F.lit("{head}"), head), F.lit("{tail}"), tail)
    return F.concat(F.regexp_replace(F.left(text, F.lit(limit - 1)), r"[\s.,;:!?]+$", ""), F.lit("."))
