"""Support of claims by independent source families, with a fixed budget as denominator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinworks.functions.storage import checkpointed
from veinworks.operators.quantiles import MOST, exact_quantiles

#: Weights of evidence levels and entailment statuses.
LEVEL_WEIGHTS = {"E1": 1.0, "E2": 0.95, "E3": 0.75}
STATUS_WEIGHTS = {"entailed": 1.0, "undetermined": 0.75, "not_entailed": 0.0}


def weight(column: Column, weights: dict[str, float]) -> Column:
    found = F.lit(0.0)
    for k, v in weights.items():
        found = F.when(column == k, v).otherwise(found)
    return found


def heuristic_score(confidence: Column, level: Column, status: Column) -> Column:
    """Confidence times the weights of level and status, to six places; unknown ones weigh nothing.

    Confidence is held between 0 and 1; null and NaN count as 0.
    """
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan(confidence), F.lit(0.0)).otherwise(F.coalesce(confidence, F.lit(0.0)))))
    return F.round(held * weight(level, LEVEL_WEIGHTS) * weight(status, STATUS_WEIGHTS), 6)


def status_or_flag(status: Column, flag: Column) -> Column:
    """The entailment status; where it is null, entailed or undetermined by the flag; empty where both are null."""
    return F.coalesce(status, F.when(flag, "entailed").when(~flag, "undetermined"), F.lit(""))


def with_score(assertions: DataFrame) -> DataFrame:
    return assertions.withColumn("q", heuristic_score(F.col("confidence"), F.col("level"), F.col("status")))


def eligible(scored: DataFrame) -> DataFrame:
    """Direct, build-split evidence of the first two levels."""
    return scored.where("split = 'build_train' AND level IN ('E1', 'E2') AND NOT inferred")


def capped_support(rows: DataFrame, budget: int = 2, source: str = "family_id") -> DataFrame:
    """Per claim: the mean over ``budget`` of its best sources' scores; a source counts once, with its best row."""
    best = rows.groupBy("claim_id", source).agg(F.max("q").alias("q"), F.count("*").alias("n"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("q"), source)))
    return ranked.groupBy("claim_id").agg(
        F.round(F.sum(F.when(F.col("rank") <= budget, F.col("q"))) / budget, 6).alias("support"),
        F.count("*").alias("sources"),
        F.sum("n").cast("long").alias("rows"),
    )


def supporting_rows(rows: DataFrame) -> DataFrame:
    """The row that speaks for each (claim, family): best score, then least assertion."""
    order = Window.partitionBy("claim_id", "family_id").orderBy(F.desc("q"), "evidence_id", "doc_id")
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def budget_support(rows: DataFrame, budgets: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """Support per claim for each budget: the best sources are ranked once, and prefix sums serve all budgets."""
    best = rows.groupBy("claim_id", "family_id").agg(F.max("q").alias("q"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("q"), "family_id")))
    sums = ranked.groupBy("claim_id").agg(*(F.round(F.sum(F.when(F.col("rank") <= b, F.col("q"))) / b, 6).alias(str(b)) for b in budgets))
    return sums.select("claim_id", F.explode(F.array(*(F.struct(F.lit(b).alias("budget"), F.col(str(b)).alias("support")) for b in budgets))).alias("_b")).select("claim_id", "_b.budget", "_b.support")


def summary(support: DataFrame, *by: str, most: int = MOST) -> DataFrame:
    """Counts and exact interpolated quartiles of support; a group of more than ``most`` claims is never in one task."""
    kept = checkpointed(support)
    parts = [f"q{i}" for i in range(3)]
    quartiles = exact_quantiles(kept, by, "support", (0.25, 0.5, 0.75), most).select(*(F.col(c).alias(f"_{c}") for c in by), *parts)
    counts = kept.groupBy(*by).agg(
        F.count("*").alias("claims"), F.round(F.avg("support"), 6).alias("mean"), F.min("support").alias("low"), F.max("support").alias("high"), F.count_if(F.col("support") >= 0.5).alias("at_least_half"), F.count_if(F.col("support") >= 0.8).alias("at_least_four_fifths")
    )
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    named = [F.round(q, 6).alias(n) for q, n in zip(parts, ("p25", "median", "p75"), strict=True)]
    return counts.join(quartiles, on, "left").select(*by, "claims", "mean", "low", *named, "high", "at_least_half", "at_least_four_fifths")


def replicated(rows: DataFrame, copies: int) -> DataFrame:
    """Every row ``copies`` times, under ids of its own, from the same family."""
    out = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return out.withColumns({"evidence_id": F.concat_ws("-", "evidence_id", "_copy"), "doc_id": F.col("doc_id") * copies + F.col("_copy")}).drop("_copy")


def replication_pressure(rows: DataFrame, copies: tuple[int, ...] = (1, 2, 3), budget: int = 2) -> DataFrame:
    """Mean support by families, which copies cannot move, and by documents, which they inflate."""
    out = None
    for k in copies:
        more = replicated(rows, k)
        both = capped_support(more, budget).select("claim_id", F.col("support").alias("f")).join(capped_support(more, budget, "doc_id").select("claim_id", F.col("support").alias("d")), "claim_id")
        one = both.agg(F.lit(k).alias("copies"), F.round(F.avg("f"), 6).alias("by_family"), F.round(F.avg("d"), 6).alias("by_document"), F.count_if(F.col("d") > F.col("f")).alias("inflated"))
        out = one if out is None else out.unionByName(one)
    return out


def family_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("family_id").agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("docs"), F.countDistinct("claim_id").alias("claims"))


def multi_document_audit(rows: DataFrame) -> DataFrame:
    """Claims in several documents, split by whether several families stand behind them."""
    per = rows.groupBy("claim_id").agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("family_id").alias("families")).where("docs >= 2")
    return per.groupBy((F.col("families") >= 2).alias("independent")).agg(F.count("*").alias("claims"), F.sum("docs").cast("long").alias("docs"))
