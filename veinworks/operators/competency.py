"""Competency questions: answers on legal paths with all that supports them, outcomes of tasks, and traceability ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Why a task isn't answerable.
NO_PATH, NO_EVIDENCE, TOO_FEW = "no_legal_semantic_path", "no_traceable_release_evidence", "below_minimum_answer_count"

TASK = ("fault_id", "role")


def answers(paths: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per task (fault_id, role) and answer: whether it is traceable, and the sorted claim_ids, evidence_ids, doc_ids, family_ids and path_ids behind it.

    ``paths`` holds the claims on legal paths: fault_id, role, path_id, claim_id, answer_id. ``evidence`` holds claim_id,
    evidence_id, doc_id, family_id and ``released``; only released evidence supports an answer, and paths without any
    leave a semantic answer that isn't traceable. Repeated rows count once, since sets are collected.
    """
    good = evidence.where(F.coalesce("released", F.lit(False))).select("claim_id", "evidence_id", "doc_id", "family_id").distinct()
    met = paths.select(*TASK, "path_id", "claim_id", "answer_id").distinct().join(good.withColumn("_held", F.lit(True)), "claim_id", "left")
    held = F.col("_held").isNotNull()
    sets = [F.array_sort(F.collect_set(F.when(held, F.col(f"{c}_id")))).alias(f"{c}_ids") for c in ("claim", "evidence", "doc", "family", "path")]
    return met.groupBy(*TASK, "answer_id").agg(F.bool_or(held).alias("traceable"), *sets)


def outcomes(tasks: DataFrame, found: DataFrame, least: int = 1) -> DataFrame:
    """Per task of ``tasks``: semantic and traceable answers, distinct claims, evidence, documents, families and paths, and the outcome (null: answerable)."""
    sizes = found.groupBy(*TASK).agg(F.count("*").alias("semantic_answers"), F.count_if("traceable").alias("answers"))
    told = tasks.select(*TASK).join(sizes, list(TASK), "left")
    for c in ("claim", "evidence", "doc", "family", "path"):
        per = found.select(*TASK, F.explode(f"{c}_ids").alias("_x")).groupBy(*TASK).agg(F.countDistinct("_x").alias(f"{c}s"))
        told = told.join(per, list(TASK), "left")
    filled = told.na.fill(0)
    reason = F.when(F.col("semantic_answers") == 0, NO_PATH).when(F.col("answers") == 0, NO_EVIDENCE).when(F.col("answers") < least, TOO_FEW)
    return filled.withColumn("reason", reason)


def traceability(found: DataFrame, evidence: DataFrame, provenance: tuple[str, ...]) -> DataFrame:
    """Three ratios (population, satisfied, ratio): semantic answers that are traceable, used evidence whose ``provenance`` columns are all filled, and traceable answers with a document and a family."""
    first = found.agg(F.count("*").alias("population"), F.count_if("traceable").alias("satisfied")).withColumn("measure", F.lit("answers_with_evidence"))
    used = found.select(F.explode("evidence_ids").alias("evidence_id")).distinct()
    filled = F.lit(True)
    for c in provenance:
        filled = filled & F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    second = evidence.join(used, "evidence_id", "left_semi").groupBy("evidence_id").agg(F.bool_and(filled).alias("_ok")).agg(F.count("*").alias("population"), F.count_if("_ok").alias("satisfied")).withColumn("measure", F.lit("evidence_with_provenance"))
    whole = (F.size("doc_ids") > 0) & (F.size("family_ids") > 0)
    third = found.where("traceable").agg(F.count("*").alias("population"), F.count_if(whole).alias("satisfied")).withColumn("measure", F.lit("answers_with_documents"))
    rows = first.unionByName(second).unionByName(third)
    return rows.select("measure", "population", "satisfied", F.round(F.coalesce(F.try_divide("satisfied", "population"), F.lit(0.0)), 6).alias("ratio"))
