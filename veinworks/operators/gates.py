"""Gates: predicates with reasons, confidence decisions, cumulative stages, funnels and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinworks.operators.support import LEVEL_WEIGHTS, STATUS_WEIGHTS, weight

#: Reasons for which a row is not eligible, in the order in which they are listed.
REASONS = {
    "not_build_split": "split <> 'build_train'",
    "inferred": "inferred",
    "level_not_direct": "level NOT IN ('E1', 'E2')",
    "not_entailed": "status <> 'entailed'",
    "low_confidence": "confidence < 0.93",
    "no_family": "family_id IS NULL",
}
#: All reasons against a record's release, in order, as predicates of its columns; ``frozen`` tells whether its document is of the build set.
RELEASE_REASONS = {
    "decision_not_silver": "decision NOT IN ('silver_candidate', 'accepted_silver')",
    "document_split_not_build_train": "split <> 'build_train'",
    "doc_id_not_frozen_build_set": "NOT frozen",
    "evidence_level_not_e1_e2": "level NOT IN ('E1', 'E2')",
    "inferred_edge": "coalesce(inferred, false)",
    "missing_claim_id": "coalesce(trim(claim_id), '') = ''",
    "missing_doc_id": "coalesce(trim(doc_id), '') = ''",
    "missing_source_family_id": "coalesce(trim(family_id), '') = ''",
    "relation_type_invalid": "NOT relation_type_valid",
    "relation_entailment_not_entailed": "status <> 'entailed'",
    "evidence_invalid": "NOT evidence_valid",
    "evidence_not_silver_eligible": "NOT evidence_silver",
    "entailment_not_silver_eligible": "NOT entailment_silver",
    "heuristic_score_below_minimum": "q < {minimum}",
}
#: The gates of the stages, each on top of those before it.
STAGES = {
    "B0": "true",
    "B1": "NOT inferred",
    "B2": "level IN ('E1', 'E2')",
    "B3": "status = 'entailed'",
    "Ours": "split = 'build_train' AND q >= 0.93",
}


def with_reasons(rows: DataFrame, reasons: dict[str, str] = REASONS) -> DataFrame:
    """Add ``reasons``, the names of all failed predicates in order; a row without any is eligible. A predicate that is null fails."""
    return rows.withColumn("reasons", F.array_compact(F.array(*(F.when(F.coalesce(F.expr(test), F.lit(True)), name) for name, test in reasons.items()))))


def release_reasons(rows: DataFrame, build_docs: DataFrame, minimum: float) -> DataFrame:
    """Add ``reasons`` by RELEASE_REASONS; ``build_docs`` (doc_id) are the documents of the frozen build set. A predicate that is null fails."""
    known = build_docs.select(F.col("doc_id").cast("string").alias("_doc")).distinct().withColumn("_frozen", F.lit(True))
    texts = rows.withColumns({c: F.col(c).cast("string") for c in ("claim_id", "doc_id", "family_id")})
    joined = texts.join(known, texts["doc_id"] == known["_doc"], "left").withColumn("frozen", F.coalesce("_frozen", F.lit(False)))
    return with_reasons(joined, {n: t.format(minimum=minimum) for n, t in RELEASE_REASONS.items()}).drop("_doc", "_frozen", "frozen")


def released(*ids: str) -> Column:
    """Whether a row is direct, entailed build-split evidence of the first two levels whose ids aren't blank; null is no."""
    named = F.lit(True)
    for i in ids:
        named = named & (F.trim(F.col(i).cast("string")) != "")
    return F.coalesce(F.expr("split = 'build_train' AND level IN ('E1', 'E2') AND NOT inferred AND status = 'entailed'") & named, F.lit(False))


def exclusions(rows: DataFrame, reasons: dict[str, str] = REASONS) -> DataFrame:
    """How many rows each reason excludes, and how many it alone excludes."""
    told = with_reasons(rows, reasons)
    return told.select(F.explode("reasons").alias("reason"), (F.size("reasons") == 1).alias("alone")).groupBy("reason").agg(F.count("*").alias("rows"), F.count_if(F.col("alone")).alias("alone"))


def decided(rows: DataFrame, veto: Column | None = None) -> DataFrame:
    """Add structural and final confidence and the decision: silver, review or rejected."""
    structural = F.round(F.col("confidence") * weight(F.col("level"), LEVEL_WEIGHTS), 3)
    final = F.round(F.col("structural") * weight(F.col("status"), STATUS_WEIGHTS), 3)
    veto = F.col("inferred") if veto is None else veto
    decision = F.when((F.col("final") >= 0.8) & ~veto, "silver").when((F.col("final") >= 0.6) | veto & (F.col("structural") >= 0.6), "review").otherwise("rejected")
    return rows.withColumn("structural", structural).withColumn("final", final).withColumn("decision", decision)


def with_stages(rows: DataFrame, stages: dict[str, str] = STAGES) -> DataFrame:
    """Add a boolean for each stage: whether its gate and all before it hold."""
    so_far = F.lit(True)
    flags = {}
    for name, test in stages.items():
        so_far = so_far & F.coalesce(F.expr(test), F.lit(False))
        flags[name] = so_far
    return rows.withColumns(flags)


def _reached(rows: DataFrame, depth: Column, steps: int, **keys: str) -> DataFrame:
    """(step, rows, <keys>): rows of at least each depth from 1 to ``steps``, and the distinct values of each key among them; ``total`` counts all rows.

    A key's value counts at every step up to its greatest depth, so rows are reduced to that before the shuffle: nothing is
    counted distinctly, and a key is shuffled once whatever the number of steps.
    """
    kinds = [F.struct(F.lit(name).alias("kind"), F.col(key).cast("string").alias("key")) for name, key in keys.items()]
    each = rows.withColumn("_depth", depth).select("_depth", F.inline(F.array(F.struct(F.lit("rows").alias("kind"), F.col("_depth").cast("string").alias("key")), *kinds)))
    most = each.where("key IS NOT NULL").groupBy("kind", "key").agg(F.max("_depth").alias("depth"), F.count("*").alias("n"))
    counts = most.groupBy("kind", "depth").agg(F.count("*").alias("keys"), F.sum("n").alias("n"))
    sums = counts.agg(*(F.coalesce(F.sum(F.when((F.col("kind") == k) & (F.col("depth") >= i), F.col("n" if k == "rows" else "keys"))), F.lit(0)).alias(f"{k}_{i}") for i in range(steps + 1) for k in ("rows", *keys)))
    table = F.array(*(F.struct(F.lit(i).alias("step"), F.col("rows_0").alias("total"), *(F.col(f"{k}_{i}").alias(k) for k in ("rows", *keys))) for i in range(1, steps + 1)))
    return sums.select(F.inline(table))


def stage_table(rows: DataFrame, stages: dict[str, str] = STAGES) -> DataFrame:
    """One row per stage that rows reach, from one pass: rows kept, retention, and distinct claims, documents and families."""
    names = list(stages)
    depth = sum((F.col(s).cast("int") for s in names), F.lit(0))
    found = _reached(with_stages(rows, stages), depth, len(names), claims="claim_id", docs="doc_id", families="family_id").where("rows > 0")
    return found.select(F.get(F.array(*map(F.lit, names)), F.col("step") - 1).alias("stage"), "rows", F.round(F.col("rows") / F.col("total"), 6).alias("retention"), "claims", "docs", "families")


def funnel(rows: DataFrame, stages: dict[str, str] = STAGES) -> DataFrame:
    """Rows into and out of each gate."""
    names = list(stages)
    counts = with_stages(rows, stages).agg(*(F.count_if(F.col(s)).alias(s) for s in names))
    steps = F.array(*(F.struct(F.lit(b).alias("gate"), F.col(a).alias("rows_in"), F.col(b).alias("rows_out"), (F.col(a) - F.col(b)).alias("removed")) for a, b in zip(names, names[1:], strict=False)))
    return counts.select(F.explode(steps).alias("_s")).select("_s.*").withColumn("rate", F.round(F.coalesce(F.try_divide("removed", "rows_in"), F.lit(0.0)), 6))


def threshold_sensitivity(rows: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """Rows, claims and documents at or above each threshold of ``q`` that any row reaches."""
    ordered = sorted(thresholds)
    depth = sum((F.coalesce(F.col("q") >= t, F.lit(False)).cast("int") for t in ordered), F.lit(0))
    found = _reached(rows, depth, len(ordered), claims="claim_id", docs="doc_id").where("rows > 0")
    return found.select(F.get(F.array(*map(F.lit, ordered)), F.col("step") - 1).alias("threshold"), "rows", "claims", "docs")


def coverage(rows: DataFrame, units: int, docs: int, families: int) -> DataFrame:
    """Per fault and role: distinct units, documents and families, what is missing, and whether all targets are met."""
    per = rows.groupBy("fault_id", "role").agg(F.countDistinct("claim_id").alias("units"), F.countDistinct("doc_id").alias("docs"), F.countDistinct("family_id").alias("families"))
    gap = lambda name, target: F.greatest(F.lit(0).cast("long"), F.lit(target) - F.col(name))
    return per.withColumns({"units_missing": gap("units", units), "docs_missing": gap("docs", docs), "families_missing": gap("families", families), "passes": (F.col("units") >= units) & (F.col("docs") >= docs) & (F.col("families") >= families)})


def split_audit(rows: DataFrame, allowed: str = "build_train") -> DataFrame:
    """Rows by family and whether their split is the allowed one, another known one, or unexpected."""
    kind = F.when(F.col("split") == allowed, "eligible").when(F.col("split").isin("development", "held_out_test"), "contaminated").otherwise("unexpected")
    return rows.groupBy("family_id", kind.alias("kind")).agg(F.count("*").alias("rows"))


def adjudicated(votes: DataFrame) -> DataFrame:
    """Two judges' votes (record_id, judge, vote, confidence) pivoted and decided: silver, rejected or unresolved."""
    wide = votes.groupBy("record_id").pivot("judge", ["A", "B"]).agg(F.first("vote").alias("vote"), F.first("confidence").alias("confidence"))
    sure = F.least("A_confidence", "B_confidence") >= 0.9
    return wide.withColumn("decision", F.when((F.col("A_vote") == 1) & (F.col("B_vote") == 1) & sure, "silver").when((F.col("A_vote") == 0) & (F.col("B_vote") == 0) & sure, "rejected").otherwise("unresolved"))
