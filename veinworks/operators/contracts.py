"""Records of any shape held against a contract, and repairs that apply only to what they expect."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The decisions and levels that a record may carry, and the reasons against one.
DECISIONS = ("silver_candidate", "accepted_silver", "candidate_needs_review", "rejected")
LEVELS = ("E1", "E2", "E3")
REQUIRED = ("head", "relation", "tail", "evidence_level")
#: What E1 evidence (a text span) and E2 evidence (table cells) bring; one must not bring the other's.
SPAN, CELLS = "$.evidence_text", "$.evidence_units"


def _text(record: Column, path: str) -> Column:
    """A field's text, without outer white space; null where it is missing, empty or not plain."""
    value, kind = F.trim(F.try_variant_get(record, path, "string")), F.coalesce(_kind(record, path), F.lit(""))
    return F.when((value != "") & ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), value)


def _kind(record: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(record, path, "variant"))


def normalised(lines: DataFrame, line: str = "line") -> DataFrame:
    """The columns of ``lines``, the fields of the contract, and ``reasons`` (empty for a valid record).

    Each line is read once as VARIANT, so its shape doesn't matter: a record may have the names ``subject`` and ``object``
    for head and tail, its confidence may be text, and units may be one object instead of a list.
    """
    rows = lines.withColumn("_v", F.try_parse_json(line))
    v = F.col("_v")
    head, tail = F.coalesce(_text(v, "$.head"), _text(v, "$.subject")), F.coalesce(_text(v, "$.tail"), _text(v, "$.object"))
    relation = F.lower(F.regexp_replace(_text(v, "$.relation"), r"[\s-]+", "_"))
    level, decision = F.upper(_text(v, "$.evidence_level")), F.coalesce(F.lower(_text(v, "$.decision")), F.lit("candidate_needs_review"))
    confidence = F.coalesce(F.try_variant_get(v, "$.confidence", "double"), F.expr("try_cast(try_variant_get(_v, '$.confidence', 'string') AS double)"))
    span = _text(v, SPAN)
    kind = _kind(v, CELLS)
    units = F.when(kind.startswith("ARRAY"), F.size(F.try_variant_get(v, CELLS, "array<variant>"))).when(kind.startswith("OBJECT"), 1).otherwise(0)
    fields = rows.select(*lines.columns, "_v", head.alias("head"), relation.alias("relation"), tail.alias("tail"), level.alias("evidence_level"), decision.alias("decision"), confidence.alias("confidence"), span.alias("evidence_text"), units.alias("units"))
    unread = F.col("_v").isNull() | ~F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    missing = [F.when(F.col(c).isNull(), f"missing_{c}") for c in REQUIRED]
    told = [
        F.when(F.col("evidence_level").isNotNull() & ~F.col("evidence_level").isin(*LEVELS), "unknown_evidence_level"),
        F.when(~F.col("decision").isin(*DECISIONS), "unknown_decision"),
        F.when(F.col("confidence").isNull() | ~F.col("confidence").between(0.0, 1.0), "confidence_out_of_range"),
        F.when((F.col("evidence_level") == "E1") & F.col("evidence_text").isNull(), "e1_without_span"),
        F.when((F.col("evidence_level") == "E1") & (F.col("units") > 0), "e1_with_units"),
        F.when((F.col("evidence_level") == "E2") & (F.col("units") < 2), "e2_without_units"),
        F.when((F.col("evidence_level") == "E2") & F.col("evidence_text").isNotNull(), "e2_with_span"),
    ]
    reasons = F.when(unread, F.array(F.lit("not_an_object"))).otherwise(F.array_compact(F.array(*missing, *told)))
    return fields.withColumn("reasons", reasons).drop("_v")


def repaired(records: DataFrame, patches: DataFrame, key: str, fields: Mapping[str, str], order: tuple[str, ...] = ("patch_id",)) -> tuple[DataFrame, DataFrame]:
    """Records after compare-and-set, and what became of each patch: patch_id, key and outcome.

    A patch names a record by ``key``; for each field of ``fields`` (name: type) it holds ``expected_<name>`` and
    ``new_<name>``. It applies where all expected values equal the record's (nulls together), so running a repair twice
    changes nothing more. Of several that apply the first by ``order`` wins; the others are ``superseded``. Others are
    ``refused`` (values differ) or ``unmatched`` (no such record).
    """
    sides = patches.select("patch_id", *(c for c in order if c != "patch_id"), F.col(key).alias("_key"), *(f"{s}_{f}" for f in fields for s in ("expected", "new")))
    held = records.select(F.col(key).alias("_key"), *(F.col(f).alias(f"_is_{f}") for f in fields)).withColumn("_there", F.lit(True))
    fits = F.lit(True)
    for f, kind in fields.items():
        fits = fits & F.col(f"_is_{f}").eqNullSafe(F.col(f"expected_{f}").cast(kind))
    met = sides.join(held, "_key", "left").withColumn("_fits", F.coalesce(F.col("_there"), F.lit(False)) & fits)
    place = F.row_number().over(Window.partitionBy("_key", "_fits").orderBy(*order))
    judged = met.withColumn("_place", place)
    outcome = F.when(F.col("_there").isNull(), "unmatched").when(~F.col("_fits"), "refused").when(F.col("_place") > 1, "superseded").otherwise("applied")
    told = judged.withColumn("outcome", outcome)
    winners = told.where("outcome = 'applied'").select(F.col("_key"), F.lit(True).alias("_won"), *(F.col(f"new_{f}").cast(kind).alias(f"_new_{f}") for f, kind in fields.items()))
    joined = records.join(winners, records[key] == winners["_key"], "left")
    values = [F.when(F.col("_won"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in records.columns]
    return joined.select(*values, F.coalesce("_won", F.lit(False)).alias("repaired")), told.select("patch_id", F.col("_key").alias(key), "outcome")
