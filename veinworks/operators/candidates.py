"""Validation of extracted candidates as one plan: directions, types, spans or table cells, entailment and the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinworks.functions.patterns import ascii_edges
from veinworks.operators.gates import LEVEL_WEIGHTS, weight
from veinworks.operators.identity import normalised
from veinworks.operators.validation import located, redirected, typed


def _yes(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _holds(text: Column, surface: Column) -> Column:
    return _yes((F.trim(surface) != "") & F.contains(normalised(text), normalised(surface)))


def span_levels(rows: DataFrame, furthest: int = 700) -> DataFrame:
    """Add ``level`` and ``span_reasons`` (empty: the span is valid) for rows (text, evidence, head, tail).

    A quote found in the text is E1 and has to hold both surfaces. A quote that isn't there is replaced by the stretch between
    both surfaces, E3, if that has at most ``furthest`` characters. A quote with an ellipsis and an empty text have no level.
    """
    head, tail = located(F.col("text"), F.col("head")), located(F.col("text"), F.col("tail"))
    reach = F.greatest(head["start"] + F.char_length("head"), tail["start"] + F.char_length("tail")) - F.least(head["start"], tail["start"])
    blank = ~_yes(F.trim("text") != "")
    cut = _yes(F.contains(F.col("evidence"), F.lit("...")) | F.contains(F.col("evidence"), F.lit("…")))
    direct = _yes(F.trim("evidence") != "") & _yes(located(F.col("text"), F.col("evidence")).isNotNull())
    both = head.isNotNull() & tail.isNotNull()
    level = F.when(blank | cut, None).when(direct, "E1").when(both, "E3")
    lacking = lambda where, at: F.array_compact(F.array(*(F.when(~at(s), f"{s}_not_{where}") for s in ("head", "tail"))))
    reasons = (
        F.when(blank, F.array(F.lit("text_missing")))
        .when(cut, F.array(F.lit("quote_with_ellipsis")))
        .when(direct, lacking("in_quote", lambda s: _holds(F.col("evidence"), F.col(s))))
        .when(~both, lacking("in_text", lambda s: {"head": head, "tail": tail}[s].isNotNull()))
        .when(reach > furthest, F.array(F.lit("surfaces_too_far_apart")))
        .otherwise(F.array().cast("array<string>"))
    )
    return rows.withColumns({"level": level, "span_reasons": reasons})


def aligned(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Per candidate with cells: candidate_id, ``method`` and ``cell_reasons`` (empty: aligned), head_in_cell, tail_in_cell, boxed.

    ``rows`` (candidate_id, text, head, tail, checked); ``cells`` (candidate_id, table_id, row_id, column_name, group_id, start, end,
    cell, has_box). All cells have to lie in one table and in one row or one group of merged rows, and each needs offsets at which the text
    reads the same, or a box. Everything is a sum, least or greatest value. Files of repeated words are far smaller than
    their rows, so cells and candidates are shuffled, whatever Spark takes their sizes for.
    """
    met = cells.join(rows.select("candidate_id", "text", "head", "tail", "checked").hint("merge"), "candidate_id")
    given = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c))
    placed = _yes((F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.char_length("text")))
    same = _yes(F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("cell"))
    boxed = ~placed & _yes(F.col("has_box")) & _yes(F.trim("cell") != "")
    lowest_and_highest = [f(given(c)).alias(f"{n}_{c}") for c in ("table_id", "row_id", "group_id") for n, f in (("low", F.min), ("high", F.max))]
    per = met.groupBy("candidate_id").agg(
        *lowest_and_highest,
        *(F.count_if(given(c).isNull()).alias(f"no_{c}") for c in ("table_id", "row_id", "column_name", "group_id")),
        F.count_if(placed & ~same).alias("moved"),
        F.count_if(~placed & ~boxed).alias("nowhere"),
        F.count_if(boxed).alias("boxed"),
        F.bool_or(_holds(F.col("cell"), F.col("head"))).alias("head_in_cell"),
        F.bool_or(_holds(F.col("cell"), F.col("tail"))).alias("tail_in_cell"),
        F.bool_and(_yes(F.col("checked"))).alias("checked"),
    )
    one_row = _yes(F.col("low_row_id") == F.col("high_row_id"))
    one_group = _yes(F.col("low_group_id") == F.col("high_group_id")) & (F.col("no_group_id") == 0)
    tests = {
        "layout_not_checked": ~F.col("checked"),
        "table_id_missing": F.col("no_table_id") > 0,
        "row_id_missing": F.col("no_row_id") > 0,
        "column_name_missing": F.col("no_column_name") > 0,
        "several_tables": _yes(F.col("low_table_id") < F.col("high_table_id")),
        "several_rows": ~one_row & ~one_group,
        "cell_text_differs": F.col("moved") > 0,
        "cell_without_place": F.col("nowhere") > 0,
        "head_not_in_cells": ~F.col("head_in_cell"),
        "tail_not_in_cells": ~F.col("tail_in_cell"),
    }
    method = F.when(one_row, "row").when(one_group, "merged_rows").otherwise("unaligned")
    return per.select("candidate_id", method.alias("method"), F.array_compact(F.array(*(F.when(t, n) for n, t in tests.items()))).alias("cell_reasons"), "head_in_cell", "tail_in_cell", "boxed")


def entailment(cues: dict[str, str]) -> Column:
    """The status of a row (level, relation, structured, evidence, surfaces_held): entailed, undetermined or not_entailed.

    E1 needs a cue of its relation in the quote, E2 the relation that its table declares; E3 is never decided.
    """
    cue = F.lit(False)
    for relation, pattern in cues.items():
        cue = cue | (_yes(F.col("relation") == relation) & _yes(F.col("evidence").rlike(f"(?i){ascii_edges(pattern)}")))
    declared = F.coalesce("structured", F.lit(""))
    by_table = F.when(_yes(declared == F.col("relation")) & (declared != ""), "entailed").when(declared != "", "not_entailed").otherwise("undetermined")
    return (
        F.when(F.col("level").isNull() | ~_yes(F.col("surfaces_held")), "not_entailed")
        .when(F.col("level") == "E3", "undetermined")
        .when(F.col("level") == "E2", by_table)
        .otherwise(F.when(cue, "entailed").otherwise("undetermined"))
    )


def validated(rows: DataFrame, cells: DataFrame, constraints: DataFrame, rules: list[tuple[str, str, str, str, bool]], cues: dict[str, str], silver: float = 0.8, review: float = 0.6) -> DataFrame:
    """Candidates with head, relation and tail as rewritten, level, status, final confidence, decision and all reasons.

    ``rows``: candidate_id, head, head_type, relation, tail, tail_type, text, evidence, structured, checked, split, inferred, confidence.
    A candidate with cells is judged by them alone (E2). A fatal reason rejects; a veto keeps a candidate from silver.
    """
    turned = redirected(rows, rules)
    checked = typed(turned, constraints).withColumnRenamed("reasons", "type_reasons")
    spans = span_levels(checked).join(aligned(turned, cells).hint("merge"), "candidate_id", "left")
    by_cells = F.col("method").isNotNull()
    held = F.when(by_cells, F.col("head_in_cell") & F.col("tail_in_cell"))
    held = held.when(F.col("level") == "E3", True).otherwise(_holds(F.col("evidence"), F.col("head")) & _holds(F.col("evidence"), F.col("tail")))
    found = spans.withColumn("surfaces_held", held).withColumns({"level": F.when(by_cells, "E2").otherwise(F.col("level")), "place_reasons": F.when(by_cells, F.col("cell_reasons")).otherwise(F.col("span_reasons"))})
    found = found.withColumn("status", entailment(cues))
    confidence = F.when(F.isnan("confidence") | F.col("confidence").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))
    by_status = F.when(F.col("status") == "entailed", 1.0).when(F.col("status") == "undetermined", 0.75).otherwise(0.0)
    found = found.withColumn("final", F.round(confidence * F.coalesce(weight(F.col("level"), LEVEL_WEIGHTS), F.lit(0.0)) * by_status, 6))
    fatal = {
        "relation_type_invalid": F.size("type_reasons") > 0,
        "evidence_invalid": F.size("place_reasons") > 0,
        "relation_not_entailed": F.col("status") == "not_entailed",
    }
    vetoes = {
        "entailment_undetermined": F.col("status") == "undetermined",
        "level_not_automatic": _yes(F.col("level") == "E3"),
        "inferred": F.coalesce("inferred", F.lit(True)),
        "held_out": ~_yes(F.col("split") != "held_out_test"),
    }
    listed = lambda tests: F.array_compact(F.array(*(F.when(t, n) for n, t in tests.items())))
    found = found.withColumns({"_fatal": listed(fatal), "_vetoes": listed(vetoes)})
    decision = F.when(F.size("_fatal") > 0, "rejected").when((F.col("final") >= silver) & (F.size("_vetoes") == 0), "silver").when(F.col("final") >= review, "review").otherwise("rejected")
    low = F.when((F.size("_fatal") == 0) & (F.col("final") < review), F.array(F.lit("confidence_too_low"))).otherwise(F.array().cast("array<string>"))
    reasons = F.concat("_fatal", "_vetoes", low, "type_reasons", "place_reasons")
    return found.select("candidate_id", "head", "relation", "tail", "level", "method", "status", "final", decision.alias("decision"), reasons.alias("reasons"))
