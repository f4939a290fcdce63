"""Choosing and judging records: page heuristics, protected words, column roles, tolerant JSON, spans of two judges, quotas and blockers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinworks.functions.patterns import ascii_edges

#: What marks a page as marketing, and the words of technical pages.
MARKETING = ("all rights reserved", "contact us", "www.", "copyright")
TECHNICAL = "pump|impeller|seal|bearing|motor|valve|pipe|failure|fault|damage|inspect|maintenance|repair|replace|leak|vibration|noise|temperature|cavitat"

#: Column roles by the words in a column's name; the first that fits counts.
COLUMN_ROLES = {"cause": ("cause", "reason"), "fault": ("fault", "failure", "problem"), "action": ("remedy", "action", "repair"), "method": ("inspect", "check")}


def is_contents(text: Column) -> Column:
    """Whether a page is a table of contents: it says so, or a quarter of its lines (five or more) end in dots and a number."""
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: x.rlike(r"\S"))
    dotted = F.filter(lines, lambda x: x.rlike(r"\.{4,}\s*\d+\s*$"))
    says = F.lower(text).rlike(r"(?m)table of contents|^\s*contents\s*$")
    return F.coalesce(says | ((F.size(lines) >= 5) & (F.size(dotted) >= 0.25 * F.size(lines))), F.lit(False))


def is_low_value(text: Column) -> Column:
    """Whether a page has under 80 characters, or two marketing terms and no technical word; a null page is of low value."""
    low = F.lower(F.trim(text))
    terms = sum((F.contains(low, F.lit(t)).cast("int") for t in MARKETING), F.lit(0))
    return F.coalesce((F.char_length(low) < 80) | ((terms >= 2) & ~low.rlike(ascii_edges(rf"\b({TECHNICAL})\w*\b"))), F.lit(True))


def protected(surface: Column, patterns: list[str]) -> Column:
    """The distinct matches of all patterns, lower case, in order."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*(F.coalesce(F.regexp_extract_all(F.lower(surface), F.lit(f"({ascii_edges(p)})"), F.lit(1)), empty) for p in patterns)))


def unprotected(surface: Column, label: Column, patterns: list[str]) -> Column:
    """The protected words of a surface that its label lost."""
    return F.filter(protected(surface, patterns), lambda t: ~F.coalesce(F.contains(F.lower(label), t), F.lit(False)))


def column_role(name: Column, roles: dict[str, tuple[str, ...]] = COLUMN_ROLES) -> Column:
    even = F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))
    found = F.lit(None).cast("string")
    for role, words in reversed(roles.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(even, F.lit(w))
        found = F.when(hit, role).otherwise(found)
    return F.coalesce(found, F.lit("unclassified"))


def row_relations(cells: DataFrame) -> DataFrame:
    """(row_id, relation) of table rows (row_id, role): a cause and a fault, a fault and an action, or neither (null)."""
    has = lambda role: F.bool_or(F.col("role") == role)
    relation = F.when(has("cause") & has("fault"), "causes").when(has("fault") & has("action"), "mitigated_by")
    return cells.groupBy("row_id").agg(relation.alias("relation"))


def json_of(response: Column) -> Column:
    """From the first opening to the last closing brace, so code fences and talk around an object do no harm; null without one."""
    return F.regexp_substr(response, F.lit(r"(?s)\{.*\}"))


def first_number(json: Column, *aliases: str) -> Column:
    """The first of several fields that is a number."""
    return F.coalesce(*(F.get_json_object(json, f"$.{a}").try_cast("double") for a in aliases))


def spans_verified(spans: DataFrame, evidence: DataFrame, least: int = 4) -> DataFrame:
    """(item_id, judge, verified): whether all spans (item_id, judge, evidence_id, quote) stand in their own evidence (item_id, evidence_id, text).

    White space and table rules don't count; a quote needs ``least`` other characters.
    """
    bare = lambda c: F.regexp_replace(c, r"[\s│┃|]+", "")
    met = spans.join(evidence, ["item_id", "evidence_id"], "left")
    ok = F.coalesce((F.char_length(bare("quote")) >= least) & F.contains(bare(F.col("text")), bare(F.col("quote"))), F.lit(False))
    return met.groupBy("item_id", "judge").agg(F.bool_and(ok).alias("verified"))


def judged(items: DataFrame, verified: DataFrame) -> DataFrame:
    """Per method: support rates of points and summaries, agreement, and answers all of whose items, or points, are supported.

    ``items``: item_id, answer_id, method, kind, verdict_a, verdict_b, answered. Both judges must support an item with verified spans.
    """
    per = verified.groupBy("item_id").agg(*(F.bool_or((F.col("judge") == j) & F.col("verified")).alias(f"quoted_{j}") for j in "ab"))
    both = F.col("quoted_a") & F.col("quoted_b")
    told = items.join(per, "item_id", "left").na.fill(False, ["quoted_a", "quoted_b"])
    told = told.withColumns({"quoted": both, "strict": F.coalesce((F.col("verdict_a") == "supported") & (F.col("verdict_b") == "supported"), F.lit(False)) & both, "agree": F.col("verdict_a").eqNullSafe(F.col("verdict_b"))})
    point = F.col("kind") == "answer_point"
    answers = told.groupBy("method", "answer_id").agg(
        F.bool_or("answered").alias("answered"), F.bool_and("strict").alias("all_items"), F.coalesce(F.bool_and(F.when(point, F.col("strict"))), F.lit(False)).alias("all_points"),
        F.count("*").alias("items"), F.count_if(point).alias("points"), F.count_if(point & F.col("strict")).alias("strict_points"), F.count_if(~point & F.col("strict")).alias("strict_summaries"), F.count_if("agree").alias("agree"), F.count_if("quoted").alias("quoted"),
    )
    rate = lambda top, over: F.round(F.try_divide(top, over), 6)
    items_, points, answered = F.sum("items"), F.sum("points"), F.count_if("answered")
    return answers.groupBy("method").agg(
        F.count("*").alias("answers"),
        rate(F.sum("strict_points"), points).alias("point_support"),
        rate(F.sum("strict_summaries"), items_ - points).alias("summary_support"),
        rate(F.sum("agree"), items_).alias("agreement"),
        rate(F.sum("quoted"), items_).alias("quoted"),
        rate(F.count_if(F.col("answered") & F.col("all_items")), answered).alias("answers_supported"),
        rate(F.count_if(F.col("answered") & F.col("all_points")), answered).alias("answers_with_supported_points"),
    )


def quota_pool(records: DataFrame, size: int) -> DataFrame:
    """``size`` pages of ``records`` (page, stratum; a row each): for each stratum in turn the page of most records not yet taken, then the fullest others.

    Of S strata at most S - 1 pages are taken before a stratum's turn, so its S best pages suffice; the last step sees S * S + S + size rows.
    """
    totals = records.groupBy("page").agg(F.count("*").alias("n"))
    best = (F.desc("n"), "page")
    pairs = records.select("page", "stratum").distinct().join(totals, "page")
    strata = records.select("stratum").distinct().count()
    few = pairs.withColumn("_k", F.row_number().over(Window.partitionBy("stratum").orderBy(*best))).where(F.col("_k") <= max(strata, 1)).drop("_k")
    fill = totals.orderBy(*best).limit(size + strata).select("page", F.lit(None).cast(records.schema["stratum"].dataType).alias("stratum"), "n")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: list = []
        pdf = pdf.sort_values(["n", "page"], ascending=[False, True])
        for _, rows in pdf[pdf.stratum.notna()].groupby("stratum", sort=True):
            taken += [p for p in rows.page if p not in taken][:1]
        taken += [p for p in pdf[pdf.stratum.isna()].page if p not in taken]
        return pd.DataFrame({"position": range(1, min(size, len(taken)) + 1), "page": taken[:size]})

    return few.unionByName(fill).withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(choose, f"position long, page {records.schema['page'].dataType.simpleString()}")


def blockers(records: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per failed task (fault_id, role, gap), the records of fewest blocked ends that close the gap, in order; ``closed`` tells whether they do.

    ``records``: fault_id, role, record_id, blocked, units; those with nothing blocked don't help. A record brings a unit or more, so a
    task needs at most ``gap`` of them.
    """
    met = records.where("blocked > 0 and units > 0").join(F.broadcast(gaps.where("gap > 0")), ["fault_id", "role"])  # a task list
    order = Window.partitionBy("fault_id", "role").orderBy("blocked", "record_id")
    first = met.withColumn("position", F.row_number().over(order)).where(F.col("position") <= F.col("gap"))
    before = F.coalesce(F.sum("units").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    task = Window.partitionBy("fault_id", "role")
    return first.withColumn("_before", before).where("_before < gap").withColumn("closed", F.sum("units").over(task) >= F.col("gap")).select("fault_id", "role", "position", "record_id", "closed")


def dangling(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(side, node): ends of ``edges`` (a, b) that ``vertices`` (node) lacks, and vertices without edges (side ``alone``), once each."""
    nodes = vertices.select("node").distinct()
    ends = edges.select(F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("node")) for s in "ab"))).alias("_e")).select("_e.*").distinct()
    alone = nodes.join(ends.select("node").distinct(), "node", "left_anti").select(F.lit("alone").alias("side"), "node")
    return ends.join(nodes, "node", "left_anti").select("side", "node").unionByName(alone)
