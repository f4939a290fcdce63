"""The pool of candidate pages: matched by BM25, checked, scored, capped, given their neighbours, and accepted in order of score.

Texts are read where they lie: all patterns are counted inside the row, so what
is shuffled afterwards is a page's key and some numbers. After the caps the pool
is as large as the configuration allows, whatever the number of pages.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinworks.functions.storage import checkpointed, discard
from veinworks.operators import curation, lexical

#: Why a page is left out.
CONTENTS, LOW_VALUE, EXCLUDED, UNCONFIRMED, NO_SCOPE = "table_of_contents", "low_value_page", "fault_exclusion_pattern", "fault_pattern_not_confirmed", "generic_source_without_pump_scope"
ADJACENT, DOCUMENT_LIMIT, EXACT, NEAR = "adjacent_context_low_value", "document_page_limit", "exact_duplicate_page", "near_duplicate_page"


@dataclass(frozen=True)
class Fault:
    fault_id: str
    terms: tuple[str, ...]
    patterns: tuple[str, ...]
    exclusions: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rules:
    faults: tuple[Fault, ...]
    roles: dict[str, tuple[str, ...]]
    scope: tuple[str, ...] = ()
    generic_families: tuple[str, ...] = ()
    minimum: float = 0.0
    per_group: int = 20
    per_family: int = 3
    per_document: int | None = None
    total: int | None = None
    context: int = 0
    decay: float = 1.0
    distance: int = 3
    split: str | None = field(default=None)


def _count(text: Column, patterns: tuple[str, ...]) -> Column:
    return sum((F.coalesce(F.regexp_count(text, F.lit(f"(?is){p}")), F.lit(0)) for p in patterns), F.lit(0))


def features(pages: DataFrame, rules: Rules) -> DataFrame:
    """What the rules need to know of each page, without its text. Pages hold page_id, doc_id, page, family_id, text, table_text, table_count and, where a split is asked for, split."""
    rows = pages if rules.split is None else pages.where(F.col("split") == rules.split)
    both = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.coalesce("table_text", F.lit("")))
    return rows.select(
        "page_id", "doc_id", "page", "family_id", "table_count",
        curation.is_contents(F.col("text")).alias("contents"),
        curation.is_low_value(both).alias("low_value"),
        F.array(*(_count(both, f.patterns) for f in rules.faults)).alias("fault_hits"),
        F.array(*(_count(both, f.exclusions) > 0 for f in rules.faults)).alias("excluded"),
        F.array(*(_count(both, p) for p in rules.roles.values())).alias("role_hits"),
        _count(both, rules.scope).alias("scope_hits"),
        F.sha2(F.trim(F.regexp_replace(F.lower(both), r"\s+", " ")), 256).alias("digest"),
    )


def matched(pages: DataFrame, known: DataFrame, rules: Rules) -> DataFrame:
    """(page_id, fault_id, ..., bm25, reason): each page that holds a fault's term, and the first reason against it. The scores count all pages, whatever their split."""
    text = pages.select(F.col("page_id").alias("doc_id"), F.concat_ws("\n", "text", "table_text").alias("text"))
    scores = lexical.bm25_scores(text, [(f.fault_id, " ".join(f.terms)) for f in rules.faults]).select(F.col("query_id").alias("fault_id"), F.col("doc_id").alias("page_id"), F.col("score").alias("bm25"))
    at = F.create_map(*(F.lit(x) for i, f in enumerate(rules.faults) for x in (f.fault_id, i)))[F.col("fault_id")]
    found = scores.join(known, "page_id").withColumns({"fault_hits": F.get("fault_hits", at), "excluded": F.get("excluded", at)})
    generic = F.col("family_id").isin(*rules.generic_families) if rules.generic_families else F.lit(False)
    reason = F.when(F.col("contents"), CONTENTS).when(F.col("low_value"), LOW_VALUE).when(F.col("excluded"), EXCLUDED).when(F.col("fault_hits") == 0, UNCONFIRMED).when(generic & (F.col("scope_hits") == 0), NO_SCOPE)
    return found.withColumn("reason", reason)


def scored(found: DataFrame, rules: Rules) -> DataFrame:
    """(fault_id, role, family_id, page_id, doc_id, page, score) of the pages without a reason against them, for each role they speak of."""
    names = F.array(*(F.lit(r) for r in rules.roles))
    each = found.where(F.col("reason").isNull()).select("*", F.posexplode("role_hits").alias("_at", "hits")).where(F.col("hits") > 0)
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(5.0), F.col("bm25")))
    score = F.col("fault_hits") * 4.0 + F.least("hits", F.lit(8)) * 1.5 + F.least("scope_hits", F.lit(4)) * 0.75 + F.least("table_count", F.lit(2)) * 1.0 + bounded
    return each.withColumn("score", score).where(F.col("score") >= rules.minimum).select("fault_id", F.get(names, F.col("_at")).alias("role"), "family_id", "page_id", "doc_id", "page", F.round("score", 4).alias("score"))


def with_context(chosen: DataFrame, known: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """The pool with neighbouring pages, and those refused. ``chosen`` is (page_id, doc_id, page, own): a page's own best score.

    Pages pass their score on in order of their own scores, lowered by the distance; one that got more from an earlier
    page than it has passes that on. So scores spread in rounds along runs of chosen pages, until none changes.
    """
    offsets = F.explode(F.array(*(F.lit(i) for i in range(-rules.context, rules.context + 1) if i))).alias("offset")
    held = checkpointed(chosen.withColumn("score", F.col("own")))

    def passed(rows: DataFrame) -> DataFrame:
        near = rows.select("doc_id", F.col("page").alias("_p"), F.col("page_id").alias("base"), F.col("own").alias("base_own"), F.col("score").alias("_s"), offsets)
        return near.select("doc_id", (F.col("_p") + F.col("offset")).alias("page"), "base", "base_own", F.round(F.col("_s") - F.abs("offset") * rules.decay, 4).alias("given"))

    while True:
        earlier = (F.col("base_own") > F.col("own")) | ((F.col("base_own") == F.col("own")) & (F.col("base") < F.col("page_id")))
        got = passed(held).join(held.select("doc_id", "page", "page_id", "own"), ["doc_id", "page"]).where(earlier).groupBy("page_id").agg(F.max("given").alias("given"))
        after = checkpointed(held.join(got, "page_id", "left").withColumn("_new", F.greatest("score", "given")).withColumn("_more", F.col("_new") > F.col("score")).withColumn("score", F.col("_new")).drop("given", "_new"))
        more = not after.where("_more").isEmpty()
        held = after.drop("_more")
        if not more:
            break
    given = passed(held).groupBy("doc_id", "page").agg(F.max("given").alias("given"))
    around = checkpointed(given.join(known.select("page_id", "doc_id", "page", "contents", "low_value"), ["doc_id", "page"]))
    fine = around.where(~(F.col("contents") | F.col("low_value")))
    own = held.select("page_id", "doc_id", "page", F.col("score").alias("_own"))
    pool = own.join(fine.select("page_id", "doc_id", "page", "given"), ["page_id", "doc_id", "page"], "full")
    refused = around.where(F.col("contents") | F.col("low_value")).select("page_id")
    return pool.select("page_id", "doc_id", "page", F.greatest("_own", "given").alias("score")), refused


def accepted(pages: DataFrame, links: DataFrame, per_document: int | None = None) -> DataFrame:
    """The pages that are accepted when all are taken in order (highest score, then least id): page_id, doc_id, digest, fingerprint, place.

    A page is refused if its document has ``per_document`` accepted ones, or if an accepted one has its digest or a
    fingerprint that equals or links to its own (``links``: hash, other, each pair once). Pages hold page_id, doc_id,
    score, digest and fingerprint.

    Rounds instead of a pass: a page is accepted as soon as it comes first among the undecided pages of its digest, of
    its fingerprint and of the linked ones, and as many undecided pages of its document come before it as it may still
    take. Then what it rules out is refused, and both leave the table with their links; so a round reads undecided
    pages only. The first undecided page of all is accepted in every round, and accepting a page early never takes the
    last place of an earlier one, since undecided ones before it are counted. Groups are only ever reduced to their
    first pages, so a digest, a fingerprint or a document may hold any share of the table.
    """
    limit = per_document if per_document is not None else (1 << 31) - 1
    undecided = checkpointed(pages.select("page_id", "doc_id", "digest", "fingerprint", F.struct((-F.col("score")).alias("rank"), F.col("page_id").alias("id")).alias("place"), F.lit(limit).alias("left")))
    near = checkpointed(links.select("hash", "other").union(links.select("other", "hash")))
    taken = []
    while not undecided.isEmpty():
        lead = undecided.groupBy("fingerprint").agg(F.min("place").alias("_lead"))
        linked = near.join(lead.withColumnRenamed("fingerprint", "other"), "other").groupBy(F.col("hash").alias("fingerprint")).agg(F.min("_lead").alias("_near"))
        same = undecided.groupBy("digest").agg(F.min("place").alias("_same"))
        order = F.row_number().over(Window.partitionBy("doc_id").orderBy("place"))
        first = undecided.withColumn("_n", order).where((F.col("_n") <= limit) & (F.col("_n") <= F.col("left"))) if per_document is not None else undecided
        free = first.join(lead, "fingerprint").join(same, "digest").join(linked, "fingerprint", "left")
        chosen = checkpointed(free.where((F.col("place") == F.col("_lead")) & (F.col("place") == F.col("_same")) & (F.col("_near").isNull() | (F.col("place") < F.col("_near")))).select("page_id", "doc_id", "digest", "fingerprint", "place"))
        taken.append(chosen)
        shut = chosen.select("fingerprint").union(near.join(chosen.select(F.col("fingerprint").alias("hash")), "hash").select("other"))
        rest = undecided.join(shut, "fingerprint", "left_anti").join(chosen.select("digest"), "digest", "left_anti")
        if per_document is not None:
            used = chosen.groupBy("doc_id").agg(F.count("*").cast("int").alias("_used"))
            rest = rest.join(used, "doc_id", "left").withColumn("left", F.col("left") - F.coalesce("_used", F.lit(0))).where(F.col("left") > 0).drop("_used")
        before, links_before = undecided, near
        undecided = checkpointed(rest)
        live = undecided.select(F.col("fingerprint").alias("hash")).distinct()
        near = checkpointed(near.join(live, "hash", "left_semi").join(live.withColumnRenamed("hash", "other"), "other", "left_semi"))
        discard(before, links_before)
    out = None
    for df in taken:
        out = df if out is None else out.unionByName(df)
    return out if out is not None else undecided.select("page_id", "doc_id", "digest", "fingerprint", "place")


def decided(pages: DataFrame, links: DataFrame, per_document: int | None = None, total: int | None = None) -> DataFrame:
    """page_id, score, decision and duplicate_of of all pages up to the one that fills ``total``: null for accepted ones, else the first reason that holds."""
    took = checkpointed(accepted(pages, links, per_document))
    kept = took if total is None else checkpointed(took.orderBy("place").limit(total))
    # after the last place no page is looked at; without that many accepted ones, all are
    last = None if total is None or kept.count() < total else kept.agg(F.max("place").alias("p")).first()["p"]
    place = F.struct((-F.col("score")).alias("rank"), F.col("page_id").alias("id"))
    seen = pages.withColumn("place", place)
    if last is not None:
        seen = seen.where((F.col("place.rank") < last["rank"]) | ((F.col("place.rank") == last["rank"]) & (F.col("place.id") <= last["id"])))
    refused = checkpointed(seen.join(kept.select("page_id"), "page_id", "left_anti"))
    before = lambda side: F.col(f"{side}.place") < F.col("r.place")
    r, k = refused.alias("r"), kept.alias("k")
    same = r.join(k, F.col("r.digest") == F.col("k.digest")).where(before("k")).groupBy("r.page_id").agg(F.min("k.place").alias("_same"))
    close = refused.select("page_id", "place", F.col("fingerprint").alias("hash")).join(links.select("hash", "other").union(links.select("other", "hash")), "hash").select("page_id", "place", F.col("other").alias("fingerprint")).union(refused.select("page_id", "place", "fingerprint"))
    near = close.alias("r").join(k, F.col("r.fingerprint") == F.col("k.fingerprint")).where(before("k")).groupBy("r.page_id").agg(F.min("k.place").alias("_near"))
    found = refused.join(same, "page_id", "left").join(near, "page_id", "left")
    if per_document is not None:
        full = r.join(k, F.col("r.doc_id") == F.col("k.doc_id")).where(before("k")).groupBy("r.page_id").agg(F.count("*").alias("_before"))
        found = found.join(full, "page_id", "left")
    else:
        found = found.withColumn("_before", F.lit(0))
    beyond = F.coalesce(F.col("_before"), F.lit(0)) >= (per_document if per_document is not None else 1 << 31)
    reason = F.when(beyond, DOCUMENT_LIMIT).when(F.col("_same").isNotNull(), EXACT).otherwise(NEAR)
    of = F.when(~beyond, F.coalesce(F.col("_same.id"), F.col("_near.id")))
    out = kept.select("page_id", (-F.col("place.rank")).alias("score"), F.lit(None).cast("string").alias("decision"), F.lit(None).cast(pages.schema["page_id"].dataType).alias("duplicate_of"))
    return out.unionByName(found.select("page_id", "score", reason.alias("decision"), of.alias("duplicate_of")))


def pooled(pages: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """The pool with page_id, doc_id, page, score and digest, and the pages left out before: page_id, fault_id (null for neighbours) and reason."""
    known = checkpointed(features(pages, rules))
    found = checkpointed(matched(pages, known, rules))
    capped = checkpointed(lexical.capped(scored(found, rules), rules.per_family, rules.per_group))
    chosen = capped.groupBy("page_id", "doc_id", "page").agg(F.max("score").alias("own"))
    left_out = found.where(F.col("reason").isNotNull()).select("page_id", "fault_id", "reason")
    pool = chosen.withColumnRenamed("own", "score")
    if rules.context:
        pool, refused = with_context(chosen, known, rules)
        left_out = left_out.unionByName(refused.select("page_id", F.lit(None).cast("string").alias("fault_id"), F.lit(ADJACENT).alias("reason")))
    return pool.join(known.select("page_id", "digest"), "page_id"), left_out


def page_pool(pages: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """The decisions on the pool's pages (see ``decided``), and the pages left out before, as in ``pooled``."""
    pool, left_out = pooled(pages, rules)
    pool = checkpointed(pool)
    texts = pages.join(pool.select("page_id"), "page_id", "left_semi").select("page_id", F.concat_ws("\n", "text", "table_text").alias("text"))
    prints = checkpointed(lexical.simhash(texts, "page_id"))
    # a page without words has the fingerprint of no token, all bits set
    printed = checkpointed(pool.join(prints, "page_id", "left").withColumn("fingerprint", F.coalesce("hash", F.lit((1 << 60) - 1))).drop("hash"))
    links = checkpointed(lexical.near_hashes(printed.select(F.col("fingerprint").alias("hash")), rules.distance).select("hash", "other"))
    return decided(printed, links, rules.per_document, rules.total), left_out
