"""Queries over records and answers: the second part of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from veinworks.operators import answers, validation
from veinworks.plans.bindings import RUNS, ranked_runs, table
from veinworks.plans.catalogue import query

_KINDS = ["ECONOMY", "LARGE", "STANDARD", "SMALL", "MEDIUM", "PROMO"]
_RELATIONS = [("r0", ["ECONOMY", "LARGE"], ["S0", "S1"]), ("r1", ["STANDARD", "SMALL", "PROMO"], ["S1", "S2", "S3"]), ("r2", _KINDS, ["S4"])]
_ROWS = """recs AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, concat('P', l_partkey) AS head, concat('S', l_suppkey) AS tail,
  p_type AS head_type, concat('S', s_nationkey % 5) AS tail_type, concat('r', p_size % 4) AS relation FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)"""


def _records(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    joined = items.join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return joined.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.concat(F.lit("P"), "l_partkey").alias("head"), F.concat(F.lit("S"), "l_suppkey").alias("tail"), F.col("p_type").alias("head_type"), F.concat(F.lit("S"), F.col("s_nationkey") % 5).alias("tail_type"), F.concat(F.lit("r"), F.col("p_size") % 4).alias("relation"))


def _inside(column, values):
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


_TYPED = " ".join(f"WHEN relation = '{r}' THEN concat_ws(',', CASE WHEN NOT {_inside('head_type', h)} THEN 'head_type_outside_domain' END, CASE WHEN NOT {_inside('tail_type', t)} THEN 'tail_type_outside_range' END)" for r, h, t in _RELATIONS)


@query(f"WITH {_ROWS} SELECT id, CASE {_TYPED} ELSE 'relation_unknown' END AS reasons FROM recs")
def relation_type(spark, sf_dir):
    constraints = spark.createDataFrame(_RELATIONS, "relation string, heads array<string>, tails array<string>")
    return validation.typed(_records(spark, sf_dir), constraints).select("id", F.array_join("reasons", ",").alias("reasons"))


_RULES = [("r3", "PROMO", "S4", "r2", False), ("r2", "PROMO", "S4", "r0", True), ("r1", "SMALL", "S0", "r1", True)]


def _redirect_sql() -> str:
    parts = [f"WITH {_ROWS}, s0 AS (SELECT *, '' AS actions FROM recs)"]
    for i, (r, h, t, new, swap) in enumerate(_RULES):
        hit = f"relation = '{r}' AND head_type = '{h}' AND tail_type = '{t}'"
        pick = lambda a, b, hit=hit, swap=swap: f"CASE WHEN {hit} THEN {b} ELSE {a} END AS {a}" if swap else a
        parts.append(f"s{i + 1} AS (SELECT id, {pick('head', 'tail')}, {pick('tail', 'head')}, {pick('head_type', 'tail_type')}, {pick('tail_type', 'head_type')}, CASE WHEN {hit} THEN '{new}' ELSE relation END AS relation, CASE WHEN {hit} THEN concat_ws(',', nullif(actions, ''), '{i}') ELSE actions END AS actions FROM s{i})")
    return ", ".join(parts) + f" SELECT * FROM s{len(_RULES)}"


@query(_redirect_sql())
def direction_normalize(spark, sf_dir):
    out = validation.redirected(_records(spark, sf_dir), _RULES)
    return out.withColumn("actions", F.array_join(F.transform("actions", lambda i: i.cast("string")), ","))


_CLASSES = {"wear": "\\b(the|der|les|los)\\b", "leak": "(tion|keit)", "noise": "[0-9]{6,}", "mail": "@[a-z0-9]+\\."}
_VETOES = {"leak": "[!]{2}", "noise": "token"}


@query("SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}')" + (f" AND NOT regexp_matches(lower(text), '{_VETOES[c]}')" if c in _VETOES else "") + f" THEN '{c}' END" for c, p in _CLASSES.items()) + ") AS classes FROM documents")
def fault_mapping(spark, sf_dir):
    return validation.classified(table(spark, sf_dir, "documents"), "doc_id", "text", _CLASSES, _VETOES).select("doc_id", F.array_join("classes", ",").alias("classes"))


@query("SELECT source AS family, count(*) AS docs, CAST(count_if(n > 0) AS bigint) AS matched, CAST(sum(n) AS bigint) AS matches FROM (SELECT source, len(regexp_extract_all(text, '[0-9]{6,}')) AS n FROM documents) GROUP BY ALL")
def lexical_audit(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select("source", F.regexp_count("text", F.lit("[0-9]{6,}")).alias("n"))
    return n.groupBy(F.col("source").alias("family")).agg(F.count("*").alias("docs"), F.count_if(F.col("n") > 0).alias("matched"), F.sum("n").cast("long").alias("matches"))


_SURFACE = "CASE p_partkey % 5 WHEN 0 THEN p_type WHEN 1 THEN upper(p_name) WHEN 2 THEN replace(lower(p_name), ' ', '  ') WHEN 3 THEN 'a.b*(c' ELSE '' END"
_PAGE_TEXT = "CASE WHEN p_partkey % 10 = 3 THEN p_name || ' A.B*(C ' || p_type ELSE p_name || chr(10) || ' ' || p_type END"


@query(f"""WITH t AS (SELECT p_partkey AS id, {_PAGE_TEXT} AS text, {_SURFACE} AS surface FROM part), u AS (SELECT *, regexp_replace(regexp_replace(trim(surface), '([.*(])', '\\\\\\1', 'g'), '\\s+', '\\\\s+', 'g') AS pattern FROM t),
v AS (SELECT id, instr(text, surface) AS exact, surface, instr(text, nullif(regexp_extract(text, '(?i)' || pattern), '')) AS flexible FROM u)
SELECT id, CAST(CASE WHEN surface = '' THEN NULL WHEN exact > 0 THEN exact - 1 WHEN flexible > 0 THEN flexible - 1 END AS integer) AS start, CASE WHEN surface = '' THEN NULL WHEN exact > 0 THEN 'exact' WHEN flexible > 0 THEN 'flexible' END AS method FROM v""")
def surface_location(spark, sf_dir):
    """Surfaces that stand there, that differ in case and white space, that are patterns to a careless search, and that are missing."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{_PAGE_TEXT} AS text", f"{_SURFACE} AS surface")
    return rows.select("id", validation.located(F.col("text"), F.col("surface")).alias("_at")).select("id", "_at.start", "_at.method")


@query("""WITH s AS (SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS b FROM part), t AS (SELECT *, replace(b, '-', ' ') AS c FROM s),
u AS (SELECT *, CASE WHEN c LIKE '%ies' THEN regexp_replace(c, 'ies$', 'y') WHEN c LIKE '%s' AND NOT regexp_matches(c, '(ss|us)$') THEN regexp_replace(c, 's$', '') ELSE c END AS d FROM t)
SELECT id, concat(b, CASE WHEN c <> b THEN '|' || c END, CASE WHEN d <> c AND d <> b THEN '|' || d END) AS variants FROM u""")
def morphology_variants(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(validation.morphology(F.col("p_name")), "|").alias("variants"))


@query("""WITH f AS (SELECT p_type AS type, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS concept, p_name AS surface, count(*) AS n FROM part GROUP BY ALL)
SELECT type, concept, CAST(sum(n) AS bigint) AS mentions, array_to_string(list_sort(list(surface)), '|') AS forms, min(surface) FILTER (n = top) AS label FROM (SELECT *, max(n) OVER (PARTITION BY type, concept) AS top FROM f) GROUP BY type, concept""")
def concept_clusters(spark, sf_dir):
    return validation.concepts(table(spark, sf_dir, "part").select(F.col("p_type").alias("type"), F.col("p_name").alias("surface")))


@query("""WITH d AS (SELECT p_type AS type, lower(p_name) AS s, min(p_brand) AS term, count(DISTINCT p_brand) AS n FROM part WHERE p_size < 10 GROUP BY ALL)
SELECT p_partkey AS id, CASE WHEN n = 1 THEN term WHEN n > 1 THEN NULL ELSE trim(p_name) END AS label, CASE WHEN n = 1 THEN 'dictionary' WHEN n > 1 THEN 'ambiguous' ELSE 'surface' END AS origin FROM part LEFT JOIN d ON d.type = p_type AND d.s = lower(p_name)""")
def canonical_labels(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("surface"), "p_size", F.col("p_brand").alias("term"))
    return validation.canonical(parts.select("id", "type", "surface"), parts.where("p_size < 10").select("type", "surface", "term")).select("id", "label", "origin")


@query("SELECT table_id, group_id, CAST((row_number() OVER (PARTITION BY table_id ORDER BY first, group_id) - 1) // 3 AS bigint) AS chunk FROM (SELECT l_orderkey AS table_id, l_partkey AS group_id, min(l_linenumber) AS first FROM lineitem GROUP BY ALL)")
def table_chunks(spark, sf_dir):
    return validation.row_groups(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_partkey").alias("group_id"), F.col("l_linenumber").alias("position")), 3)


_ANSWERS = """ans AS (SELECT conv_id AS query_id, CASE WHEN count_if(role = 'assistant') >= 2 THEN 'answered' ELSE 'abstained' END AS status, list_sort(list(turn) FILTER (role = 'assistant')) AS citations,
  list_sort(list(turn) FILTER (turn <= 5)) AS allowed, list_sort(list(turn) FILTER (turn % 3 = 0)) AS relevant, max(length(text)) AS longest FROM conversations GROUP BY conv_id)"""


def _answered(spark, sf_dir):
    of = lambda test: F.array_sort(F.collect_list(F.when(F.expr(test), F.col("turn"))))
    per = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(F.count_if(F.col("role") == "assistant").alias("_n"), of("role = 'assistant'").alias("citations"), of("turn <= 5").alias("allowed"), of("turn % 3 = 0").alias("relevant"), F.max_by("text", F.char_length("text")).alias("text"))
    return per.withColumn("status", F.when(F.col("_n") >= 2, "answered").otherwise("abstained"))


@query(f"WITH {_ANSWERS} SELECT query_id, concat_ws(',', CASE WHEN status = 'answered' AND len(coalesce(citations, [])) = 0 THEN 'no_citation' END, CASE WHEN len(list_filter(coalesce(citations, []), lambda x: NOT list_contains(coalesce(allowed, []), x))) > 0 THEN 'foreign_citation' END, CASE WHEN longest > 900 THEN 'too_long' END) AS violations FROM ans")
def answer_contract(spark, sf_dir):
    reasons = answers.contract_violations(F.col("status"), F.col("citations"), F.col("allowed"), F.col("text"), 900)
    return _answered(spark, sf_dir).select("query_id", F.array_join(reasons, ",").alias("violations"))


@query(f"""WITH {_ANSWERS} SELECT query_id, round(CASE WHEN query_id % 2 = 0 AND status = 'answered' THEN 2.0 * len(list_intersect(coalesce(citations, []), coalesce(relevant, []))) / (len(coalesce(citations, [])) + len(coalesce(relevant, []))) WHEN query_id % 2 = 1 AND status = 'abstained' THEN 1.0 ELSE 0.0 END, 6) AS utility FROM ans""")
def response_utility(spark, sf_dir):
    score = answers.utility(F.col("query_id") % 2 == 0, F.col("status"), F.col("citations"), F.col("relevant"))
    return _answered(spark, sf_dir).select("query_id", score.alias("utility"))


_POINTS = "points AS (SELECT l_partkey % 50 AS query_id, l_suppkey AS claim_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS evidence_id, l_extendedprice AS score, l_returnflag = 'A' AS direct FROM lineitem)"


@query(f"""WITH {_POINTS}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id, claim_id ORDER BY score DESC, evidence_id) AS r FROM points WHERE direct)
SELECT query_id, claim_id, evidence_id, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, evidence_id) AS position FROM b WHERE r = 1) WHERE position <= 6""")
def coverage_guard(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("query_id"), F.col("l_suppkey").alias("claim_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("evidence_id"), F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "A").alias("direct"))
    return answers.coverage_guard(points, 6).select("query_id", "claim_id", "evidence_id", "position")


@query(" UNION ALL ".join(f"SELECT doc_id % 20 AS query_id, CAST(count_if({kept}) AS bigint) AS accepted, count(*) AS candidates, CAST(count_if(quality <> 1) AS bigint) AS reviewed, '{mode}' AS mode FROM labels GROUP BY doc_id % 20" for mode, kept in (("direct_render", "true"), ("stage1_only", "quality = 1"), ("stage1_plus_review", "quality = 1 OR toxic = 0"))))
def verification_cascade(spark, sf_dir):
    votes = table(spark, sf_dir, "labels").select((F.col("doc_id") % 20).alias("query_id"), (F.col("quality") == 1).alias("first"), (F.col("toxic") == 0).alias("review"))
    out = None
    for mode in ("direct_render", "stage1_only", "stage1_plus_review"):
        one = answers.cascade(votes, mode)
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH p AS (SELECT l_orderkey AS k, l_orderkey % 7 AS variant, coalesce(list_sort(list(DISTINCT l_suppkey) FILTER (l_linenumber <= 4)), []) AS a, coalesce(list_sort(list(DISTINCT l_suppkey) FILTER (l_linenumber >= 3)), []) AS b FROM lineitem GROUP BY l_orderkey)
SELECT variant, count(*) AS pairs, round(avg(CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END), 6) AS jaccard, round(avg(CASE WHEN a[1] = b[1] THEN 1.0 WHEN a[1] IS NULL OR b[1] IS NULL THEN NULL ELSE 0.0 END), 6) AS same_first FROM p GROUP BY variant""")
def paraphrase_jaccard(spark, sf_dir):
    of = lambda test: F.array_sort(F.collect_set(F.when(F.expr(test), F.col("l_suppkey"))))
    pairs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(of("l_linenumber <= 4").alias("a"), of("l_linenumber >= 3").alias("b"))
    return answers.agreement(pairs.withColumn("variant", F.col("l_orderkey") % 7), "variant")


@query(f"WITH {RUNS} SELECT CAST(position AS integer) AS position, count(*) AS runs, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95 FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY ts, event_id) - 1) % 4 AS position FROM runs) GROUP BY position")
def order_position_latency(spark, sf_dir):
    return answers.position_effect(ranked_runs(spark, sf_dir), 4)


@query("SELECT event_type AS method, CAST(sum(CASE WHEN value >= 20 THEN 1 ELSE 0 END) AS bigint) AS accepted, count(*) AS candidates, round(sum(CASE WHEN value >= 20 THEN 1 ELSE 0 END) / count(*), 6) AS rate, round(sum(CASE WHEN value >= 20 THEN 1 ELSE 0 END) * 60.0::double / sum(CAST(round(value * 100) AS bigint)), 6) AS per_minute FROM events GROUP BY event_type")
def extraction_yields(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("method"), (F.col("value") >= 20).cast("int").alias("accepted"), F.lit(1).alias("candidates"), F.round(F.col("value") * 100).cast("long").alias("seconds"))
    return answers.yields(rows, "method")


@query("SELECT p_partkey AS id, concat(regexp_replace(substr(concat(p_name, ' may cause ', p_type, '!!'), 1, 39), '[\\s.,;:!?]+$', ''), '.') AS text FROM part")
def claim_rendering(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), answers.rendered(F.lit("{head} may cause {tail}!!"), F.col("p_name"), F.col("p_type"), 40).alias("text"))
