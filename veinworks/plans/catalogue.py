"""All queries of the library, and their equivalents in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinworks.functions.storage import checkpointed
from veinworks.operators import evaluation, gates, graph, identity, lexical, retrieval, support
from veinworks.plans.bindings import ASSERTIONS, EDGES, RUNS, SCORED, assertions, edges, ranked_runs, table

FLAGSHIP = "claim_support"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its oracle."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return support.with_score(assertions(spark, sf_dir))


# --- support ----------------------------------------------------------------

_ELIGIBLE = SCORED + ", eligible AS (SELECT * FROM scored WHERE split = 'build_train' AND level IN ('E1', 'E2') AND NOT inferred)"


def _support_sql(source: str, rows: str = "eligible", budget: int = 2) -> str:
    return f"""SELECT claim_id, round(sum(CASE WHEN rank <= {budget} THEN q END) / {budget}, 6) AS support, count(*) AS sources, CAST(sum(n) AS bigint) AS rows
  FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY q DESC, {source}) AS rank
    FROM (SELECT claim_id, {source}, max(q) AS q, count(*) AS n FROM {rows} GROUP BY ALL)) GROUP BY claim_id"""


@query(f"WITH {_ELIGIBLE} {_support_sql('family_id')}")
def claim_support(spark, sf_dir):
    return support.capped_support(support.eligible(scored(spark, sf_dir)))


@query(f"WITH {_ELIGIBLE} {_support_sql('doc_id')}")
def doc_naive_support(spark, sf_dir):
    return support.capped_support(support.eligible(scored(spark, sf_dir)), source="doc_id")


_BUDGETS = f"""{_ELIGIBLE}, best AS (SELECT claim_id, family_id, max(q) AS q FROM eligible GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY q DESC, family_id) AS rank FROM best),
budgeted AS (SELECT claim_id, budget, round(sum(CASE WHEN rank <= budget THEN q END) / budget, 6) AS support
  FROM ranked, (SELECT CAST(unnest([1, 2, 3, 4]) AS integer) AS budget) GROUP BY claim_id, budget)"""
_SUMMARY = """count(*) AS claims, round(avg(support), 6) AS mean, min(support) AS low, round(quantile_cont(support, 0.25), 6) AS p25,
round(quantile_cont(support, 0.5), 6) AS median, round(quantile_cont(support, 0.75), 6) AS p75, max(support) AS high,
CAST(count_if(support >= 0.5) AS bigint) AS at_least_half, CAST(count_if(support >= 0.8) AS bigint) AS at_least_four_fifths"""


@query(f"WITH {_BUDGETS} SELECT * FROM budgeted")
def claim_support_budget(spark, sf_dir):
    return support.budget_support(support.eligible(scored(spark, sf_dir)))


@query(f"WITH {_BUDGETS} SELECT budget, {_SUMMARY} FROM budgeted GROUP BY budget")
def support_summary(spark, sf_dir):
    return support.summary(support.budget_support(support.eligible(scored(spark, sf_dir))), "budget")


@query(f"WITH {_ELIGIBLE} SELECT claim_id, family_id, evidence_id, doc_id, q FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, family_id ORDER BY q DESC, evidence_id, doc_id) AS r FROM eligible) WHERE r = 1")
def supporting_rows(spark, sf_dir):
    return support.supporting_rows(support.eligible(scored(spark, sf_dir))).select("claim_id", "family_id", "evidence_id", "doc_id", "q")


def _pressure(k: int) -> str:
    copies = f"(SELECT claim_id, family_id, doc_id * {k} + c AS doc_id, q FROM eligible, (SELECT unnest(range({k})) AS c))"
    return f"""SELECT CAST({k} AS integer) AS copies, round(avg(f.support), 6) AS by_family, round(avg(d.support), 6) AS by_document, CAST(count_if(d.support > f.support) AS bigint) AS inflated
  FROM ({_support_sql('family_id', copies)}) f JOIN ({_support_sql('doc_id', copies)}) d USING (claim_id)"""


@query(f"WITH {_ELIGIBLE} " + " UNION ALL ".join(map(_pressure, (1, 2, 3))))
def replication_pressure(spark, sf_dir):
    return support.replication_pressure(support.eligible(scored(spark, sf_dir)))


@query(f"WITH {ASSERTIONS} SELECT family_id, count(*) AS rows, count(DISTINCT doc_id) AS docs, count(DISTINCT claim_id) AS claims FROM assertions GROUP BY family_id")
def family_distribution(spark, sf_dir):
    return support.family_distribution(assertions(spark, sf_dir))


@query(f"WITH {_ELIGIBLE} SELECT families >= 2 AS independent, count(*) AS claims, CAST(sum(docs) AS bigint) AS docs FROM (SELECT claim_id, count(DISTINCT doc_id) AS docs, count(DISTINCT family_id) AS families FROM eligible GROUP BY claim_id HAVING count(DISTINCT doc_id) >= 2) GROUP BY ALL")
def multi_doc_audit(spark, sf_dir):
    return support.multi_document_audit(support.eligible(scored(spark, sf_dir)))


# --- gates ------------------------------------------------------------------

_REASONS = "list_filter([" + ", ".join(f"CASE WHEN coalesce({test}, true) THEN '{name}' END" for name, test in gates.REASONS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {SCORED}, told AS (SELECT {_REASONS} AS reasons FROM scored) SELECT reason, count(*) AS rows, CAST(count_if(len(reasons) = 1) AS bigint) AS alone FROM (SELECT reasons, unnest(reasons) AS reason FROM told) GROUP BY reason")
def eligibility_exclusions(spark, sf_dir):
    return gates.exclusions(scored(spark, sf_dir))


@query(f"WITH {SCORED} SELECT evidence_id, array_to_string({_REASONS}, ',') AS reasons FROM scored")
def eligibility_reasons(spark, sf_dir):
    return gates.with_reasons(scored(spark, sf_dir)).select("evidence_id", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {ASSERTIONS}, a AS (SELECT *, round(confidence * CASE level WHEN 'E1' THEN 1.0 WHEN 'E2' THEN 0.95 ELSE 0.75 END, 3) AS structural FROM assertions),
b AS (SELECT *, round(structural * CASE status WHEN 'entailed' THEN 1.0 ELSE 0.75 END, 3) AS final FROM a)
SELECT CASE WHEN final >= 0.8 AND NOT inferred THEN 'silver' WHEN final >= 0.6 OR (inferred AND structural >= 0.6) THEN 'review' ELSE 'rejected' END AS decision, level, count(*) AS rows, min(final) AS low, max(final) AS high FROM b GROUP BY ALL""")
def confidence_decision(spark, sf_dir):
    return gates.decided(assertions(spark, sf_dir)).groupBy("decision", "level").agg(F.count("*").alias("rows"), F.min("final").alias("low"), F.max("final").alias("high"))


_CUMULATIVE = {}
_so_far = []
for _name, _test in gates.STAGES.items():
    _so_far.append(f"({_test})")
    _CUMULATIVE[_name] = " AND ".join(_so_far)


@query(f"WITH {SCORED} " + " UNION ALL ".join(f"SELECT '{n}' AS stage, count(*) AS rows, round(count(*) / (SELECT count(*) FROM scored), 6) AS retention, count(DISTINCT claim_id) AS claims, count(DISTINCT doc_id) AS docs, count(DISTINCT family_id) AS families FROM scored WHERE {t}" for n, t in _CUMULATIVE.items()))
def stage_table(spark, sf_dir):
    return gates.stage_table(scored(spark, sf_dir))


_NAMES = list(_CUMULATIVE)


@query(f"WITH {SCORED}, c AS (SELECT " + ", ".join(f"CAST(count_if({t}) AS bigint) AS {n}" for n, t in _CUMULATIVE.items()) + " FROM scored) " + " UNION ALL ".join(f"SELECT '{b}' AS gate, {a} AS rows_in, {b} AS rows_out, {a} - {b} AS removed, round(({a} - {b}) / {a}, 6) AS rate FROM c" for a, b in zip(_NAMES, _NAMES[1:], strict=False)))
def gate_funnel(spark, sf_dir):
    return gates.funnel(scored(spark, sf_dir))


@query(f"WITH {SCORED} SELECT threshold, count(*) AS rows, count(DISTINCT claim_id) AS claims, count(DISTINCT doc_id) AS docs FROM scored, (SELECT unnest([0.5, 0.7, 0.9, 0.95]::double[]) AS threshold) WHERE q >= threshold GROUP BY threshold")
def score_sensitivity(spark, sf_dir):
    return gates.threshold_sensitivity(scored(spark, sf_dir), (0.5, 0.7, 0.9, 0.95))


_COVERAGE = "greatest(0, 150 - units) AS units_missing, greatest(0, 400 - docs) AS docs_missing, greatest(0, 20 - families) AS families_missing, units >= 150 AND docs >= 400 AND families >= 20 AS passes"


@query(f"WITH {_ELIGIBLE}, per AS (SELECT fault_id, role, count(DISTINCT claim_id) AS units, count(DISTINCT doc_id) AS docs, count(DISTINCT family_id) AS families FROM eligible GROUP BY ALL) SELECT *, {_COVERAGE} FROM per")
def coverage_report(spark, sf_dir):
    return gates.coverage(support.eligible(scored(spark, sf_dir)), 150, 400, 20)


@query(f"WITH {ASSERTIONS} SELECT family_id, CASE WHEN split = 'build_train' THEN 'eligible' WHEN split IN ('development', 'held_out_test') THEN 'contaminated' ELSE 'unexpected' END AS kind, count(*) AS rows FROM assertions GROUP BY ALL")
def split_audit(spark, sf_dir):
    return gates.split_audit(assertions(spark, sf_dir))


_VOTES = "SELECT doc_id AS record_id, 'A' AS judge, quality AS vote, CASE WHEN doc_id % 3 = 0 THEN 0.85 ELSE 0.95 END AS confidence FROM labels UNION ALL SELECT doc_id, 'B', 1 - toxic, CASE WHEN doc_id % 5 = 0 THEN 0.85 ELSE 0.95 END FROM labels"


@query(f"""WITH v AS ({_VOTES}), w AS (SELECT record_id, max(CASE WHEN judge = 'A' THEN vote END) AS av, max(CASE WHEN judge = 'B' THEN vote END) AS bv, min(confidence) AS c FROM v GROUP BY record_id)
SELECT record_id, CASE WHEN av = 1 AND bv = 1 AND c >= 0.9 THEN 'silver' WHEN av = 0 AND bv = 0 AND c >= 0.9 THEN 'rejected' ELSE 'unresolved' END AS decision FROM w""")
def adjudication(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    confidence = lambda k: F.when(F.col("doc_id") % k == 0, 0.85).otherwise(0.95).alias("confidence")
    a = labels.select(F.col("doc_id").alias("record_id"), F.lit("A").alias("judge"), F.col("quality").alias("vote"), confidence(3))
    b = labels.select(F.col("doc_id").alias("record_id"), F.lit("B").alias("judge"), (1 - F.col("toxic")).alias("vote"), confidence(5))
    return gates.adjudicated(a.unionByName(b)).select("record_id", "decision")


@query("SELECT count(*) AS records, CAST(count_if(quality = 1) AS bigint) AS a_supports, CAST(count_if(toxic = 0) AS bigint) AS b_supports, CAST(count_if(quality = 1 - toxic) AS bigint) AS agree, round(count_if(quality = 1 - toxic) / count(*), 6) AS agreement FROM labels")
def judge_agreement(spark, sf_dir):
    same = F.col("quality") == 1 - F.col("toxic")
    return table(spark, sf_dir, "labels").agg(F.count("*").alias("records"), F.count_if(F.col("quality") == 1).alias("a_supports"), F.count_if(F.col("toxic") == 0).alias("b_supports"), F.count_if(same).alias("agree"), F.round(F.count_if(same) / F.count("*"), 6).alias("agreement"))


# --- identity, layers and rules ---------------------------------------------


@query(f"WITH {ASSERTIONS} SELECT triple_id, evidence_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY triple_id ORDER BY confidence DESC, evidence_id) AS r FROM assertions) WHERE r = 1")
def dedup_best(spark, sf_dir):
    return identity.best_per_key(assertions(spark, sf_dir), ["triple_id"], F.desc("confidence"), F.col("evidence_id")).select("triple_id", "evidence_id", "confidence")


@query(f"WITH {ASSERTIONS} SELECT CAST(sum(n) AS bigint) AS rows, count(*) AS kept, CAST(sum(n - 1) AS bigint) AS removed FROM (SELECT triple_id, count(*) AS n FROM assertions GROUP BY triple_id)")
def dedup_counts(spark, sf_dir):
    return identity.duplicates_removed(assertions(spark, sf_dir), ["triple_id"])


@query("SELECT p_partkey AS part_id, concat('MPE-', substr(sha256(concat_ws('␟', p_type, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')))), 1, 20)) AS entity_id, concat('MPC-', substr(sha256(concat_ws('␟', '2', p_partkey, p_size % 15, p_brand)), 1, 20)) AS claim_id FROM part")
def stable_ids(spark, sf_dir):
    entity = identity.stable_id("MPE", F.col("p_type"), identity.normalised(F.col("p_name")))
    claim = identity.stable_id("MPC", F.lit("2"), F.col("p_partkey").cast("string"), (F.col("p_size") % 15).cast("string"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), entity.alias("entity_id"), claim.alias("claim_id"))


@query("SELECT p_type AS type, p_name AS label, min(p_partkey) AS first_part, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS surfaces, count(*) AS members FROM part GROUP BY ALL")
def layer_entities(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("type"), F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("first_part"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("surfaces"), F.count("*").alias("members"))


@query(f"WITH {ASSERTIONS} SELECT claim_id, min(evidence_id) AS first_evidence, count(*) AS evidence, count(DISTINCT tail_id) AS tails, max(confidence) AS confidence FROM assertions GROUP BY claim_id")
def layer_claims(spark, sf_dir):
    return assertions(spark, sf_dir).groupBy("claim_id").agg(F.min("evidence_id").alias("first_evidence"), F.count("*").alias("evidence"), F.countDistinct("tail_id").alias("tails"), F.max("confidence").alias("confidence"))


@query(f"WITH {ASSERTIONS}, claims AS (SELECT claim_id FROM assertions GROUP BY claim_id HAVING count(DISTINCT family_id) > 14) SELECT evidence_id, claim_id FROM assertions ANTI JOIN claims USING (claim_id)")
def orphan_evidence(spark, sf_dir):
    """Evidence whose claim isn't among the kept ones, those of more than 14 families."""
    rows = assertions(spark, sf_dir)
    claims = rows.groupBy("claim_id").agg(F.countDistinct("family_id").alias("n")).where("n > 14")
    return rows.join(claims, "claim_id", "left_anti").select("evidence_id", "claim_id")


_SIDES = "l AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_returnflag = 'R')"


@query(f"WITH {_SIDES} SELECT coalesce(l.a, r.a) AS a, coalesce(l.b, r.b) AS b, CASE WHEN l.a IS NULL THEN 'right' ELSE 'left' END AS only FROM l FULL JOIN r ON l.a = r.a AND l.b = r.b WHERE l.a IS NULL OR r.a IS NULL")
def bidirectional_coverage(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), "l_returnflag")
    return identity.coverage_difference(items.where("l_returnflag = 'A'"), items.where("l_returnflag = 'R'"), ["a", "b"])


def _rule_sql(name: str, severity: str, rows: str, violated: str, example: str) -> str:
    return f"""SELECT '{name}' AS rule, '{severity}' AS severity, (SELECT count(*) FROM {rows}) AS evaluated, (SELECT count(*) FROM {rows} WHERE {violated}) AS violations,
    (SELECT coalesce(string_agg(e, ',' ORDER BY e), '') FROM (SELECT DISTINCT CAST({example} AS varchar) AS e FROM {rows} WHERE {violated} ORDER BY e LIMIT 8)) AS examples"""


_RULES = [
    ("unique_ids", "error", "(SELECT triple_id, count(*) AS n FROM assertions GROUP BY triple_id)", "n > 1", "triple_id"),
    ("build_split_only", "error", "assertions", "split <> 'build_train'", "doc_id"),
    ("direct_evidence", "error", "assertions", "level NOT IN ('E1', 'E2') OR inferred", "evidence_id"),
    ("known_status", "error", "assertions", "status NOT IN ('entailed', 'undetermined', 'not_entailed')", "evidence_id"),
    ("claim_has_evidence", "warning", "(SELECT p_partkey, l_partkey FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem) x ON l_partkey = p_partkey)", "l_partkey IS NULL", "p_partkey"),
    ("release_confidence", "warning", "assertions", "confidence < 0.91", "doc_id"),
]


@query(f"WITH {ASSERTIONS}, r AS (" + " UNION ALL ".join(_rule_sql(*r) for r in _RULES) + ") SELECT *, severity = 'error' AND violations > 0 AS blocking FROM r")
def constraint_report(spark, sf_dir):
    rows = assertions(spark, sf_dir)
    parts = table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem").select("l_partkey").distinct(), F.col("l_partkey") == F.col("p_partkey"), "left")
    sources = {"unique_ids": rows.groupBy("triple_id").agg(F.count("*").alias("n")), "claim_has_evidence": parts}
    check = lambda name, severity, test, example: (name, severity, F.expr(test), F.col(example))
    alike = [check(n, s, t, e) for n, s, _, t, e in _RULES if n not in sources]
    return identity.report([identity.rules(rows, alike), *(identity.rules(sources[n], [check(n, s, t, e)]) for n, s, _, t, e in _RULES if n in sources)])


#: The fields of a record that a release must not change.
IMMUTABLE = ("claim_id", "doc_id", "family_id", "tail_id", "level", "status", "split", "role", "confidence")
#: A release in which some records were changed, and one of a kind that the raw table lacks.
_RELEASED = """SELECT evidence_id || CASE WHEN doc_id % 50 = 7 THEN '-new' ELSE '' END AS evidence_id, claim_id + CASE WHEN doc_id % 40 = 3 THEN 1 ELSE 0 END AS claim_id, doc_id, family_id, tail_id, CASE WHEN claim_id % 30 = 5 THEN 'E1' ELSE level END AS level, status, split,
  CASE WHEN tail_id % 25 = 2 THEN NULL ELSE role END AS role, round(confidence - CASE WHEN doc_id % 60 = 1 THEN 0.01 ELSE 0 END, 6) AS confidence FROM {rows} WHERE confidence >= 0.95 AND NOT inferred"""


@query(f"""WITH {ASSERTIONS}, v AS ({_RELEASED.format(rows='assertions')}) SELECT v.evidence_id, CASE WHEN a.evidence_id IS NULL THEN 'absent' ELSE array_to_string(list_filter([{', '.join(f"CASE WHEN v.{c} IS DISTINCT FROM a.{c} THEN '{c}' END" for c in IMMUTABLE)}], lambda x: x IS NOT NULL), ',') END AS changed
FROM v LEFT JOIN assertions a USING (evidence_id)""")
def release_projection(spark, sf_dir):
    """Released records held against the raw ones: which fields changed, or that there is no such record."""
    raw = assertions(spark, sf_dir)
    raw.createOrReplaceTempView("raw_assertions")
    return identity.changed_fields(spark.sql(_RELEASED.format(rows="raw_assertions")), raw, "evidence_id", IMMUTABLE)


_PATHS = [(r, t, f"S{k}", r % 4) for r in range(15) for t, k in (("ECONOMY", r % 5), ("LARGE", (r + 1) % 5), ("PROMO", (r + 2) % 5))]
_CQ = f"""WITH claims AS (SELECT DISTINCT l_partkey AS head, l_suppkey AS tail FROM lineitem),
typed AS (SELECT head, tail, p_size % 15 AS relation, p_type AS head_type, concat('S', s_nationkey % 5) AS tail_type, head % 10 AS fault_id FROM claims JOIN part ON p_partkey = head JOIN supplier ON s_suppkey = tail),
paths(relation, head_type, tail_type, role) AS (VALUES {", ".join(f"({r}, '{h}', '{t}', {o})" for r, h, t, o in _PATHS)}),
answers AS (SELECT fault_id, role, head, tail FROM typed JOIN paths USING (relation, head_type, tail_type))"""


def _answers(spark, sf_dir):
    claims = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("h"), F.col("l_suppkey").alias("t")).distinct()
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("h"), (F.col("p_size") % 15).alias("relation"), F.col("p_type").alias("type"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("t"), F.concat(F.lit("S"), F.col("s_nationkey") % 5).alias("type"))
    entities = parts.select(F.concat(F.lit("P"), "h").alias("entity"), "type").union(suppliers.select(F.concat(F.lit("S"), "t"), "type"))
    facts = claims.join(parts.drop("type"), "h").select("h", "t", "relation", F.concat(F.lit("P"), "h").alias("head"), F.concat(F.lit("S"), "t").alias("tail"))
    paths = spark.createDataFrame(_PATHS, "relation int, head_type string, tail_type string, role int")
    return graph.metapaths(facts, entities, paths).select((F.col("h") % 10).alias("fault_id"), "role", F.col("h").alias("head"), F.col("t").alias("tail"))


@query(f"{_CQ} SELECT fault_id, role, count(*) AS answers, count(DISTINCT head) AS heads, CASE WHEN count(*) >= 40 THEN 'answered' ELSE 'below_minimum' END AS outcome FROM answers GROUP BY ALL")
def cq_answers(spark, sf_dir):
    return _answers(spark, sf_dir).groupBy("fault_id", "role").agg(F.count("*").alias("answers"), F.countDistinct("head").alias("heads")).withColumn("outcome", F.when(F.col("answers") >= 40, "answered").otherwise("below_minimum"))


@query(f"{_CQ} SELECT fault_id, role, count(*) AS rows, round(avg(tail), 6) AS mean FROM answers GROUP BY GROUPING SETS ((fault_id), (role), ())")
def cq_by_role_fault(spark, sf_dir):
    return evaluation.grouped_in_sets(_answers(spark, sf_dir), "fault_id", "role", "tail")


# --- text -------------------------------------------------------------------


@query("""WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text || repeat('甲㐁', length(text) // 2) WHEN 1 THEN repeat('更乙', 40) || substr(text, 1, 9) ELSE text END AS text FROM documents),
c AS (SELECT doc_id, len(regexp_extract_all(text, '[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]')) AS han, len(regexp_extract_all(text, '[A-Za-z]')) AS latin FROM t), s AS (SELECT *, han / greatest(han + latin, 1) AS share FROM c)
SELECT doc_id, CASE WHEN han + latin < 20 THEN 'und' WHEN share >= 0.7 THEN 'zh' WHEN share <= 0.15 THEN 'en' ELSE 'multilingual' END AS script,
  round(CASE WHEN han + latin < 20 THEN 0.0::double WHEN share >= 0.7 THEN share WHEN share <= 0.15 THEN 1 - share ELSE 1 - abs(share - 0.5) * 2 END, 4) AS confidence FROM s""")
def language_script(spark, sf_dir):
    # two fifths of the documents get Han letters of all three ranges, which the table lacks
    text = F.expr("CASE doc_id % 5 WHEN 0 THEN text || repeat('甲㐁', CAST(floor(length(text) / 2) AS int)) WHEN 1 THEN repeat('更乙', 40) || substr(text, 1, 9) ELSE text END")
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(lexical.script_parts(text))))


_PAGES = "pages_of AS (SELECT source AS family, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, text FROM documents)"


def _pages_of(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("page", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).select(F.col("source").alias("doc_id"), "page", "text", F.col("doc_id").alias("id"))


@query(f"""WITH {_PAGES}, h AS (SELECT *, row_number() OVER (PARTITION BY family, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) ORDER BY page) AS seen FROM pages_of)
SELECT family AS doc_id, page, CASE WHEN seen > 1 THEN 'duplicate' WHEN length(text) < 80 THEN 'blank' WHEN page <= 2 AND length(text) < 700 THEN 'cover' ELSE 'none' END AS reason FROM h""")
def page_exclusion(spark, sf_dir):
    return lexical.page_exclusion(_pages_of(spark, sf_dir))


@query("SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS duplicate FROM documents")
def exact_dup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("_h"))
    return identity.first_seen(docs, ["_h"], F.col("doc_id")).select("doc_id", "duplicate")


_TOKENS = "(SELECT {key} AS {name}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM {table})"
_TERMS = f"""terms AS (SELECT doc_id, token, count(*) AS tf FROM {_TOKENS.format(key='doc_id', name='doc_id', table='documents')} GROUP BY ALL),
asked AS (SELECT DISTINCT query_id, token FROM {_TOKENS.format(key='item_id', name='query_id', table='benchmark')})"""


def _corpus(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"""WITH {_TERMS}, lengths AS (SELECT doc_id, sum(tf) AS length FROM terms GROUP BY doc_id), size AS (SELECT count(*) AS n, avg(length) AS mean FROM lengths),
df AS (SELECT token, count(*) AS df FROM terms GROUP BY token),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
  FROM asked JOIN terms USING (token) JOIN df USING (token) JOIN lengths USING (doc_id), size GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def bm25_topk(spark, sf_dir):
    return lexical.bm25(*_corpus(spark, sf_dir), 10)


@query(f"WITH {_TERMS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, doc_id DESC) AS rank FROM (SELECT query_id, doc_id, count(*) AS hits FROM asked JOIN terms USING (token) GROUP BY ALL)) WHERE rank <= 10")
def postings_topk(spark, sf_dir):
    return lexical.postings_hits(*_corpus(spark, sf_dir), 10)


_BIGRAMS = "list_distinct(list_transform(range(1, greatest(length(b), 1)), lambda i: substr(b, i::int, 2)))"


@query(f"""WITH e AS (SELECT p_partkey AS id, regexp_replace(lower(concat(p_name, p_brand)), '\\s+', '', 'g') AS b FROM part), s AS (SELECT id, {_BIGRAMS} AS g FROM e),
q AS (SELECT item_id AS query_id, {_BIGRAMS} AS g FROM (SELECT item_id, regexp_replace(lower(text), '\\s+', '', 'g') AS b FROM benchmark)),
d AS (SELECT query_id, id AS evidence_id, round(2.0 * len(list_intersect(q.g, s.g)) / (len(q.g) + len(s.g)), 6) AS score FROM q, s)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, evidence_id) AS rank FROM d) WHERE rank <= 3""")
def bigram_dice_topk(spark, sf_dir):
    labels = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("evidence_id"), F.concat("p_name", "p_brand").alias("label"))
    return lexical.dice_top(labels, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 3)


_HASH = f"""{_TERMS}, bits AS (SELECT doc_id, i, sum(CASE WHEN (('0x' || substr(md5(token), 1, 15))::bigint >> i) & 1 = 1 THEN tf ELSE -tf END) AS w FROM terms, (SELECT unnest(range(60))::int AS i) GROUP BY ALL),
hashes AS (SELECT doc_id, CAST(sum(CASE WHEN w >= 0 THEN 1::bigint << i ELSE 0 END) AS bigint) AS hash FROM bits GROUP BY doc_id)"""


@query(f"WITH {_HASH} SELECT * FROM hashes")
def simhash(spark, sf_dir):
    return lexical.simhash(table(spark, sf_dir, "documents"))


@query(f"WITH {_HASH}, c AS (SELECT hash, count(*) AS rows FROM hashes GROUP BY hash) SELECT a.hash, b.hash AS other, a.rows, b.rows AS other_rows, CAST(bit_count(xor(a.hash, b.hash)) AS integer) AS distance FROM c a JOIN c b ON a.hash < b.hash WHERE bit_count(xor(a.hash, b.hash)) <= 3")
def near_dup_pairs(spark, sf_dir):
    return lexical.near_hashes(lexical.simhash(table(spark, sf_dir, "documents")))


_POOL = f"{SCORED}, pool AS (SELECT fault_id, role, family_id, evidence_id AS page_id, round(max(q), 6) AS score FROM scored GROUP BY ALL)"


@query(f"""WITH {_POOL}, a AS (SELECT *, row_number() OVER (PARTITION BY fault_id, role, family_id ORDER BY score DESC, page_id) AS i FROM pool)
SELECT fault_id, role, family_id, page_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY fault_id, role ORDER BY score DESC, page_id) AS rank FROM a WHERE i <= 3) WHERE rank <= 20""")
def pool_caps(spark, sf_dir):
    pool = scored(spark, sf_dir).groupBy("fault_id", "role", "family_id", F.col("evidence_id").alias("page_id")).agg(F.round(F.max("q"), 6).alias("score"))
    return lexical.capped(pool, 3, 20)


@query(f"""WITH {_PAGES}, p AS (SELECT family AS doc_id, page, CAST(length(text) AS double) AS score FROM pages_of)
SELECT a.doc_id, a.page AS base, b.page AS page, round(a.score - abs(b.page - a.page) * 0.5, 6) AS score FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.page BETWEEN a.page - 2 AND a.page + 2 AND a.page <> b.page""")
def adjacent_context(spark, sf_dir):
    pages = _pages_of(spark, sf_dir).select("doc_id", "page", F.char_length("text").cast("double").alias("score"))
    return lexical.adjacent(pages, 2, 0.5)


@query("SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, regexp_matches(url, '^https?://[^/]+') AS valid, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text_chars FROM pages")
def page_table(spark, sf_dir):
    text = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " "))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host"), F.col("url").rlike("^https?://[^/]+").alias("valid"), F.char_length(text).cast("long").alias("text_chars"))


# --- graph and retrieval ----------------------------------------------------

_SEEDS = "seeds AS (SELECT DISTINCT a AS node FROM edges WHERE a IN ('S-1', 'S-2', 'S-3'))"


def _links(spark, sf_dir):
    """Links written once, since every step reads them."""
    return checkpointed(edges(spark, sf_dir))


def _seeds(links):
    return links.where(F.col("a").isin("S-1", "S-2", "S-3")).select(F.col("a").alias("node")).distinct()


@query(f"""WITH {EDGES}, {_SEEDS}, h1 AS (SELECT DISTINCT b AS node FROM edges JOIN seeds ON a = node WHERE b NOT IN (SELECT node FROM seeds)),
h2 AS (SELECT DISTINCT b AS node FROM edges JOIN h1 ON a = node WHERE b NOT IN (SELECT node FROM seeds UNION SELECT node FROM h1))
SELECT node, 0 AS hop FROM seeds UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2""")
def hop2_pool(spark, sf_dir):
    links = _links(spark, sf_dir)
    return graph.hops(links, _seeds(links), 2)


@query(f"""WITH {EDGES}, {_SEEDS}, s0 AS (SELECT node, 1.0 AS score FROM seeds), n1 AS (SELECT b AS node, max(score) * 0.5 AS score FROM edges JOIN s0 ON a = node GROUP BY b),
s1 AS (SELECT node, max(score) AS score FROM (FROM s0 UNION ALL FROM n1) GROUP BY node), f1 AS (FROM n1 WHERE node NOT IN (SELECT node FROM s0)),
n2 AS (SELECT b AS node, max(score) * 0.5 AS score FROM edges JOIN f1 ON a = node GROUP BY b)
SELECT node, CAST(max(score) AS double) AS score FROM (FROM s1 UNION ALL FROM n2) GROUP BY node""")
def hop_scores(spark, sf_dir):
    links = _links(spark, sf_dir)
    return graph.hop_scores(links, _seeds(links).withColumn("score", F.lit(1.0)), 2, 0.5)


def _ppr_sql(rounds: int) -> str:
    parts = [f"WITH {EDGES}, {_SEEDS}, deg AS (SELECT a, count(*) AS d FROM edges GROUP BY a), nodes AS (SELECT n.node, CASE WHEN s.node IS NULL THEN 0.0::double ELSE 1.0::double / (SELECT count(*) FROM seeds) END AS start FROM (SELECT DISTINCT a AS node FROM edges) n LEFT JOIN seeds s ON s.node = n.node), r0 AS (SELECT node, start AS rank FROM nodes)"]
    for k in range(1, rounds + 1):
        parts.append(f"r{k} AS (SELECT n.node, 0.15::double * start + 0.85::double * coalesce(got, 0) AS rank FROM nodes n LEFT JOIN (SELECT b AS node, sum(rank / d) AS got FROM edges JOIN r{k - 1} ON a = node JOIN deg USING (a) GROUP BY b) g ON g.node = n.node)")
    return ", ".join(parts) + f" SELECT node, round(rank + 1e-9, 6) AS rank FROM r{rounds}"


@query(_ppr_sql(3).replace("0.15::double", "(1 - 0.85::double)"))
def ppr_rounds(spark, sf_dir):
    links = _links(spark, sf_dir)
    # sums come in any order; the offset moves exact fractions away from the middle between two roundings
    return graph.pagerank(links, _seeds(links), 3).select("node", F.round(F.col("rank") + 1e-9, 6).alias("rank"))


@query(_ppr_sql(12).replace("0.15::double", "(1 - 0.85::double)"))
def ppr(spark, sf_dir):
    links = _links(spark, sf_dir)
    return graph.pagerank(links, _seeds(links), 12).select("node", F.round(F.col("rank") + 1e-9, 6).alias("rank"))


_DENSE = """d AS (SELECT q.vec_id AS query_id, e.vec_id AS evidence_id, round(list_inner_product(q.embedding::double[], e.embedding::double[]), 6) AS score, e.label, q.label AS asked
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)"""


def _dense(spark, sf_dir, k):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.dense(asked, vectors.select(F.col("vec_id").alias("evidence_id"), F.col("embedding").alias("vector")), k)


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("evidence_id"), "label")


@query(f"WITH {_DENSE} SELECT query_id, evidence_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, evidence_id) AS rank FROM d) WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir, 10)


_HYBRID = f"""{_DENSE}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, evidence_id) AS r FROM d) WHERE r <= 50),
h AS (SELECT query_id, evidence_id, label, evidence_id % 7 AS family_id, evidence_id % 11 AS claim_id, round(0.65::double * (floor(score * 10000) / 10000) + 0.25 * CASE WHEN label = asked THEN 1.0 ELSE 0.0 END + 0.1 * greatest(0.0, least(1.0, (evidence_id % 10) / 10)), 6) AS hs FROM top),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hs DESC, evidence_id) AS rank FROM h)"""


def _hybrid(spark, sf_dir, k):
    labels = _labels(spark, sf_dir)
    asked = labels.select(F.col("evidence_id").alias("query_id"), F.col("label").alias("asked"))
    # four places, so that no weighted score lies half way between two roundings
    pool = _dense(spark, sf_dir, 50).select("query_id", "evidence_id", (F.floor(F.col("score") * 10000) / 10000).alias("lexical")).join(labels, "evidence_id").join(asked, "query_id")
    pool = pool.withColumns({"role_match": F.col("label") == F.col("asked"), "confidence": (F.col("evidence_id") % 10) / 10, "family_id": F.col("evidence_id") % 7, "claim_id": F.col("evidence_id") % 11})
    return retrieval.hybrid(pool, k)


@query(f"WITH {_HYBRID} SELECT query_id, evidence_id, hs AS score, rank FROM ranked WHERE rank <= 10")
def hybrid_topk(spark, sf_dir):
    return _hybrid(spark, sf_dir, 10).select("query_id", "evidence_id", "score", "rank")


@query(f"""WITH {_HYBRID}, p AS (SELECT * FROM ranked WHERE rank <= 20), s1 AS (SELECT query_id, evidence_id AS e1, family_id AS f1, claim_id AS c1, round(hs + 0.1, 9) AS g1 FROM p WHERE rank = 1),
g2 AS (SELECT p.*, e1, f1, c1, g1, round(hs + CASE WHEN family_id <> f1 THEN 0.1 ELSE 0 END - CASE WHEN claim_id = c1 THEN 0.2 ELSE 0 END, 9) AS g FROM p JOIN s1 USING (query_id) WHERE evidence_id <> e1),
s2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g DESC, rank) AS r FROM g2) WHERE r = 1),
g3 AS (SELECT p.*, s2.evidence_id AS e2, round(p.hs + CASE WHEN p.family_id NOT IN (f1, s2.family_id) THEN 0.1 ELSE 0 END - CASE WHEN p.claim_id IN (c1, s2.claim_id) THEN 0.2 ELSE 0 END, 9) AS g
  FROM p JOIN s2 USING (query_id) WHERE p.evidence_id NOT IN (e1, s2.evidence_id) AND NOT (f1 = s2.family_id AND p.family_id = f1)),
s3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g DESC, rank) AS r FROM g3) WHERE r = 1)
SELECT query_id, CAST(1 AS bigint) AS position, e1 AS evidence_id, round(g1, 6) AS gain FROM s1 UNION ALL SELECT query_id, 2, evidence_id, round(g, 6) FROM s2 UNION ALL SELECT query_id, 3, evidence_id, round(g, 6) FROM s3""")
def budget_select(spark, sf_dir):
    return retrieval.select(_hybrid(spark, sf_dir, 20).select("query_id", "rank", "evidence_id", "family_id", "claim_id", "score"), 3)


_RELEVANT = "rel AS (SELECT q.vec_id AS query_id, e.vec_id AS evidence_id FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)"


@query(f"""WITH {_HYBRID}, {_RELEVANT}, t AS (SELECT r.*, rel.evidence_id IS NOT NULL AS hit FROM ranked r LEFT JOIN rel USING (query_id, evidence_id) WHERE rank <= 10),
g AS (SELECT query_id, count_if(hit) AS hits, min(CASE WHEN hit THEN rank END) AS first, coalesce(sum(CASE WHEN hit THEN 1 / log2(rank + 1) END), 0) AS dcg, count(*) AS returned FROM t GROUP BY query_id),
w AS (SELECT query_id, count(*) AS wanted FROM rel GROUP BY query_id)
SELECT query_id, round(hits / wanted, 6) AS recall, round(coalesce(1 / first, 0), 6) AS mrr, round(dcg / list_sum(list_transform(range(1, least(wanted, returned) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM w JOIN g USING (query_id)""")
def retrieval_metrics(spark, sf_dir):
    labels = _labels(spark, sf_dir)
    asked = labels.where("evidence_id % 20 = 0").select(F.col("evidence_id").alias("query_id"), "label")
    ranked = checkpointed(_hybrid(spark, sf_dir, 10))
    return evaluation.ranking_metrics(ranked, evaluation.relevant_by_key(asked, labels, ranked, "label"), 10)


_ENDS = "list_distinct([{t}.claim_id, {t}.family_id])"


@query(f"""WITH {_HYBRID}, o AS (SELECT a.query_id, {_ENDS.format(t='a')} AS x, {_ENDS.format(t='b')} AS y, a.claim_id = b.claim_id AS same FROM ranked a JOIN ranked b ON a.query_id = b.query_id AND a.rank < b.rank WHERE a.rank <= 5 AND b.rank <= 5)
SELECT query_id, round(avg(CASE WHEN same THEN 1.0::double ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END), 6) AS overlap, count(*) AS pairs FROM o GROUP BY query_id""")
def endpoint_overlap(spark, sf_dir):
    top = _hybrid(spark, sf_dir, 5).select("query_id", "rank", "claim_id", F.array_distinct(F.array("claim_id", "family_id")).alias("ends"))
    return retrieval.pair_overlap(top)


_RELATED = f"""{ASSERTIONS}, n AS (SELECT i.item_id AS query_id, a.evidence_id, a.confidence, a.fault_id = i.item_id % 10 AS same_fault, a.role = i.item_id % 4 AS same_role, a.family_id = i.item_id % 25 AS relevant FROM benchmark i CROSS JOIN assertions a)"""


@query(f"WITH {_RELATED} SELECT query_id, evidence_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY same_fault AND same_role DESC, same_role DESC, confidence DESC, evidence_id DESC) AS rank FROM n WHERE NOT relevant) WHERE rank <= 15")
def hard_negatives(spark, sf_dir):
    item = F.col("item_id")
    items = table(spark, sf_dir, "benchmark").select(item.alias("query_id"), (item % 10).alias("fault_id"), (item % 4).alias("role"), (item % 25).alias("family_id"))
    return retrieval.hard_negatives(items, assertions(spark, sf_dir), 15)


@query("SELECT query_id, rank, tokens, used FROM (SELECT conv_id AS query_id, turn AS rank, length(text) // 4 + 1 AS tokens, CAST(sum(length(text) // 4 + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS bigint) AS used FROM conversations) WHERE used <= 256")
def prompt_budget(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), (F.floor(F.char_length("text") / 4) + 1).alias("tokens"))
    return retrieval.within_budget(turns, 256)


# --- evaluation -------------------------------------------------------------


@query(f"WITH {RUNS} SELECT method, repeat, count(*) AS runs, round(avg(latency), 6) AS mean, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95 FROM runs GROUP BY ALL")
def latency_percentiles(spark, sf_dir):
    return evaluation.latency_table(ranked_runs(spark, sf_dir), "method", "repeat")


@query(f"WITH {RUNS}, m AS (SELECT method, query_id, quantile_cont(latency, 0.5) AS m FROM runs GROUP BY ALL) SELECT query_id, round(b.m - a.m, 6) AS delta FROM (FROM m WHERE method = 'click') a JOIN (FROM m WHERE method = 'error') b USING (query_id)")
def paired_delta(spark, sf_dir):
    return evaluation.paired(ranked_runs(spark, sf_dir), "click", "error")


@query(f"WITH {RUNS} SELECT method, query_id, count(DISTINCT repeat) AS repeats, round(CASE WHEN count(DISTINCT repeat) = 3 THEN quantile_cont(latency, 0.5) END, 6) AS median FROM runs GROUP BY ALL")
def repeat_pairing(spark, sf_dir):
    return evaluation.repeat_guard(ranked_runs(spark, sf_dir), 3)


@query("WITH p AS (SELECT p_partkey AS id, p_retailprice AS price, CAST(p_size AS double) AS gain FROM part) SELECT id, price, gain FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.price <= p.price AND o.gain >= p.gain AND (o.price < p.price OR o.gain > p.gain))")
def pareto_front(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("gain"))
    return evaluation.pareto_front(parts, "id", "price", "gain")


@query("SELECT c_mktsegment AS segment, count(*) AS customers, round(corr(c_acctbal, c_nationkey), 6) AS r FROM customer GROUP BY ALL")
def corr_audit(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("customers"), F.round(F.corr("c_acctbal", "c_nationkey"), 6).alias("r"))


_DRAW = "('0x' || substr(md5(concat_ws(':', 7, replicate, slot)), 1, 15))::bigint % n"


@query(f"""WITH {SCORED}, c AS (SELECT family_id AS cluster, sum(CASE WHEN q >= 0.9 THEN 1 ELSE 0 END) AS numerator, count(*) AS denominator, row_number() OVER (ORDER BY family_id) - 1 AS slot FROM scored GROUP BY family_id),
d AS (SELECT replicate, {_DRAW} AS i FROM c, (SELECT unnest(range(200)) AS replicate), (SELECT count(*) AS n FROM c))
SELECT CAST(replicate AS integer) AS replicate, round(sum(numerator) / sum(denominator), 6) AS value FROM d JOIN c ON c.slot = i GROUP BY replicate""")
def bootstrap_cluster(spark, sf_dir):
    per = scored(spark, sf_dir).groupBy(F.col("family_id").alias("cluster")).agg(F.count_if(F.col("q") >= 0.9).alias("numerator"), F.count("*").alias("denominator"))
    return evaluation.bootstrap(per, 200)


@query(f"""WITH {SCORED}, c AS (SELECT family_id AS cluster, sum(CASE WHEN q >= 0.9 THEN 1 ELSE 0 END) AS numerator, count(*) AS denominator, row_number() OVER (ORDER BY family_id) - 1 AS slot FROM scored GROUP BY family_id),
d AS (SELECT replicate, {_DRAW} AS i FROM c, (SELECT unnest(range(200)) AS replicate), (SELECT count(*) AS n FROM c)), v AS (SELECT round(sum(numerator) / sum(denominator), 6) AS value FROM d JOIN c ON c.slot = i GROUP BY replicate)
SELECT round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, round(avg(value), 6) AS mean FROM v""")
def bootstrap_interval(spark, sf_dir):
    return evaluation.interval(bootstrap_cluster(spark, sf_dir))


@query("SELECT item_id AS query_id, CAST(r AS integer) AS repeat, CAST(p AS integer) AS position, CAST((p + item_id + r) % 4 AS bigint) AS method FROM benchmark, (SELECT unnest(range(3)) AS r), (SELECT unnest(range(4)) AS p)")
def rotation_schedule(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("repeat")).withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return items.withColumn("method", evaluation.rotation(4, F.col("query_id"), F.col("repeat"), F.col("position")))


@query(f"""WITH {SCORED}, p AS (SELECT doc_id, fault_id, round(count_if(q >= 0.8) / count(*), 6) AS r FROM scored GROUP BY ALL) SELECT fault_id, round(avg(2 * least(r, 1) / (1 + least(r, 1))), 6) AS f1, count(*) AS queries FROM p GROUP BY fault_id""")
def oracle_f1(spark, sf_dir):
    per = scored(spark, sf_dir).groupBy("doc_id", "fault_id").agg(F.round(F.count_if(F.col("q") >= 0.8) / F.count("*"), 6).alias("r"))
    return per.groupBy("fault_id").agg(F.round(F.avg(2 * F.least("r", F.lit(1.0)) / (1 + F.least("r", F.lit(1.0)))), 6).alias("f1"), F.count("*").alias("queries"))
