"""Queries over competency answers, traceability and release reasons, with their equivalents in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veinworks.functions.storage import checkpointed
from veinworks.operators import competency, gates, graph
from veinworks.plans.bindings import ASSERTIONS, SCORED, assertions, table
from veinworks.plans.catalogue import _CQ, _PATHS, query, scored

# --- competency answers: parts and suppliers on typed paths, line items as their evidence -----------

_RELEASED = "split = 'build_train' AND level IN ('E1', 'E2') AND NOT inferred AND status = 'entailed'"
_FOUND = f"""{_CQ}, {ASSERTIONS}, on_paths AS (SELECT DISTINCT fault_id, role, concat(relation, '/', head_type, '/', tail_type) AS path_id, concat(head, '-', tail) AS claim_id, tail AS answer_id FROM typed JOIN paths USING (relation, head_type, tail_type)),
good AS (SELECT DISTINCT concat(claim_id, '-', tail_id) AS claim_id, evidence_id, doc_id, family_id, true AS held FROM assertions WHERE {_RELEASED}),
met AS (SELECT p.*, g.evidence_id, g.doc_id, g.family_id, coalesce(g.held, false) AS held FROM on_paths p LEFT JOIN good g USING (claim_id)),
found AS (SELECT fault_id, role, answer_id, bool_or(held) AS traceable, list_sort(coalesce(list(DISTINCT claim_id) FILTER (held), [])) AS claim_ids, list_sort(coalesce(list(DISTINCT evidence_id) FILTER (held), [])) AS evidence_ids, list_sort(coalesce(list(DISTINCT doc_id) FILTER (held), [])) AS doc_ids,
  list_sort(coalesce(list(DISTINCT family_id) FILTER (held), [])) AS family_ids, list_sort(coalesce(list(DISTINCT path_id) FILTER (held), [])) AS path_ids FROM met GROUP BY ALL)"""


def _evidence(spark, sf_dir):
    rows = assertions(spark, sf_dir)
    return rows.select(F.concat_ws("-", "claim_id", "tail_id").alias("claim_id"), "evidence_id", "doc_id", "family_id", F.expr(_RELEASED).alias("released"), F.when(F.col("doc_id") % 13 == 0, None).otherwise(F.col("status")).alias("provenance"))


def _found(spark, sf_dir):
    claims = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("h"), F.col("l_suppkey").alias("t")).distinct()
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("h"), (F.col("p_size") % 15).alias("relation"), F.col("p_type").alias("type"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("t"), F.concat(F.lit("S"), F.col("s_nationkey") % 5).alias("type"))
    entities = parts.select(F.concat(F.lit("P"), "h").alias("entity"), "type").union(suppliers.select(F.concat(F.lit("S"), "t"), "type"))
    facts = claims.join(parts.drop("type"), "h").select("h", "t", "relation", F.concat(F.lit("P"), "h").alias("head"), F.concat(F.lit("S"), "t").alias("tail"))
    paths = spark.createDataFrame(_PATHS, "relation int, head_type string, tail_type string, role int")
    legal = graph.metapaths(facts, entities, paths)
    on_paths = legal.select((F.col("h") % 10).alias("fault_id"), "role", F.concat_ws("/", "relation", "head_type", "tail_type").alias("path_id"), F.concat_ws("-", "h", "t").alias("claim_id"), F.col("t").alias("answer_id"))
    return competency.answers(on_paths, _evidence(spark, sf_dir))


@query(f"WITH {_FOUND.removeprefix('WITH ')} SELECT fault_id, role, answer_id, traceable, " + ", ".join(f"array_to_string({c}_ids, ',') AS {c}_ids" for c in ("claim", "evidence", "doc", "family", "path")) + " FROM found")
def competency_answers(spark, sf_dir):
    found = _found(spark, sf_dir)
    return found.select("fault_id", "role", "answer_id", "traceable", *(F.array_join(F.col(f"{c}_ids").cast("array<string>"), ",").alias(f"{c}_ids") for c in ("claim", "evidence", "doc", "family", "path")))


_TASKS = "tasks AS (SELECT f AS fault_id, r AS role FROM range(12) a(f), range(5) b(r))"
_SIZES = ", ".join(f"CAST(coalesce(len(list_distinct(flatten(list({c}_ids)))), 0) AS bigint) AS {c}s" for c in ("claim", "evidence", "doc", "family", "path"))


@query(f"""WITH {_FOUND.removeprefix('WITH ')}, {_TASKS}, per AS (SELECT fault_id, role, count(answer_id) AS semantic_answers, CAST(coalesce(count_if(traceable), 0) AS bigint) AS answers, {_SIZES} FROM tasks LEFT JOIN found USING (fault_id, role) GROUP BY ALL)
SELECT *, CASE WHEN semantic_answers = 0 THEN '{competency.NO_PATH}' WHEN answers = 0 THEN '{competency.NO_EVIDENCE}' WHEN answers < 10 THEN '{competency.TOO_FEW}' END AS reason FROM per""")
def competency_outcomes(spark, sf_dir):
    tasks = spark.range(12).select(F.col("id").alias("fault_id")).join(F.broadcast(spark.range(5).select(F.col("id").cast("int").alias("role"))))  # a list of 60 tasks
    return competency.outcomes(tasks, checkpointed(_found(spark, sf_dir)), 10)


@query(f"""WITH {_FOUND.removeprefix('WITH ')}, used AS (SELECT DISTINCT unnest(evidence_ids) AS evidence_id FROM found), prov AS (SELECT evidence_id, bool_and(doc_id % 13 <> 0) AS ok FROM assertions SEMI JOIN used USING (evidence_id) GROUP BY evidence_id),
r AS (SELECT 'answers_with_evidence' AS measure, count(*) AS population, CAST(count_if(traceable) AS bigint) AS satisfied FROM found UNION ALL SELECT 'evidence_with_provenance', count(*), CAST(count_if(ok) AS bigint) FROM prov
  UNION ALL SELECT 'answers_with_documents', count(*), CAST(count_if(len(doc_ids) > 0 AND len(family_ids) > 0) AS bigint) FROM found WHERE traceable)
SELECT *, round(coalesce(satisfied / nullif(population, 0), 0), 6) AS ratio FROM r""")
def traceability_ratios(spark, sf_dir):
    return competency.traceability(checkpointed(_found(spark, sf_dir)), _evidence(spark, sf_dir), ("provenance", "doc_id"))


# --- release reasons ----------------------------------------------------------------------------------

_RECORD = {
    "evidence_id": "evidence_id",
    "decision": "CASE claim_id % 9 WHEN 0 THEN 'rejected' WHEN 1 THEN NULL WHEN 2 THEN 'accepted_silver' ELSE 'silver_candidate' END",
    "split": "split",
    "level": "CASE WHEN claim_id % 31 = 3 THEN NULL ELSE level END",
    "inferred": "CASE WHEN claim_id % 17 = 4 THEN NULL ELSE inferred END",
    "claim_id": "CASE WHEN claim_id % 47 = 5 THEN ' ' ELSE CAST(claim_id AS {text}) END",
    "doc_id": "CASE WHEN claim_id % 53 = 6 THEN NULL ELSE CAST(doc_id AS {text}) END",
    "family_id": "CASE WHEN claim_id % 59 = 7 THEN '' ELSE CAST(family_id AS {text}) END",
    "relation_type_valid": "CASE WHEN claim_id % 19 = 8 THEN NULL ELSE claim_id % 23 <> 9 END",
    "status": "status",
    "evidence_valid": "claim_id % 29 <> 10",
    "evidence_silver": "CASE WHEN claim_id % 37 = 11 THEN NULL ELSE tail_id % 11 <> 1 END",
    "entailment_silver": "tail_id % 13 <> 2",
    "q": "q",
}


def _record(text: str) -> dict[str, str]:
    return {n: e.format(text=text) for n, e in _RECORD.items()}


_TOLD = ", ".join(f"CASE WHEN coalesce({t.format(minimum='0.8::double')}, true) THEN '{n}' END" for n, t in gates.RELEASE_REASONS.items())


@query(f"""WITH {SCORED}, records AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _record('varchar').items())} FROM scored), build AS (SELECT DISTINCT CAST(o_orderkey AS varchar) AS d FROM orders WHERE o_orderkey % 6 <> 5),
told AS (SELECT r.*, d IS NOT NULL AS frozen FROM records r LEFT JOIN build ON d = doc_id) SELECT evidence_id, array_to_string(list_filter([{_TOLD}], lambda x: x IS NOT NULL), ',') AS reasons FROM told""")
def release_reasons(spark, sf_dir):
    rows = scored(spark, sf_dir).selectExpr(*(f"{e} AS {n}" for n, e in _record("string").items()))
    build = table(spark, sf_dir, "orders").where("o_orderkey % 6 <> 5").select(F.col("o_orderkey").alias("doc_id"))
    return gates.release_reasons(rows, build, 0.8).select("evidence_id", F.array_join("reasons", ",").alias("reasons"))
