"""Queries over extracted candidates and hybrid retrieval, with their equivalents in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veinworks.operators import candidates, hybrid, retrieval
from veinworks.plans.bindings import table
from veinworks.plans.catalogue import query

# --- candidates: parts as extracted records, bound so that every reason and outcome occurs --------

_FIELDS = {
    "candidate_id": "p_partkey",
    "head": "split_part(p_name, ' ', 1)",
    "tail": "split_part(p_name, ' ', 2)",
    "relation": "CASE p_partkey % 7 WHEN 0 THEN 'causes' WHEN 1 THEN 'indicates' WHEN 2 THEN 'detects' WHEN 3 THEN 'mitigates' WHEN 4 THEN 'caused_by' WHEN 5 THEN 'causes' ELSE 'drives' END",
    "head_type": "CASE WHEN p_partkey % 11 = 0 THEN 'other' ELSE CASE p_partkey % 7 WHEN 1 THEN 'symptom' WHEN 2 THEN 'method' WHEN 3 THEN 'action' WHEN 4 THEN 'fault' ELSE 'cause' END END",
    "tail_type": "CASE WHEN p_partkey % 13 = 0 THEN 'other' WHEN p_partkey % 7 = 4 THEN 'cause' ELSE 'fault' END",
    "verb": "CASE p_partkey % 3 WHEN 0 THEN 'Causes' WHEN 1 THEN 'is a sign of' ELSE 'and' END",
    "structured": "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'detects' ELSE CASE p_partkey % 7 WHEN 1 THEN 'indicates' WHEN 2 THEN 'detects' WHEN 3 THEN 'mitigates' ELSE 'causes' END END",
    "checked": "p_partkey % 31 <> 1",
    "split": "CASE WHEN p_partkey % 10 = 3 THEN 'held_out_test' ELSE 'build_train' END",
    "inferred": "p_partkey % 37 = 0",
    "confidence": "round(1 - CAST(p_partkey % 50 AS double) / 100, 2)",
}
_SHOWN = "CASE WHEN candidate_id % 19 = 0 THEN 'none' WHEN candidate_id % 17 = 0 THEN upper(head) ELSE head END"
_FAR = "CASE WHEN candidate_id % 12 = 0 THEN repeat('and then ', 100) ELSE '' END"
_TEXT = f"CASE WHEN candidate_id % 29 = 0 THEN NULL ELSE 'Report: ' || {_SHOWN} || ' ' || verb || ' ' || {_FAR} || tail || ' end.' END"
_EVIDENCE = f"CASE WHEN candidate_id % 23 = 0 THEN 'it ... ends' WHEN candidate_id % 4 = 0 THEN 'not on the page' WHEN candidate_id % 9 = 2 THEN 'Report:' ELSE {_SHOWN} || ' ' || verb || ' ' || tail END"
_CANDIDATES = f"""fields AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _FIELDS.items())} FROM part),
cand AS (SELECT *, {_TEXT} AS text, {_EVIDENCE} AS evidence FROM fields)"""

_CELL = {
    "candidate_id": "candidate_id",
    "table_id": "CASE WHEN candidate_id % 43 = 1 THEN '' WHEN candidate_id % 13 = 7 AND i = 1 THEN 'T2' ELSE 'T1' END",
    "row_id": "CASE WHEN candidate_id % 47 = 1 THEN NULL WHEN candidate_id % 4 = 3 AND i = 1 THEN 'r1' ELSE 'r0' END",
    "column_name": "CASE WHEN candidate_id % 41 = 1 THEN ' ' ELSE 'c' END",
    "group_id": "CASE WHEN candidate_id % 8 = 3 OR i = 0 THEN 'g' ELSE NULL END",
    "start": "CASE WHEN candidate_id % 3 = 2 THEN -1 ELSE instr(text, CASE WHEN i = 0 THEN head ELSE tail END) - 1 + CASE WHEN candidate_id % 9 = 1 THEN 1 ELSE 0 END END",
    "length": "length(CASE WHEN i = 0 THEN head ELSE tail END)",
    "cell": "CASE WHEN candidate_id % 7 = 2 AND i = 1 THEN 'blank' WHEN i = 0 THEN head ELSE tail END",
    "has_box": "candidate_id % 16 <> 5",
}


def _candidates(spark, sf_dir):
    fields = table(spark, sf_dir, "part").selectExpr(*(f"{e} AS {n}" for n, e in _FIELDS.items()))
    return fields.selectExpr("*", f"{_TEXT} AS text", f"{_EVIDENCE} AS evidence").drop("verb")


def _cells(rows):
    two = rows.where("candidate_id % 5 = 1").withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    return two.selectExpr(*(f"{e} AS {n}" for n, e in _CELL.items())).withColumn("end", F.col("start") + F.col("length")).drop("length")


_RULES = [("caused_by", "fault", "cause", "causes", True)]
_CUES = {"causes": r"\bcauses\b", "indicates": r"\bsign of\b", "detects": r"\bsign\b", "mitigates": r"\band\b"}
_TURNED = """turned AS (SELECT * REPLACE (CASE WHEN t THEN tail ELSE head END AS head, CASE WHEN t THEN head ELSE tail END AS tail, CASE WHEN t THEN 'causes' ELSE relation END AS relation,
  CASE WHEN t THEN tail_type ELSE head_type END AS head_type, CASE WHEN t THEN head_type ELSE tail_type END AS tail_type) FROM (SELECT *, relation = 'caused_by' AND head_type = 'fault' AND tail_type = 'cause' AS t FROM cand))"""
_AT = "CASE WHEN instr(text, {0}) > 0 THEN instr(text, {0}) ELSE instr(lower(text), lower({0})) END"
_SPANS = f"""spots AS (SELECT *, {_AT.format("head")} AS h, {_AT.format("tail")} AS ta, {_AT.format("evidence")} AS ev, contains(lower(evidence), lower(head)) AS hq, contains(lower(evidence), lower(tail)) AS tq FROM {{0}}),
spans AS (SELECT *, CASE WHEN text IS NULL OR contains(evidence, '...') THEN NULL WHEN ev > 0 THEN 'E1' WHEN h > 0 AND ta > 0 THEN 'E3' END AS level,
  list_filter(CASE WHEN text IS NULL THEN ['text_missing'] WHEN contains(evidence, '...') THEN ['quote_with_ellipsis'] WHEN ev > 0 THEN [CASE WHEN NOT hq THEN 'head_not_in_quote' END, CASE WHEN NOT tq THEN 'tail_not_in_quote' END]
    WHEN h = 0 OR ta = 0 THEN [CASE WHEN h = 0 THEN 'head_not_in_text' END, CASE WHEN ta = 0 THEN 'tail_not_in_text' END]
    WHEN greatest(h + length(head), ta + length(tail)) - least(h, ta) > 700 THEN ['surfaces_too_far_apart'] ELSE [] END, lambda x: x IS NOT NULL) AS span_reasons FROM spots)"""


@query(f"WITH {_CANDIDATES}, {_SPANS.format('cand')} SELECT candidate_id, level, array_to_string(span_reasons, ',') AS reasons FROM spans")
def span_levels(spark, sf_dir):
    return candidates.span_levels(_candidates(spark, sf_dir)).select("candidate_id", "level", F.array_join("span_reasons", ",").alias("reasons"))


_CELLS = f"""cells AS (SELECT *, start + length AS stop FROM (SELECT {", ".join(f"{e} AS {n}" for n, e in _CELL.items())} FROM cand, (SELECT unnest([0, 1]) AS i) WHERE candidate_id % 5 = 1)),
met AS (SELECT c.*, t.text, t.head, t.tail, t.checked, coalesce(start >= 0 AND stop > start AND stop <= length(text), false) AS placed FROM cells c JOIN {{0}} t USING (candidate_id)),
per AS (SELECT candidate_id, count(DISTINCT nullif(trim(table_id), '')) AS tables, count(DISTINCT row_id) = 1 AS one_row, count(DISTINCT group_id) = 1 AND count(group_id) = 2 AS one_group,
  bool_or(contains(lower(cell), lower(head))) AS hc, bool_or(contains(lower(cell), lower(tail))) AS tc, bool_and(checked) AS checked, bool_or(trim(table_id) = '') AS no_table, bool_or(row_id IS NULL) AS no_row, bool_or(trim(column_name) = '') AS no_column,
  bool_or(placed AND substr(text, start + 1, length) <> cell) AS moved, bool_or(NOT placed AND NOT has_box) AS nowhere, count_if(NOT placed AND has_box) AS boxed FROM met GROUP BY candidate_id),
aligned AS (SELECT candidate_id, hc, tc, boxed, CASE WHEN one_row THEN 'row' WHEN one_group THEN 'merged_rows' ELSE 'unaligned' END AS method, list_filter([CASE WHEN NOT checked THEN 'layout_not_checked' END, CASE WHEN no_table THEN 'table_id_missing' END,
  CASE WHEN no_row THEN 'row_id_missing' END, CASE WHEN no_column THEN 'column_name_missing' END, CASE WHEN tables > 1 THEN 'several_tables' END, CASE WHEN NOT one_row AND NOT one_group THEN 'several_rows' END, CASE WHEN moved THEN 'cell_text_differs' END,
  CASE WHEN nowhere THEN 'cell_without_place' END, CASE WHEN NOT hc THEN 'head_not_in_cells' END, CASE WHEN NOT tc THEN 'tail_not_in_cells' END], lambda x: x IS NOT NULL) AS cell_reasons FROM per)"""


@query(f"WITH {_CANDIDATES}, {_CELLS.format('cand')} SELECT candidate_id, method, array_to_string(cell_reasons, ',') AS reasons, CAST(boxed AS bigint) AS boxed FROM aligned")
def table_alignment(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    return candidates.aligned(rows, _cells(rows)).select("candidate_id", "method", F.array_join("cell_reasons", ",").alias("reasons"), "boxed")


@query(f"""WITH {_CANDIDATES}, {_TURNED}, {_SPANS.format("turned")}, {_CELLS.format("turned")},
x AS (SELECT s.* EXCLUDE (level), a.method, CASE WHEN a.method IS NOT NULL THEN 'E2' ELSE s.level END AS level, CASE WHEN a.method IS NOT NULL THEN cell_reasons ELSE span_reasons END AS place, CASE WHEN a.method IS NOT NULL THEN hc AND tc WHEN s.level = 'E3' THEN true ELSE hq AND tq END AS held,
  list_filter(CASE WHEN relation NOT IN ('causes', 'indicates', 'detects', 'mitigates') THEN ['relation_unknown'] ELSE [CASE WHEN head_type <> CASE relation WHEN 'causes' THEN 'cause' WHEN 'indicates' THEN 'symptom' WHEN 'detects' THEN 'method' ELSE 'action' END THEN 'head_type_outside_domain' END,
    CASE WHEN tail_type <> 'fault' THEN 'tail_type_outside_range' END] END, lambda r: r IS NOT NULL) AS type_reasons FROM spans s LEFT JOIN aligned a USING (candidate_id)),
y AS (SELECT *, CASE WHEN level IS NULL OR NOT held THEN 'not_entailed' WHEN level = 'E3' THEN 'undetermined' WHEN level = 'E2' THEN CASE WHEN structured IS NULL THEN 'undetermined' WHEN structured = relation THEN 'entailed' ELSE 'not_entailed' END
  WHEN regexp_matches(evidence, CASE relation WHEN 'causes' THEN '(?i)\\bcauses\\b' WHEN 'indicates' THEN '(?i)\\bsign of\\b' WHEN 'detects' THEN '(?i)\\bsign\\b' WHEN 'mitigates' THEN '(?i)\\band\\b' ELSE 'never ever' END) THEN 'entailed' ELSE 'undetermined' END AS status FROM x),
z AS (SELECT *, round(confidence * CASE level WHEN 'E1' THEN 1.0::double WHEN 'E2' THEN 0.95::double WHEN 'E3' THEN 0.75::double ELSE 0 END * CASE status WHEN 'entailed' THEN 1.0::double WHEN 'undetermined' THEN 0.75::double ELSE 0 END, 6) AS final,
  list_filter([CASE WHEN len(type_reasons) > 0 THEN 'relation_type_invalid' END, CASE WHEN len(place) > 0 THEN 'evidence_invalid' END, CASE WHEN status = 'not_entailed' THEN 'relation_not_entailed' END], lambda r: r IS NOT NULL) AS fatal,
  list_filter([CASE WHEN status = 'undetermined' THEN 'entailment_undetermined' END, CASE WHEN level = 'E3' THEN 'level_not_automatic' END, CASE WHEN inferred THEN 'inferred' END, CASE WHEN split = 'held_out_test' THEN 'held_out' END], lambda r: r IS NOT NULL) AS vetoes FROM y)
SELECT candidate_id, head, relation, tail, level, method, status, final, CASE WHEN len(fatal) > 0 THEN 'rejected' WHEN final >= 0.8 AND len(vetoes) = 0 THEN 'silver' WHEN final >= 0.6 THEN 'review' ELSE 'rejected' END AS decision,
  array_to_string(list_concat(fatal, vetoes, CASE WHEN len(fatal) = 0 AND final < 0.6 THEN ['confidence_too_low'] ELSE [] END, type_reasons, place), ',') AS reasons FROM z""")
def validated_candidates(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    kinds = [("causes", ["cause"], ["fault"]), ("indicates", ["symptom"], ["fault"]), ("detects", ["method"], ["fault"]), ("mitigates", ["action"], ["fault"])]
    constraints = spark.createDataFrame(kinds, "relation string, heads array<string>, tails array<string>")
    return candidates.validated(rows, _cells(rows), constraints, _RULES, _CUES).withColumn("reasons", F.array_join("reasons", ","))


# --- hybrid retrieval: embeddings as evidence on a chain of nodes, every twentieth a query ---------

_EVIDENCE_FIELDS = {
    "evidence_id": "vec_id",
    "head_id": "'H' || CAST(floor(vec_id / 5) AS bigint)",
    "tail_id": "'T' || CAST(floor((vec_id + 3) / 7) AS bigint)",
    "head_label": "'part' || vec_id % 97",
    "tail_label": "'unit' || vec_id % 89",
    "role": "CAST(label AS bigint)",
    "family_id": "vec_id % 7",
    "claim_id": "vec_id % 11",
    "confidence": "CAST(vec_id % 10 AS double) / 10",
}
_QUERY_FIELDS = {"query_id": "vec_id", "role": "CASE WHEN vec_id % 60 = 0 THEN 99 ELSE CAST(label AS bigint) END", "fault_name": "'part' || vec_id % 13"}
_HITS, _ANCHORS, _FLOOR, _ROUNDS = 20, 4, 0.4, 3


def _nodes_sql(pool: str) -> str:
    """Steps of a query's walk, one common table expression each."""
    parts = [
        f"a0 AS (SELECT query_id, node, CAST(max(dense) AS double) AS best, CAST(sum(dense) AS double) AS total FROM (SELECT query_id, greatest(dense, 0) AS dense, unnest([head_id, tail_id]) AS node FROM hits JOIN ev USING (evidence_id) WHERE rank <= {_ANCHORS}) GROUP BY ALL)",
        "edges AS (SELECT DISTINCT head_id AS a, tail_id AS b FROM ev UNION SELECT DISTINCT tail_id, head_id FROM ev)",
    ]
    if pool == "spread":
        parts.append("deg AS (SELECT a, count(*) AS d FROM edges GROUP BY a), start AS (SELECT query_id, node, total / sum(total) OVER (PARTITION BY query_id) AS s FROM a0), e0 AS (SELECT query_id, node, s AS energy FROM start)")
        for i in range(1, _ROUNDS + 1):
            parts.append(f"e{i} AS (SELECT query_id, node, sum(energy) AS energy FROM (SELECT query_id, b AS node, 0.85::double * energy / d AS energy FROM e{i - 1} JOIN edges ON a = node JOIN deg USING (a) UNION ALL SELECT query_id, node, (1 - 0.85::double) * s FROM start) GROUP BY ALL)")
        last = f"e{_ROUNDS}"
        parts.append(f"nodes AS (SELECT query_id, node, 0.0::double AS score FROM {last} JOIN (SELECT query_id, avg(energy) + 0.5 * stddev_pop(energy) AS least FROM {last} GROUP BY query_id) USING (query_id) WHERE energy >= least UNION SELECT query_id, node, 0.0::double FROM a0)")
    else:
        parts.append("near AS (SELECT query_id, b AS node, max(best) * 0.7::double AS score FROM a0 JOIN edges ON a = node GROUP BY ALL), nodes AS (SELECT query_id, node, max(score) AS score FROM (SELECT query_id, node, best AS score FROM a0 UNION ALL FROM near) GROUP BY ALL)")
    parts.append("met AS (SELECT query_id, evidence_id, max(score) AS graph FROM nodes JOIN (SELECT evidence_id, unnest([head_id, tail_id]) AS node FROM ev) USING (node) GROUP BY ALL)")
    return ", ".join(parts)


def _retrieved_sql(m: hybrid.Method) -> str:
    columns = lambda fields: ", ".join(f"{e} AS {n}" for n, e in fields.items())
    parts = [
        f"ev AS (SELECT {columns(_EVIDENCE_FIELDS)} FROM embeddings), asked AS (SELECT {columns(_QUERY_FIELDS)} FROM embeddings WHERE vec_id % 20 = 0)",
        "d AS (SELECT q.vec_id AS query_id, e.vec_id AS evidence_id, round(list_inner_product(q.embedding::double[], e.embedding::double[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)",
        f"hits AS (SELECT query_id, evidence_id, floor(score * 10000) / 10000 AS dense, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, evidence_id) AS rank FROM d) WHERE rank <= {_HITS})",
    ]
    if m.pool == "hits":
        parts.append("pool AS (SELECT query_id, evidence_id, dense, 0.0::double AS graph FROM hits)")
    elif m.pool == "near":
        parts += [_nodes_sql(m.pool), "pool AS (SELECT query_id, evidence_id, coalesce(dense, 0) AS dense, coalesce(graph, 0) AS graph FROM hits FULL JOIN met USING (query_id, evidence_id))"]
    else:
        parts += [_nodes_sql(m.pool), "pool AS (SELECT query_id, evidence_id, coalesce(dense, 0) AS dense, 0.0::double AS graph FROM met LEFT JOIN hits USING (query_id, evidence_id))"]
    pairs = "list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))"
    distinct = lambda c: f"list_distinct({pairs.format(c)})"
    likeness = lambda c: f"2.0::double * len(list_intersect({distinct('fault_name')}, {distinct(c)})) / (len({distinct('fault_name')}) + len({distinct(c)}))"
    like = f"greatest({likeness('head_label')}, {likeness('tail_label')})" if m.affinity else "0.0::double"
    weight = "0.2::double" if m.affinity else "0.0::double"
    gate = "WHERE ev.role = asked.role OR NOT bool_or(ev.role = asked.role) OVER (PARTITION BY query_id)" if m.role_gate else ""
    gate = gate.replace("WHERE", "QUALIFY")
    floor = f"WHERE likeness >= {_FLOOR}" if m.affinity else ""
    parts.append(f"g AS (SELECT query_id, evidence_id, dense, graph, confidence, family_id, claim_id, head_id, tail_id, {like} AS likeness FROM pool JOIN ev USING (evidence_id) JOIN asked USING (query_id) {gate})")
    parts.append(f"s AS (SELECT *, round(dense + 0.12::double * graph + 0.1::double * confidence + {weight} * likeness + 1e-9, 6) AS score FROM g {floor})")
    parts.append("ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, evidence_id DESC) AS rank FROM s)")
    if not m.greedy:
        return f"WITH {', '.join(parts)} SELECT query_id, rank AS position, evidence_id, score FROM ranked WHERE rank <= 3"
    overlap = lambda t: f"CASE WHEN p.claim_id = {t}.claim_id THEN 1.0::double ELSE ((p.head_id = {t}.head_id)::int + (p.tail_id = {t}.tail_id)::int)::double / (4 - (p.head_id = {t}.head_id)::int - (p.tail_id = {t}.tail_id)::int) END"
    bonus, penalty = ("0.1::double" if m.families else "0.0::double"), ("0.2::double" if m.redundancy else "0.0::double")
    best = lambda rows: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, rank) AS n FROM {rows}) WHERE n = 1)"
    cap = "AND NOT (t1.family_id = t2.family_id AND p.family_id = t1.family_id)" if m.families else ""
    parts.append(f"t1 AS (SELECT *, round(score + {bonus}, 9) AS gain FROM ranked WHERE rank = 1)")
    parts.append(f"g2 AS (SELECT p.*, round(p.score + CASE WHEN p.family_id <> t1.family_id THEN {bonus} ELSE 0 END - {penalty} * ({overlap('t1')}), 9) AS gain FROM ranked p JOIN t1 USING (query_id) WHERE p.evidence_id <> t1.evidence_id), t2 AS {best('g2')}")
    parts.append(f"g3 AS (SELECT p.*, round(p.score + CASE WHEN p.family_id <> t1.family_id AND p.family_id <> t2.family_id THEN {bonus} ELSE 0 END - {penalty} * greatest({overlap('t1')}, {overlap('t2')}), 9) AS gain FROM ranked p JOIN t1 USING (query_id) JOIN t2 USING (query_id) WHERE p.evidence_id NOT IN (t1.evidence_id, t2.evidence_id) {cap}), t3 AS {best('g3')}")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT query_id, CAST({i} AS bigint) AS position, evidence_id, round(gain, 6) AS score FROM t{i}" for i in (1, 2, 3))


def _retrieval(name: str, method: hybrid.Method):
    def run(spark, sf_dir):
        vectors = table(spark, sf_dir, "embeddings")
        evidence = vectors.selectExpr(*(f"{e} AS {n}" for n, e in _EVIDENCE_FIELDS.items()))
        queries = vectors.where("vec_id % 20 = 0")
        dense = retrieval.dense(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), vectors.select(F.col("vec_id").alias("evidence_id"), F.col("embedding").alias("vector")), _HITS)
        # four places, so that no weighted score lies half way between two roundings
        hits = dense.select("query_id", "evidence_id", (F.floor(F.col("score") * 10000) / 10000).alias("dense"), "rank")
        asked = queries.selectExpr(*(f"{e} AS {n}" for n, e in _QUERY_FIELDS.items()))
        return hybrid.retrieved(asked, hits, evidence, method, 3, scored=1000, affinity_floor=_FLOOR, anchor_count=_ANCHORS, rounds=_ROUNDS)

    run.__name__ = f"retrieve_{name}"
    return query(_retrieved_sql(method))(run)


for _name, _method in hybrid.METHODS.items():
    _retrieval(_name, _method)
