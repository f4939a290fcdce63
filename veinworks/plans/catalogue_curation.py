"""Queries that choose and judge records, with their equivalents in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veinworks.operators import curation
from veinworks.plans.bindings import ASSERTIONS, EDGES, assertions, edges, table
from veinworks.plans.catalogue import query

_PAGE = """CASE doc_id % 7 WHEN 0 THEN 'Title' || chr(10) || ' Contents ' || chr(10) || text WHEN 1 THEN text || chr(10) || repeat('Chapter .... 12' || chr(10), 6) WHEN 2 THEN substr(text, 1, 40)
  WHEN 3 THEN substr(text, 1, 100) || ' Copyright, all rights reserved' WHEN 4 THEN text || ' copyright www.example.org, pumps' ELSE text END"""


@query(f"""WITH p AS (SELECT doc_id, {_PAGE} AS page FROM documents), l AS (SELECT *, list_filter(regexp_split_to_array(page, '\\r\\n|\\r|\\n'), lambda x: regexp_matches(x, '\\S')) AS lines, lower(trim(page)) AS low FROM p)
SELECT doc_id, coalesce(regexp_matches(lower(page), '(?m)table of contents|^\\s*contents\\s*$') OR (len(lines) >= 5 AND len(list_filter(lines, lambda x: regexp_matches(x, '\\.{{4,}}\\s*\\d+\\s*$'))) >= 0.25 * len(lines)), false) AS contents,
  coalesce(length(low) < 80 OR (contains(low, 'all rights reserved')::int + contains(low, 'contact us')::int + contains(low, 'www.')::int + contains(low, 'copyright')::int >= 2 AND NOT regexp_matches(low, '\\b({curation.TECHNICAL})\\w*\\b')), true) AS low_value FROM l""")
def page_value(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_PAGE} AS page")
    return pages.select("doc_id", curation.is_contents(F.col("page")).alias("contents"), curation.is_low_value(F.col("page")).alias("low_value"))


_LABEL = "CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || lower(p_brand) ELSE p_name || ' ' || p_size END"


@query(f"""SELECT p_partkey, array_to_string(list_sort(list_filter(list_distinct(list_concat(regexp_extract_all(lower(s), 'brand#\\d+'), regexp_extract_all(lower(s), '\\b\\d+\\b'))), lambda t: NOT contains(lower(label), t))), ',') AS lost
FROM (SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_size || ' ' || upper(p_brand) AS s, {_LABEL} AS label FROM part)""")
def protected_words(spark, sf_dir):
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name || ' ' || p_brand || ' ' || p_size || ' ' || upper(p_brand) AS s", f"{_LABEL} AS label")
    return parts.select("p_partkey", F.array_join(F.array_sort(curation.unprotected(F.col("s"), F.col("label"), [r"brand#\d+", r"\b\d+\b"])), ",").alias("lost"))


_NAMES = "CASE p_size % 6 WHEN 0 THEN 'Possible  CAUSE' WHEN 1 THEN 'Fault type' WHEN 2 THEN 'Remedy' WHEN 3 THEN 'Failure' WHEN 4 THEN 'Inspection' ELSE 'Notes' END"
_ROLE_SQL = "CASE WHEN contains(n, 'cause') OR contains(n, 'reason') THEN 'cause' WHEN contains(n, 'fault') OR contains(n, 'failure') OR contains(n, 'problem') THEN 'fault' WHEN contains(n, 'remedy') OR contains(n, 'action') OR contains(n, 'repair') THEN 'action' WHEN contains(n, 'inspect') OR contains(n, 'check') THEN 'method' ELSE 'unclassified' END"


@query(f"""WITH c AS (SELECT CAST(floor(p_partkey / 3) AS bigint) AS row_id, lower({_NAMES}) AS n FROM part), r AS (SELECT row_id, {_ROLE_SQL} AS role FROM c)
SELECT row_id, CASE WHEN bool_or(role = 'cause') AND bool_or(role = 'fault') THEN 'causes' WHEN bool_or(role = 'fault') AND bool_or(role = 'action') THEN 'mitigated_by' END AS relation FROM r GROUP BY row_id""")
def table_relations(spark, sf_dir):
    cells = table(spark, sf_dir, "part").selectExpr("CAST(floor(p_partkey / 3) AS bigint) AS row_id", f"{_NAMES} AS name")
    return curation.row_relations(cells.select("row_id", curation.column_role(F.col("name")).alias("role")))


_RESPONSE = """CASE p_size % 5 WHEN 0 THEN 'Sure: ```json' || chr(10) || '{"tokens": ' || p_size || ', "inner": {"n": 1}}' || chr(10) || '```' WHEN 1 THEN '{"tokens": "many", "token_count": "' || p_size || '.5"}' WHEN 2 THEN 'nothing here' WHEN 3 THEN '{"total": ' || p_size || '} done' ELSE '{"tokens": true, "total": 7}' END"""


@query(f"""WITH r AS (SELECT p_partkey, nullif(regexp_extract({_RESPONSE}, '(?s)\\{{.*\\}}'), '') AS j FROM part)
SELECT p_partkey, j AS json, coalesce(TRY_CAST(j->>'$.tokens' AS double), TRY_CAST(j->>'$.token_count' AS double), TRY_CAST(j->>'$.total' AS double)) AS tokens FROM r""".replace("TRY_CAST(j->>'$.tokens' AS double)", "CASE WHEN j->>'$.tokens' <> 'true' THEN TRY_CAST(j->>'$.tokens' AS double) END"))
def tolerant_json(spark, sf_dir):
    responses = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_RESPONSE} AS response")
    found = responses.select("p_partkey", curation.json_of(F.col("response")).alias("json"))
    return found.withColumn("tokens", curation.first_number(F.col("json"), "tokens", "token_count", "total"))


_ITEMS = """SELECT event_id AS item_id, event_type || '-' || user_id AS answer_id, event_type AS method, CASE WHEN event_id % 4 = 0 THEN 'summary' ELSE 'answer_point' END AS kind,
  CASE WHEN event_id % 31 = 0 THEN 'unsupported' WHEN event_id % 37 = 0 THEN NULL ELSE 'supported' END AS verdict_a, CASE WHEN event_id % 29 = 0 THEN 'partial' ELSE 'supported' END AS verdict_b, user_id % 6 <> 0 AS answered, user_id FROM events"""
_OF = "CASE WHEN i = 1 AND item_id % 23 = 0 THEN 1 ELSE 0 END"
_QUOTE = "CASE WHEN i = 1 AND item_id % 41 = 0 THEN 'site' WHEN i = 2 AND item_id % 43 = 0 THEN 'a t' WHEN i = 2 AND item_id % 47 = 0 THEN 'not there' ELSE 'seen |  by' || user_id END"


@query(f"""WITH items AS ({_ITEMS}), ev AS (SELECT item_id, 0 AS evidence_id, 'It was  seen by ' || user_id || ' at night' AS text FROM items),
sp AS (SELECT *, {_OF} AS evidence_id, {_QUOTE} AS quote FROM (SELECT item_id, user_id, unnest([1, 2, 3]) AS i FROM items) WHERE NOT (item_id % 53 = 0 AND i = 3)),
v AS (SELECT item_id, CASE WHEN i = 3 THEN 'b' ELSE 'a' END AS judge, bool_and(coalesce(length(regexp_replace(quote, '[\\s|]+', '', 'g')) >= 4 AND contains(regexp_replace(text, '[\\s|]+', '', 'g'), regexp_replace(quote, '[\\s|]+', '', 'g')), false)) AS ok FROM sp LEFT JOIN ev USING (item_id, evidence_id) GROUP BY ALL),
q AS (SELECT item_id, bool_or(judge = 'a' AND ok) AND bool_or(judge = 'b' AND ok) AS quoted FROM v GROUP BY item_id),
t AS (SELECT items.*, quoted, coalesce(verdict_a = 'supported' AND verdict_b = 'supported', false) AND quoted AS strict, verdict_a IS NOT DISTINCT FROM verdict_b AS agree FROM items JOIN q USING (item_id)),
a AS (SELECT method, answer_id, bool_or(answered) AS answered, bool_and(strict) AS alls, coalesce(bool_and(strict) FILTER (kind = 'answer_point'), false) AS allp FROM t GROUP BY ALL)
SELECT method, answers, point_support, summary_support, agreement, quoted, answers_supported, answers_with_supported_points FROM
(SELECT method, round(avg(strict::int) FILTER (kind = 'answer_point'), 6) AS point_support, round(avg(strict::int) FILTER (kind = 'summary'), 6) AS summary_support, round(avg(agree::int), 6) AS agreement, round(avg(quoted::int), 6) AS quoted FROM t GROUP BY method)
JOIN (SELECT method, count(*) AS answers, round(count_if(answered AND alls) / count_if(answered), 6) AS answers_supported, round(count_if(answered AND allp) / count_if(answered), 6) AS answers_with_supported_points FROM a GROUP BY method) USING (method)""")
def judge_summary(spark, sf_dir):
    items = _items(spark, sf_dir)
    evidence = items.selectExpr("item_id", "0 AS evidence_id", "'It was  seen by ' || user_id || ' at night' AS text")
    spans = items.select("item_id", "user_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("i")).where("NOT (item_id % 53 = 0 AND i = 3)")
    spans = spans.select("item_id", F.when(F.col("i") == 3, "b").otherwise("a").alias("judge"), F.expr(_OF).alias("evidence_id"), F.expr(_QUOTE).alias("quote"))
    return curation.judged(items.drop("user_id"), curation.spans_verified(spans, evidence))


def _items(spark, sf_dir):
    return spark.sql(_ITEMS.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


_RECORDS = f"{ASSERTIONS}, records AS (SELECT doc_id AS page, fault_id || '-' || level AS stratum FROM assertions WHERE split = 'build_train' AND level IN ('E1', 'E2'))"


@query(f"""WITH RECURSIVE {_RECORDS}, totals AS (SELECT page, count(*) AS n FROM records GROUP BY page), strata AS (SELECT stratum, row_number() OVER (ORDER BY stratum) AS i FROM (SELECT DISTINCT stratum FROM records)),
pairs AS (SELECT DISTINCT i, page, n FROM records JOIN totals USING (page) JOIN strata USING (stratum)), best AS (SELECT i, list(page ORDER BY n DESC, page) AS pages FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY n DESC, page) AS k FROM pairs) WHERE k <= 40 GROUP BY i),
walk AS (SELECT 0::bigint AS i, []::bigint[] AS taken UNION ALL SELECT w.i + 1, list_concat(taken, list_filter(pages, lambda p: NOT list_contains(taken, p))[1:1]) FROM walk w JOIN best b ON b.i = w.i + 1),
chosen AS (SELECT unnest(taken) AS page, generate_subscripts(taken, 1) AS position FROM walk WHERE i = (SELECT max(i) FROM strata)),
filled AS (SELECT page, row_number() OVER (ORDER BY n DESC, page) + (SELECT count(*) FROM chosen) AS position FROM totals WHERE page NOT IN (SELECT page FROM chosen))
SELECT CAST(position AS bigint) AS position, page FROM (SELECT page, position FROM chosen UNION ALL SELECT page, position FROM filled) WHERE position <= 30""")
def quota_pool(spark, sf_dir):
    kept = assertions(spark, sf_dir).where("split = 'build_train' AND level IN ('E1', 'E2')")
    return curation.quota_pool(kept.select(F.col("doc_id").alias("page"), F.concat("fault_id", F.lit("-"), "level").alias("stratum")), 30)


@query(f"""WITH {ASSERTIONS}, gaps AS (SELECT f AS fault_id, r AS role, f + 2 * r AS gap FROM range(10) a(f), range(4) b(r)),
m AS (SELECT fault_id, role, evidence_id AS record_id, claim_id % 3 AS blocked, 1 + claim_id % 2 AS units, gap FROM assertions JOIN gaps USING (fault_id, role) WHERE claim_id % 3 > 0 AND gap > 0 AND (role < 3 OR doc_id < 200)),
w AS (SELECT *, row_number() OVER o AS position, coalesce(sum(units) OVER (PARTITION BY fault_id, role ORDER BY blocked, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m WINDOW o AS (PARTITION BY fault_id, role ORDER BY blocked, record_id))
SELECT fault_id, role, position, record_id, sum(units) OVER (PARTITION BY fault_id, role) >= gap AS closed FROM w WHERE before < gap""")
def minimum_blockers(spark, sf_dir):
    rows = assertions(spark, sf_dir).where("role < 3 OR doc_id < 200")
    records = rows.select("fault_id", "role", F.col("evidence_id").alias("record_id"), (F.col("claim_id") % 3).alias("blocked"), (1 + F.col("claim_id") % 2).alias("units"))
    gaps = spark.range(10).withColumnRenamed("id", "fault_id").withColumn("role", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("gap", F.col("fault_id") + 2 * F.col("role"))
    return curation.blockers(records, gaps)


_VERTICES = "SELECT 'S-' || s_suppkey AS node FROM supplier WHERE s_suppkey % 9 <> 4 UNION ALL SELECT 'P-' || p_partkey FROM part WHERE p_partkey % 50 <> 7 UNION ALL SELECT 'X-' || r_regionkey FROM region"


@query(f"WITH {EDGES}, v AS ({_VERTICES}), e AS (SELECT DISTINCT 'a' AS side, a AS node FROM pairs UNION SELECT DISTINCT 'b', b FROM pairs) SELECT side, node FROM e WHERE node NOT IN (SELECT node FROM v) UNION ALL SELECT 'alone', node FROM v WHERE node NOT IN (SELECT node FROM e)")
def graph_consistency(spark, sf_dir):
    of = lambda name, key, prefix, test: table(spark, sf_dir, name).where(test).select(F.concat(F.lit(prefix), key).alias("node"))
    vertices = of("supplier", "s_suppkey", "S-", "s_suppkey % 9 <> 4").union(of("part", "p_partkey", "P-", "p_partkey % 50 <> 7")).union(of("region", "r_regionkey", "X-", "true"))
    return curation.dangling(edges(spark, sf_dir).where("a LIKE 'S-%'"), vertices)
