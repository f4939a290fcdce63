"""Queries that compare methods: paired and clustered bootstraps of any statistic, gates, parameter grids and fronts; with their equivalents in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veinworks.functions.storage import checkpointed
from veinworks.operators import bundles, evaluation, retrieval, skyline
from veinworks.plans.bindings import RUNS, SCORED, ranked_runs, table
from veinworks.plans.catalogue import _HYBRID, _dense, _hybrid, _labels, query, scored

REFERENCE, PROPOSED, REPLICATES, MARGIN = "click", ["error", "view"], 100, 0.4

_RATED_RUNS = f"""{RUNS}, first AS (SELECT method, query_id, latency, (event_id * 37 + CASE method WHEN 'error' THEN 30 ELSE 0 END) % 101 / 101 AS utility
  FROM (SELECT *, row_number() OVER (PARTITION BY method, query_id ORDER BY ts, event_id) AS n FROM runs) WHERE n = 1)"""


def _rated_runs(spark, sf_dir):
    first = bundles.first_runs(ranked_runs(spark, sf_dir))
    utility = (F.col("event_id") * 37 + F.when(F.col("method") == "error", 30).otherwise(0)) % 101 / 101
    return first.select("method", "query_id", "latency", utility.alias("utility"))


def _draws(seed: int, replicates: int, table_: str = "c") -> str:
    """(replicate, slot): the drawn numbers of the rows of ``table_``."""
    return f"SELECT replicate, ('0x' || substr(md5(concat_ws(':', {seed}, replicate, slot)), 1, 15))::bigint % n AS slot FROM {table_}, (SELECT unnest(range({replicates})) AS replicate), (SELECT count(*) AS n FROM {table_})"


def _effect_sql(method: str, i: int) -> str:
    return f"""SELECT * FROM (WITH c AS (SELECT a.query_id, a.utility AS u1, r.utility AS u0, a.latency AS l1, r.latency AS l0, row_number() OVER (ORDER BY a.query_id) - 1 AS slot FROM (FROM first WHERE method = '{method}') a JOIN (FROM first WHERE method = '{REFERENCE}') r USING (query_id)),
u AS (SELECT round(avg(u1) - avg(u0), 6) AS v FROM ({_draws(7 + i, REPLICATES)}) d JOIN c USING (slot) GROUP BY replicate), l AS (SELECT round(quantile_cont(l1, 0.95) - quantile_cont(l0, 0.95), 6) AS v FROM ({_draws(1007 + i, REPLICATES)}) d JOIN c USING (slot) GROUP BY replicate),
p AS (SELECT count(*) AS paired, avg(u1) - avg(u0) AS utility_delta, quantile_cont(l1, 0.95) AS p95, quantile_cont(l0, 0.95) AS p95_reference FROM c),
ui AS (SELECT round(quantile_cont(v, 0.025), 6) AS utility_low, round(quantile_cont(v, 0.975), 6) AS utility_high FROM u), li AS (SELECT round(quantile_cont(v, 0.025), 6) AS latency_low, round(quantile_cont(v, 0.975), 6) AS latency_high FROM l)
SELECT '{method}' AS method, paired, round(utility_delta, 6) AS utility_delta, round(p95, 6) AS p95, round(p95_reference, 6) AS p95_reference, utility_low, utility_high, latency_low, latency_high, utility_delta > 0 AND p95 / p95_reference <= {1 + MARGIN} AS point_gate, utility_low > 0 AS quality_gate,
  latency_high <= p95_reference * {MARGIN}::double AS latency_gate, utility_low > 0 AND latency_high <= p95_reference * {MARGIN}::double AS joint_gate, round(p95_reference * {MARGIN}::double, 6) AS allowed FROM p, ui, li)"""


@query(f"WITH {_RATED_RUNS} " + " UNION ALL ".join(_effect_sql(m, i) for i, m in enumerate(PROPOSED)))
def joint_gate(spark, sf_dir):
    return evaluation.effectiveness(_rated_runs(spark, sf_dir), REFERENCE, PROPOSED, REPLICATES, MARGIN)


def _pairs(spark, sf_dir):
    runs = _rated_runs(spark, sf_dir)
    of = lambda m, name: runs.where(F.col("method") == m).select(F.col("query_id").alias("cluster"), F.col("latency").alias(name))
    return of("view", "left").join(of(REFERENCE, "right"), "cluster")


_PAIRED = f"{_RATED_RUNS}, c AS (SELECT query_id, a.latency AS l1, r.latency AS l0, row_number() OVER (ORDER BY query_id) - 1 AS slot FROM (FROM first WHERE method = 'view') a JOIN (FROM first WHERE method = '{REFERENCE}') r USING (query_id))"


@query(f"WITH {_PAIRED}, d AS ({_draws(7, REPLICATES)}) SELECT CAST(replicate AS integer) AS replicate, round(quantile_cont(l1, 0.95) - quantile_cont(l0, 0.95), 6) AS value FROM d JOIN c USING (slot) GROUP BY replicate")
def bootstrap_p95(spark, sf_dir):
    return evaluation.bootstrap_gap(_pairs(spark, sf_dir), REPLICATES, "p95")


@query(f"WITH {_PAIRED}, d AS ({_draws(7, REPLICATES)}) SELECT CAST(replicate AS integer) AS replicate, round(stddev_pop(l1) - stddev_pop(l0), 6) AS value FROM d JOIN c USING (slot) GROUP BY replicate")
def bootstrap_plugged(spark, sf_dir):
    """A statistic that is given as a function of an array."""
    return evaluation.bootstrap_gap(_pairs(spark, sf_dir), REPLICATES, lambda values: values.std())


_TASKS = f"""{SCORED}, task AS (SELECT fault_id, role, claim_id, count(DISTINCT family_id) FILTER (q >= 0.9 AND split = 'build_train') >= 2 AS answered FROM scored GROUP BY ALL),
c AS (SELECT fault_id AS cluster, count_if(answered) AS numerator, count(*) AS denominator, row_number() OVER (ORDER BY fault_id) - 1 AS slot FROM task GROUP BY fault_id)"""


@query(f"WITH {_TASKS}, d AS ({_draws(7, 200)}), v AS (SELECT round(sum(numerator) / sum(denominator), 6) AS value FROM d JOIN c USING (slot) GROUP BY replicate) SELECT round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, round(avg(value), 6) AS mean FROM v")
def bootstrap_faults(spark, sf_dir):
    """Answerability of tasks (fault, role, claim), faults drawn with replacement: a task is answered by two families."""
    good = (F.col("q") >= 0.9) & (F.col("split") == "build_train")
    tasks = scored(spark, sf_dir).groupBy("fault_id", "role", "claim_id").agg((F.countDistinct(F.when(good, F.col("family_id"))) >= 2).alias("answered"))
    faults = tasks.groupBy(F.col("fault_id").alias("cluster")).agg(F.count_if("answered").alias("numerator"), F.count("*").alias("denominator"))
    return evaluation.interval(evaluation.bootstrap(faults, 200))


@query(f"""WITH {SCORED}, c AS (SELECT doc_id, count_if(role < 2 AND q >= 0.8) AS a, count_if(role < 2) AS an, count_if(role >= 2 AND q >= 0.8) AS b, count_if(role >= 2) AS bn, row_number() OVER (ORDER BY doc_id) - 1 AS slot FROM scored GROUP BY doc_id), d AS ({_draws(7, 50)}),
v AS (SELECT round(coalesce(sum(a) / nullif(sum(an), 0), 0) - coalesce(sum(b) / nullif(sum(bn), 0), 0), 6) AS value FROM d JOIN c USING (slot) GROUP BY replicate)
SELECT round(avg(value), 6) AS mean, round(avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END), 6) AS favourable, quantile_cont(value, 0.025) > 0 OR quantile_cont(value, 0.975) < 0 AS excludes_zero FROM v""")
def bootstrap_pages(spark, sf_dir):
    """The gap of two acceptance rates, pages drawn with replacement."""
    ok, left = F.col("q") >= 0.8, F.col("role") < 2
    pages = scored(spark, sf_dir).groupBy(F.col("doc_id").alias("cluster")).agg(F.count_if(left & ok).alias("left"), F.count_if(left).alias("left_of"), F.count_if(~left & ok).alias("right"), F.count_if(~left).alias("right_of"))
    return bundles.favourable(evaluation.bootstrap_ratio_gap(pages, 50))


# --- retrieval reports -----------------------------------------------------------------------------

#: Two methods with two runs a query: the first is reported, the second, half as long a list, only counts for latency.
_RUNS = f"""{_HYBRID}, dense AS (SELECT query_id, evidence_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, evidence_id) AS rank FROM d),
listed AS (SELECT 'dense' AS method, query_id, run, rank, evidence_id FROM dense, range(2) r(run) WHERE rank <= 10 - 5 * run UNION ALL SELECT 'hybrid', query_id, run, rank, evidence_id FROM ranked, range(2) r(run) WHERE rank <= 10 - 5 * run AND query_id % 100 <> 40),
runs AS (SELECT method, vec_id AS query_id, run, CAST((vec_id * 37 + run * 11 + length(method)) % 101 AS double) AS latency, (vec_id + run) % 9 = 0 AS timed_out, vec_id % 50 AS scored FROM embeddings, (VALUES ('dense'), ('hybrid')) m(method), range(2) r(run) WHERE vec_id % 20 = 0),
rel AS (SELECT q.vec_id AS query_id, e.vec_id AS evidence_id FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0 AND q.vec_id % 60 <> 0),
cand AS (SELECT vec_id AS evidence_id, vec_id % 11 AS claim_id, vec_id % 7 AS family_id, list_distinct(['h' || vec_id % 5, 't' || vec_id % 3]) AS ends FROM embeddings WHERE vec_id % 13 <> 0),
j AS (SELECT r.*, rel.evidence_id IS NOT NULL AS hit, claim_id, family_id, ends FROM listed r LEFT JOIN rel USING (query_id, evidence_id) LEFT JOIN cand USING (evidence_id) WHERE run = 0),
w AS (SELECT query_id, count(*) AS wanted FROM rel GROUP BY query_id),
g AS (SELECT method, query_id, count(evidence_id) AS returned, coalesce(count_if(hit), 0) AS hits, min(CASE WHEN hit THEN rank END) AS first, coalesce(sum(CASE WHEN hit THEN 1 / log2(rank + 1) END), 0) AS dcg, count(DISTINCT family_id) AS families, count(DISTINCT claim_id) AS claims, count(claim_id) AS known FROM (SELECT DISTINCT method, query_id FROM runs) LEFT JOIN j USING (method, query_id) GROUP BY ALL),
o AS (SELECT a.method, a.query_id, avg(len(list_intersect(a.ends, b.ends)) / len(list_distinct(list_concat(a.ends, b.ends)))) AS overlap FROM j a JOIN j b ON a.method = b.method AND a.query_id = b.query_id AND a.rank < b.rank WHERE a.claim_id IS NOT NULL AND b.claim_id IS NOT NULL GROUP BY ALL),
records AS (SELECT method, query_id, returned, round(hits / wanted, 6) AS recall, round(coalesce(1 / first, 0), 6) AS mrr, round(CASE WHEN returned > 0 THEN dcg / list_sum(list_transform(range(1, least(wanted, returned) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg, families, round(CASE WHEN known > 0 THEN 1 - claims / known ELSE 0 END, 6) AS redundancy, round(coalesce(overlap, 0), 6) AS overlap FROM g JOIN w USING (query_id) LEFT JOIN o USING (method, query_id))"""


def _reported(spark, sf_dir):
    """Runs, and the records of their first ones."""
    vectors, run = table(spark, sf_dir, "embeddings"), F.explode(F.array(F.lit(0), F.lit(1))).alias("run")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.explode(F.array(F.lit("dense"), F.lit("hybrid"))).alias("method")).select("*", run)
    runs = asked.selectExpr("method", "query_id", "run", "CAST((query_id * 37 + run * 11 + length(method)) % 101 AS double) AS latency", "(query_id + run) % 9 = 0 AS timed_out", "query_id % 50 AS scored")
    lists = _dense(spark, sf_dir, 10).select(F.lit("dense").alias("method"), "query_id", "rank", "evidence_id").unionByName(_hybrid(spark, sf_dir, 10).where("query_id % 100 <> 40").select(F.lit("hybrid").alias("method"), "query_id", "rank", "evidence_id"))
    ranked = checkpointed(lists).select("*", run).where("rank <= 10 - 5 * run")
    labels = _labels(spark, sf_dir)
    judged = labels.where("evidence_id % 20 = 0 AND evidence_id % 60 <> 0").select(F.col("evidence_id").alias("query_id"), "label")
    relevant = evaluation.relevant_by_key(judged, labels, ranked, "label")
    candidates = vectors.where("vec_id % 13 <> 0").selectExpr("vec_id AS evidence_id", "vec_id % 11 AS claim_id", "vec_id % 7 AS family_id", "array(concat('h', vec_id % 5), concat('t', vec_id % 3)) AS ends")
    return runs, evaluation.query_records(runs, ranked, relevant, candidates)


@query(f"WITH {_RUNS} SELECT * FROM records")
def query_records(spark, sf_dir):
    return _reported(spark, sf_dir)[1]


@query(f"""WITH {_RUNS}, c AS (SELECT method, count(*) AS samples, CAST(count_if(timed_out) AS bigint) AS timeouts, round(avg(scored), 6) AS scored, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95 FROM runs GROUP BY method)
SELECT c.*, queries, recall, mrr, ndcg, families, redundancy, overlap FROM c JOIN (SELECT method, count(*) AS queries, {', '.join(f'round(avg({x}), 6) AS {x}' for x in ('recall', 'mrr', 'ndcg', 'families', 'redundancy', 'overlap'))} FROM records GROUP BY method) USING (method)""")
def retrieval_report(spark, sf_dir):
    """Means over answerable queries of first runs, latencies over all runs."""
    runs, records = _reported(spark, sf_dir)
    return evaluation.retrieval_report(runs, records, ("scored",))


# --- grids and fronts -------------------------------------------------------------------

GRID = [(i, b, p, cap) for i, (b, p, cap) in enumerate((b, p, cap) for b in (0.0, 0.05, 0.2) for p in (0.0, 0.2, 0.5) for cap in (1, 2))]
SLACK = 0.02

_CHOSEN = f"""{_HYBRID}, grid AS (SELECT * FROM (VALUES {', '.join(f'({i}, {b}::double, {p}::double, {cap})' for i, b, p, cap in GRID)}) g(config_id, bonus, penalty, cap)),
p AS (SELECT * FROM ranked, grid WHERE rank <= 20), s1 AS (SELECT config_id, query_id, evidence_id AS e1, family_id AS f1, claim_id AS c1 FROM p WHERE rank = 1),
g2 AS (SELECT p.*, e1, f1, c1, round(hs + CASE WHEN family_id <> f1 THEN bonus ELSE 0 END - CASE WHEN claim_id = c1 THEN penalty ELSE 0 END, 9) AS g FROM p JOIN s1 USING (config_id, query_id) WHERE evidence_id <> e1 AND (cap > 1 OR family_id <> f1)),
s2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config_id, query_id ORDER BY g DESC, rank) AS r FROM g2) WHERE r = 1),
g3 AS (SELECT p.*, round(p.hs + CASE WHEN p.family_id NOT IN (f1, s2.family_id) THEN p.bonus ELSE 0 END - CASE WHEN p.claim_id IN (c1, s2.claim_id) THEN p.penalty ELSE 0 END, 9) AS g
  FROM p JOIN s2 USING (config_id, query_id) WHERE p.evidence_id NOT IN (e1, s2.evidence_id) AND (CASE WHEN p.family_id = f1 THEN 1 ELSE 0 END + CASE WHEN p.family_id = s2.family_id THEN 1 ELSE 0 END) < p.cap),
s3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config_id, query_id ORDER BY g DESC, rank) AS r FROM g3) WHERE r = 1),
chosen AS (SELECT config_id, query_id, e1 AS evidence_id FROM s1 UNION ALL SELECT config_id, query_id, evidence_id FROM s2 UNION ALL SELECT config_id, query_id, evidence_id FROM s3),
per AS (SELECT config_id, query_id, count_if(label = asked) / 3 AS hit, count(DISTINCT family_id) AS families, count(*) - count(DISTINCT claim_id) AS repeated, max(rank) AS deepest FROM chosen JOIN ranked USING (query_id, evidence_id) JOIN (SELECT vec_id AS query_id, label AS asked FROM embeddings) USING (query_id) GROUP BY ALL),
m AS (SELECT config_id, round(avg(hit), 6) AS recall, round(avg(families), 6) AS families, round(avg(repeated), 6) AS redundancy, round(avg(deepest), 6) AS depth FROM per GROUP BY config_id)"""


def _measured(spark, sf_dir):
    ranked = checkpointed(_hybrid(spark, sf_dir, 20))
    chosen = retrieval.select_by_grid(ranked.select("query_id", "rank", "evidence_id", "family_id", "claim_id", "score"), GRID, 3)
    asked = _labels(spark, sf_dir).select(F.col("evidence_id").alias("query_id"), F.col("label").alias("_asked"))
    rows = chosen.select("config_id", "query_id", "evidence_id").join(ranked.select("query_id", "evidence_id", "family_id", "claim_id", "label", "rank"), ["query_id", "evidence_id"]).join(asked, "query_id")
    per = rows.groupBy("config_id", "query_id").agg((F.count_if(F.col("label") == F.col("_asked")) / 3).alias("hit"), F.countDistinct("family_id").alias("families"), (F.count("*") - F.countDistinct("claim_id")).alias("repeated"), F.max("rank").alias("deepest"))
    mean = lambda c: F.round(F.avg(c), 6)
    return per.groupBy("config_id").agg(mean("hit").alias("recall"), mean("families").alias("families"), mean("repeated").alias("redundancy"), mean("deepest").alias("depth"))


@query(f"""WITH {_CHOSEN} SELECT config_id, recall, families, redundancy, depth, recall >= (SELECT max(recall) FROM m) - {SLACK} AS allowed, row_number() OVER (ORDER BY recall >= (SELECT max(recall) FROM m) - {SLACK} DESC, families DESC, redundancy, depth, config_id) = 1 AS chosen FROM m a
WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.recall >= a.recall AND o.families >= a.families AND o.redundancy <= a.redundancy AND o.depth <= a.depth AND (o.recall > a.recall OR o.families > a.families OR o.redundancy < a.redundancy OR o.depth < a.depth))""")
def parameter_front(spark, sf_dir):
    """Settings of the selector that no other dominates in four measures, and the one chosen among those of nearly the best recall."""
    return evaluation.chosen_setting(_measured(spark, sf_dir), "config_id", "recall", SLACK, low=("redundancy", "depth"), high=("recall", "families"), order=("-families", "redundancy", "depth", "config_id"))


@query("""WITH p AS (SELECT l_orderkey * 8 + l_linenumber AS id, CAST(l_extendedprice AS double) AS price, CAST(l_quantity AS double) AS quantity, CAST(l_discount AS double) AS discount, CAST(l_tax AS double) AS tax FROM lineitem)
SELECT id, price, quantity, discount, tax FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.price <= p.price AND o.quantity >= p.quantity AND o.discount >= p.discount AND o.tax <= p.tax AND (o.price < p.price OR o.quantity > p.quantity OR o.discount > p.discount OR o.tax < p.tax))""")
def item_skyline(spark, sf_dir):
    d = lambda c: F.col(f"l_{c}").cast("double")
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), d("extendedprice").alias("price"), d("quantity").alias("quantity"), d("discount").alias("discount"), d("tax").alias("tax"))
    return skyline.skyline(rows, ("price", "tax"), ("quantity", "discount"))
