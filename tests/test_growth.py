"""Steps whose time or memory grew faster than their input: same results, and bounded shares."""

import random

import numpy as np

from pyspark.sql import functions as F

from veinworks.functions.storage import checkpointed
from veinworks.operators import evaluation, lexical, mapping, matrix, page_pool, retrieval
from veinworks.sources import files


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_relevant_rows_are_counted_by_key_as_by_pairs(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, rng.choice([0, 1, 2, None])) for i in range(60)] + [(100, 7)], "evidence_id long, label int")
    asked = rows.where("evidence_id % 3 = 0 or evidence_id = 100").select(F.col("evidence_id").alias("query_id"), "label").union(spark.createDataFrame([(900, 1), (901, 8)], "query_id long, label int"))
    lists = [(m, q, 0, rank, e) for m in ("a", "b") for q in [*range(0, 60, 3), 100, 900, 901] for rank, e in enumerate(rng.sample(range(60), 6), 1)]
    ranked = spark.createDataFrame(lists, "method string, query_id long, run int, rank int, evidence_id long")
    runs = ranked.select("method", "query_id", "run").distinct()
    candidates = rows.where("evidence_id % 7 <> 0").selectExpr("evidence_id", "evidence_id % 5 AS claim_id", "evidence_id % 4 AS family_id", "array('h', concat('t', evidence_id % 3)) AS ends")
    pairs = asked.join(rows, "label").where("query_id <> evidence_id").select("query_id", "evidence_id")
    counted = evaluation.relevant_by_key(asked, rows, ranked, "label")
    assert rows_of(evaluation.query_records(runs, ranked, counted, candidates)) == rows_of(evaluation.query_records(runs, ranked, pairs, candidates))
    one = ranked.where("method = 'a'")
    assert rows_of(evaluation.ranking_metrics(one, counted, 5)) == rows_of(evaluation.ranking_metrics(one, pairs, 5))


def test_a_grid_takes_what_each_setting_takes_and_groups_by_query(spark):
    rng = random.Random(2)
    pool = spark.createDataFrame([(q, rank, 10 * q + rank, rng.randrange(3), rng.randrange(4), round(1 - rank / 20, 3)) for q in range(5) for rank in range(1, 9)], "query_id long, rank int, evidence_id long, family_id long, claim_id long, score double")
    grid = [(0, 0.0, 0.2, 1), (1, 0.1, 0.0, 2)]
    got = retrieval.select_by_grid(pool, grid, 3)
    assert "[query_id" in got._jdf.queryExecution().optimizedPlan().toString() and "explode" not in got._jdf.queryExecution().optimizedPlan().toString()
    for c, b, p, cap in grid:
        assert rows_of(got.where(F.col("config_id") == c).drop("config_id")) == rows_of(retrieval.select(pool, 3, cap, b, p))


def test_draws_are_made_in_bounded_tasks_and_each_meets_its_cluster(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "DRAWS", 100)
    clusters = spark.createDataFrame([(i, i * i) for i in range(40)], "cluster long, v long")
    drawn = evaluation.drawn(clusters, 20)
    assert "Range (0, 40, step=1, splits=Some(8))" in drawn._jdf.queryExecution().optimizedPlan().toString()
    made = spark.range(40).crossJoin(spark.range(20).withColumnRenamed("id", "replicate")).select("replicate", evaluation.draw(7, F.col("replicate"), F.col("id"), F.lit(40)).alias("cluster"))
    want = rows_of(made.groupBy("replicate", "cluster").agg(F.count("*")))
    assert rows_of(drawn.groupBy("replicate", "cluster").agg(F.sum("times"))) == want


def test_clusters_are_sent_to_their_draws_or_both_are_shuffled_never_the_draws_sent(spark, monkeypatch):
    clusters = spark.createDataFrame([(i, i * i) for i in range(40)], "cluster long, v long")
    told = lambda: evaluation.drawn(clusters, 20)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    sent = told()
    assert "BuildRight" in plan(sent) and "BuildLeft" not in plan(sent)
    monkeypatch.setattr(evaluation, "SENT", 39)
    shuffled = told()
    assert "SortMergeJoin" in plan(shuffled) and "BroadcastHashJoin" not in plan(shuffled)
    assert rows_of(sent) == rows_of(shuffled) and sent.count() == 800
    pairs = clusters.withColumns({"left": F.col("v").cast("double"), "right": F.col("cluster").cast("double")}).drop("v")
    few = rows_of(evaluation.bootstrap_gap(pairs, 20, "p95"))
    monkeypatch.setattr(evaluation, "SENT", 40)
    assert rows_of(evaluation.bootstrap_gap(pairs, 20, "p95")) == few


def test_gates_send_no_draws_of_any_method_and_statistic(spark):
    runs = spark.createDataFrame([(m, q, (q * 7 + k) % 11 / 11, float(q * 13 % 29 + k)) for k, m in enumerate("abc") for q in range(40)], "method string, query_id long, utility double, latency double")
    told = evaluation.effectiveness(runs, "a", ["b", "c"], 20)
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 4 and "BuildLeft" not in plan
    assert [(r["method"], r["paired"]) for r in told.orderBy("method").collect()] == [("b", 40), ("c", 40)]


def test_hits_and_vetoes_of_small_files_are_not_sent_to_all_tasks(spark):
    rows = checkpointed(spark.range(200).selectExpr("id AS candidate_id", "'seal' AS head", "'leak' AS tail", "CASE WHEN id % 4 = 0 THEN 'no wear' ELSE 'wear' END AS evidence"))
    aliases = spark.createDataFrame([(f"F{j % 2}", f"r{j}", "wear" if j < 4 else "leak") for j in range(8)], "fault_id string, rule_id string, alias string")
    hits = mapping.fault_hits(rows, aliases, [mapping.Pattern("F1", "p", "lea.")], [("F1", "no wear")])
    plan = hits._jdf.queryExecution().executedPlan().toString()
    joins = [x.strip(" :+-") for x in plan.split("\n") if "Join" in x]
    assert sorted(x.split()[0] + (" LeftAnti" if "LeftAnti" in x else " BuildRight" if "BuildRight" in x else "") for x in joins) == ["BroadcastHashJoin BuildRight", "SortMergeJoin LeftAnti", "SortMergeJoin LeftAnti"]
    want = [(i, f"F{j % 2}", f"r{j}") for i in range(200) for j in range(8) if i % 4 or j % 2 == 0] + [(i, "F1", "p") for i in range(200) if i % 4]
    assert rows_of(hits.select("candidate_id", "fault_id", "rule_id")) == sorted(want, key=str)


def test_classes_of_small_files_are_not_sent_to_all_tasks(spark):
    empty = [f"CAST(NULL AS string) AS {s}_{c}" for s in ("head", "tail") for c in ("proposed", "proposed_status")]
    rows = checkpointed(spark.range(200).selectExpr("id AS candidate_id", "'seal' AS head", "'leak' AS tail", "'wear' AS evidence", "'cause' AS head_type", "'fault' AS tail_type", "'causes' AS relation", *empty))
    aliases = spark.createDataFrame([("F1", "r1", "wear")], "fault_id string, rule_id string, alias string")
    terms = spark.createDataFrame([("cause", "seal", "T1", "环", "human_approved")], "type string, surface string, term_id string, label string, status string")
    told = mapping.described(rows, mapping.fault_hits(rows, aliases, [], [], by_rule=False), terms, ("human_approved",), {"causes": "导致"})
    assert "BroadcastHashJoin [candidate_id" not in told._jdf.queryExecution().executedPlan().toString()
    assert {(tuple(r["fault_ids"]), r["head_label"]) for r in told.collect()} == {(("F1",), "环")}


def test_candidates_of_small_files_are_not_sent_to_all_tasks(spark):
    from veinworks.plans import catalogue_candidates

    for told in (catalogue_candidates.validated_candidates, catalogue_candidates.table_alignment):
        plan = told(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [candidate_id" in plan and "BroadcastHashJoin [candidate_id" not in plan


def test_scripts_count_letters_without_a_list_of_them(spark):
    texts = [None, "", "甲" * 19, "甲" * 20, "abc" * 7, "甲㐁豈" * 7 + "a" * 9, "甲a" * 20, "12 é甲" * 30, "𠀀" * 30 + "ab" * 10]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    df = rows.select("text", F.inline(F.array(lexical.script_parts(F.col("text")))))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("regexp_replace") == 2
    for r in df.collect():
        han, latin = (sum(a <= c <= b for c in r["text"] or "" for a, b in ranges) for ranges in ([("㐀", "䶿"), ("一", "鿿"), ("豈", "﫿")], [("a", "z"), ("A", "Z")]))
        share = han / max(1, han + latin)
        assert r["script"] == ("und" if han + latin < 20 else "zh" if share >= 0.7 else "en" if share <= 0.15 else "multilingual")


def test_a_prefix_is_shuffled_once_into_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(files, "PART_ROWS", 50)
    rows = [(d, i, 1 if d == 3 and i == 4 else i, not (d == 5 and i == 3), "v1" if d == 8 and i == 2 else "v2", "x") for d in range(100) for i in range(1, 6)]
    kept = files.valid_prefix(spark.createDataFrame(rows, "doc long, position int, page int, readable boolean, version string, digest string"), "doc", "position", "v2", "x")
    assert rows_of(kept.select("doc", "position")) == sorted(((d, i) for d, i, *_ in rows if d not in (3, 8) and not (d == 5 and i >= 3)), key=str)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan.replace("BroadcastExchange", "")


def test_exclusions_need_no_fingerprints(spark, monkeypatch):
    def never(*_):
        raise AssertionError("the pool's decisions are not asked for")

    from veinworks.plans import catalogue

    for f in ("decided", "accepted"):
        monkeypatch.setattr(page_pool, f, never)
    monkeypatch.setattr(page_pool.lexical, "simhash", never)
    assert catalogue.QUERIES["page_pool_exclusions"](spark, "/root/testdata/sf0.001").count() >= 0


def test_scores_are_made_for_some_queries_and_rows_at_a_time(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(matrix, "PIECE", 3)
    monkeypatch.setattr(matrix, "CELLS", 40)
    values = {i: rng.randrange(9) / 10 + rng.choice([0, 4e-7]) for i in range(97)}
    rows = spark.createDataFrame(list(values.items()), "evidence_id long, v double").repartition(2)

    def score(batch):
        assert batch.num_rows <= 4
        v = batch.column("v").to_numpy()[:, None]

        def of(some):
            times = np.arange(8)[some]
            assert len(times) <= 3
            return v * (times % 2 + 1)

        return of

    got = matrix.best_rows(rows, score, [f"q{i}" for i in range(8)], "string", 5, width=10)
    want = [(f"q{q}", rank, i) for q in range(8) for rank, (_, i) in enumerate(sorted((-round(v * (q % 2 + 1), 6), i) for i, v in values.items())[:5], 1)]
    assert rows_of(got.select("query_id", "rank", "evidence_id")) == sorted(want, key=str)
