"""Operators on small tables with known answers."""

import pytest
from pyspark.sql import functions as F

from veinworks.operators import evaluation, gates, graph, identity, lexical, retrieval, support
from veinworks.plans.bindings import assertions
from veinworks.sources import files
from veinworks.streaming import ingest

ROWS = "claim_id long, family_id long, doc_id long, evidence_id string, q double"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_one_family_cannot_exceed_its_share(spark):
    df = spark.createDataFrame([(1, 1, 1, "a", 0.9), (1, 1, 2, "b", 0.8), (2, 1, 1, "c", 0.9), (2, 2, 1, "d", 0.5), (2, 3, 1, "e", 0.1)], ROWS)
    assert rows(support.capped_support(df), "claim_id", "support") == [(1, 0.45), (2, 0.7)]
    assert rows(support.capped_support(df, source="doc_id"), "claim_id", "support") == [(1, 0.85), (2, 0.45)]
    copies = support.replication_pressure(df, (1, 3))
    assert [r["by_family"] for r in copies.orderBy("copies").collect()] == [0.575, 0.575]


def test_scores_of_unknown_levels_are_zero(spark):
    df = spark.createDataFrame([("E1", "entailed"), ("E3", "undetermined"), ("E9", "entailed"), ("E1", None)], "level string, status string")
    got = df.select("level", "status", support.heuristic_score(F.lit(0.8), F.col("level"), F.col("status")).alias("q")).collect()
    assert [r["q"] for r in got] == [0.8, 0.45, 0.0, 0.0]


def test_stages_shrink_and_nulls_fail(spark):
    df = spark.createDataFrame([("build_train", False, "E1", "entailed", 0.95, 1, 1, 1), ("build_train", None, "E1", "entailed", 0.95, 1, 1, 1), ("development", False, "E2", "entailed", 0.5, 2, 2, 2)], "split string, inferred boolean, level string, status string, q double, claim_id long, doc_id long, family_id long")
    assert {r["stage"]: r["rows"] for r in gates.stage_table(df).collect()} == {"B0": 3, "B1": 2, "B2": 2, "B3": 2, "Ours": 1}
    assert [r["removed"] for r in gates.funnel(df).collect()] == [1, 0, 0, 1]


def test_dice_and_bigrams(spark):
    got = spark.createDataFrame([("Ab c", "abd"), ("", "x"), ("x", "X"), (" ", "")], "a string, b string").select(lexical.dice(lexical.bigrams(F.col("a")), lexical.bigrams(F.col("b"))).alias("d")).collect()
    assert [r["d"] for r in got] == [0.5, 0.0, 1.0, 0.0]


def test_pagerank_keeps_lone_seeds_and_mass(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")], "a string, b string")
    got = {r["node"]: r["rank"] for r in graph.pagerank(links, spark.createDataFrame([("a",), ("lone",)], "node string"), 50, tolerance=1e-9).collect()}
    assert abs(sum(got.values()) - 1) < 1e-6 and abs(got["lone"] - 0.5) < 1e-6 and got["b"] > got["c"]


def test_hops_and_scores(spark):
    chain = [(str(i), str(i + 1)) for i in range(5)]
    links = spark.createDataFrame(chain + [(b, a) for a, b in chain], "a string, b string")
    seed = spark.createDataFrame([("0", 1.0)], "node string, score double")
    assert rows(graph.hops(links, seed, 2), "node", "hop") == [("0", 0), ("1", 1), ("2", 2)]
    assert rows(graph.hop_scores(links, seed, 2, 0.5), "node", "score") == [("0", 1.0), ("1", 0.5), ("2", 0.25)]


def test_selector_keeps_caps_and_order(spark):
    pool = spark.createDataFrame([(1, 1, 10, 1, 1, 0.9), (1, 2, 11, 1, 2, 0.89), (1, 3, 12, 1, 3, 0.88), (1, 4, 13, 2, 1, 0.8), (1, 5, 14, 2, 4, 0.8)], "query_id long, rank int, evidence_id long, family_id long, claim_id long, score double")
    got = retrieval.select(pool, 4, family_cap=2).orderBy("position").collect()
    assert [r["evidence_id"] for r in got] == [10, 14, 11, 13]
    assert retrieval.select(pool, 4, minimum=0.95).count() == 1


def test_metrics_leave_out_unanswerable_queries(spark):
    ranked = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 5, 1)], "query_id long, evidence_id long, rank int")
    relevant = spark.createDataFrame([(1, 6), (1, 9), (3, 1)], "query_id long, evidence_id long")
    got = rows(evaluation.ranking_metrics(ranked, relevant, 3), "query_id", "recall", "mrr", "ndcg")
    assert got[0][:3] == (1, 0.5, 0.5) and got[1] == (3, 0.0, 0.0, 0.0) and len(got) == 2


def test_pareto_front_of_ties(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 1.0), (3, 0.5, 0.5), (4, 2.0, 1.0), (5, 9.0, 3.0)], "id long, low double, high double")
    assert rows(evaluation.pareto_front(df, "id", "low", "high"), "id") == [(1,), (2,), (3,), (5,)]


def test_rules_report_examples(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, x int")
    got = identity.report([identity.rule("r", "error", df, F.col("x") == 0, F.col("id")), identity.rule("s", "warning", df, F.col("x") > 5, F.col("id"))]).collect()
    assert [(r["violations"], r["blocking"], len(r["examples"].split(","))) for r in got] == [(10, True, 8), (0, False, 1)]


def test_dense_blocks_equal_one_block(spark):
    v = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(40)], "evidence_id long, vector array<float>")
    q = v.where("evidence_id < 6").select(F.col("evidence_id").alias("query_id"), F.col("vector").alias("query"))
    assert rows(retrieval.dense(q, v, 3), "query_id", "rank", "evidence_id") == rows(retrieval.dense(q, v, 3, limit=2), "query_id", "rank", "evidence_id")


def test_records_and_caches(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "x": "a"}\n\n{"id": 2, "x": "b"}\nnot json\n')
    path = str(tmp_path / "a.jsonl")
    assert files.read_records(spark, path, "id long, x string", strict=False).where("id is not null").count() == 2
    assert files.malformed(spark, path).count() == 1
    with pytest.raises(Exception):
        files.read_records(spark, path, "id long, x string").collect()
    (tmp_path / "m.csv").write_text("﻿doc_id,title\n1, x \n", encoding="utf-8")
    assert files.read_manifest(spark, str(tmp_path / "m.csv")).collect()[0].asDict() == {"doc_id": "1", "title": "x"}
    asked = spark.createDataFrame([("k1",), ("k2",), ("k2",)], "key string")
    held = spark.createDataFrame([("k1", "old")], "key string, response string")
    got = files.read_through(asked, held, lambda missing: missing.withColumn("response", F.lit("new")))
    assert rows(got, "key", "response", "origin") == [("k1", "old", "CACHE"), ("k2", "new", "MODEL"), ("k2", "new", "MODEL")]
    twice = files.repeated_ids({"l": (asked, "key")})
    assert rows(twice, "layer", "id", "rows") == [("l", "k2", 2)]
    with pytest.raises(ValueError):
        files.require_empty(twice, "ids repeat")


def test_stream_equals_batch(spark, tmp_path):
    batch = assertions(spark, "/root/testdata/sf0.001")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.validated(spark, str(tmp_path / "in"), batch.schema, per_trigger=1).where(F.size("reasons") == 0)
    query = stream.writeStream.format("memory").queryName("accepted").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("accepted").count() == gates.with_reasons(batch).where(F.size("reasons") == 0).count()
