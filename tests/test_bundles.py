"""Record bundles on nulls, missing sides, empty tables and edges of ranges."""

from pyspark.sql import functions as F

from veinworks.operators import bundles, gates, graph, lexical, support


def test_bundles_tell_missing_sides_before_failed_tests(spark):
    links = spark.createDataFrame([(1, 1), (2, 1), (3, 9), (4, 2), (5, 2)], "evidence_id int, source_id int")
    evidence = spark.createDataFrame([(1, 5), (3, 5), (4, -1), (5, None)], "evidence_id int, size int")
    sources = spark.createDataFrame([(1, "a"), (2, "b")], "source_id int, name string")
    got = {r["evidence_id"]: r["reasons"] for r in bundles.bundled(links, evidence, sources, {"small": "size > 0", "unnamed": "name = 'a'"}).collect()}
    assert got == {1: [], 2: ["evidence_missing"], 3: ["source_missing"], 4: ["small", "unnamed"], 5: ["small", "unnamed"]}


def test_null_predicates_fail_and_scores_are_held_between_0_and_1(spark):
    rows = spark.createDataFrame([(None, False, "E1", "entailed", 1.0, 1), ("build_train", None, "E1", "entailed", 1.0, 1), ("build_train", False, "E1", "entailed", 1.0, 1)], "split string, inferred boolean, level string, status string, confidence double, family_id int")
    assert [r["reasons"] for r in gates.with_reasons(rows).collect()] == [["not_build_split"], ["inferred"], []]
    assert [r[0] for r in rows.select(gates.released("family_id")).collect()] == [False, False, True]
    some = spark.createDataFrame([(1.7,), (-3.0,), (None,), (float("nan"),), (0.5,)], "c double")
    assert [r[0] for r in some.select(support.heuristic_score(F.col("c"), F.lit("E1"), F.lit("entailed"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.5]
    flags = spark.createDataFrame([("x", True), (None, True), (None, False), (None, None)], "s string, f boolean")
    assert [r[0] for r in flags.select(support.status_or_flag(F.col("s"), F.col("f"))).collect()] == ["x", "entailed", "undetermined", ""]


def test_quotes_and_unique_places(spark):
    rows = spark.createDataFrame([("Some  Words here", "xx some words HERE yy"), ("short", "short"), ("not in there", "x"), (None, "x"), ("a quote too", None)], "q string, t string")
    assert [r[0] for r in rows.select(bundles.quote_verified(F.col("q"), F.col("t"))).collect()] == [True, False, False, False, False]
    places = spark.createDataFrame([("abcabc", "ab"), ("xabc", "ab"), ("abc", ""), (None, "a"), ("abc", "z")], "t string, n string")
    assert [r[0] for r in places.select(bundles.unique_start(F.col("t"), F.col("n"))).collect()] == [-1, 1, -1, -1, -1]


def test_strict_pairing_sees_gaps_and_repeats(spark):
    left = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    right = spark.createDataFrame([(2,), (3,)], "k int")
    assert bundles.strictly_paired(left, right, "k").first().asDict() == {"paired": 1, "only_left": 1, "only_right": 1, "repeated": 1, "complete": False}
    assert bundles.strictly_paired(left.limit(0), right.limit(0), "k").first()["complete"]


def test_near_hashes_against_all_pairs(spark):
    import random

    r = random.Random(4)
    base = [r.getrandbits(60) for _ in range(30)]
    hashes = base + [h ^ sum(1 << b for b in r.sample(range(60), d)) for h in base for d in (1, 2, 3, 4)] + base[:3]
    got = {(x["hash"], x["other"]) for x in lexical.near_hashes(spark.createDataFrame(list(enumerate(hashes)), "doc_id long, hash long")).collect()}
    distinct = sorted(set(hashes))
    assert got == {(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= 3}


def test_pagerank_stops_by_tolerance(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")], "a string, b string")
    seeds = spark.createDataFrame([("a",)], "node string")
    early = {r["node"]: r["rank"] for r in graph.pagerank(links, seeds, 100, tolerance=1e-3).collect()}
    late = {r["node"]: r["rank"] for r in graph.pagerank(links, seeds, 30).collect()}
    assert abs(sum(early.values()) - 1) < 1e-9 and all(abs(early[n] - late[n]) < 2e-2 for n in late)
