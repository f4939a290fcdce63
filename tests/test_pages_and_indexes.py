"""Page acceptance, the kept index, matrix passes, exact quantiles, fronts, numbering and bootstraps against plain code."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veinworks.functions.numbering import numbered, numbered_within
from veinworks.operators import evaluation, lexical, page_pool, postings, quantiles, retrieval, skyline, vector_index


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def taken_by_hand(pages, links, per_document, total):
    near = {frozenset(x) for x in links}
    taken, out = [], []
    for page_id, doc, score, digest, print_ in sorted(pages, key=lambda p: (-p[2], p[0])):
        if total is not None and len(taken) >= total:
            break
        same = next((t[0] for t in taken if t[2] == digest), None)
        close = next((t[0] for t in taken if t[3] == print_ or frozenset((t[3], print_)) in near), None)
        if per_document is not None and sum(t[1] == doc for t in taken) >= per_document:
            out.append((page_id, page_pool.DOCUMENT_LIMIT, None))
        elif same is not None:
            out.append((page_id, page_pool.EXACT, same))
        elif close is not None:
            out.append((page_id, page_pool.NEAR, close))
        else:
            taken.append((page_id, doc, digest, print_))
            out.append((page_id, None, None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "per_document", "total"), [(1, None, None), (2, 3, None), (3, 2, 9), (4, 1, 100)])
def test_greedy_acceptance_equals_a_pass(spark, seed, per_document, total):
    r = random.Random(seed)
    prints = list(range(25))
    links = sorted({tuple(sorted(r.sample(prints, 2))) for _ in range(20)})
    # chains of links, equal scores, one hot document, digests and fingerprints that many pages share
    pages = [(i, r.choice(["hot", "hot", "a", "b", f"d{i}"]), float(r.randrange(6)), f"x{r.randrange(40)}", r.choice(prints)) for i in range(90)]
    df = spark.createDataFrame(pages, "page_id long, doc_id string, score double, digest string, fingerprint long")
    got = page_pool.decided(df, spark.createDataFrame(links, "hash long, other long"), per_document, total)
    assert rows_of(got, "page_id", "decision", "duplicate_of") == taken_by_hand(pages, links, per_document, total)


def test_acceptance_of_no_page(spark):
    empty = spark.createDataFrame([], "page_id long, doc_id string, score double, digest string, fingerprint long")
    assert page_pool.decided(empty, spark.createDataFrame([], "hash long, other long"), 2, 5).count() == 0


def test_kept_index_gives_the_rows_of_a_full_pass_and_skips_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 4)
    monkeypatch.setattr(postings, "SHARD", 150)
    r = random.Random(4)
    words = ["the"] * 30 + ["of"] * 20 + [f"w{k}" for k in range(60)]
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 40)))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "the the the the")]
    corpus = spark.createDataFrame(texts, "doc_id long, text string")
    path = str(tmp_path / "index")
    postings.build(corpus, path)
    for asked in ([(1, "the w3"), (2, "W7 w8 w9, of?"), (3, "unknown"), (4, "w1")], [(9, "the of"), (10, None)]):
        queries = spark.createDataFrame(asked, "query_id long, text string")
        best, report = postings.search(spark, path, queries, 5)
        want = {(x["query_id"], x["rank"]): (x["doc_id"], x["score"]) for x in lexical.bm25(corpus, queries, 5).collect()}
        got = {(x["query_id"], x["rank"]): (x["doc_id"], x["score"]) for x in best.collect()}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], abs_tol=2e-6) for k in got)
        told = {x["query_id"]: (x["read"], x["held"]) for x in report.collect()}
        assert all(a <= b for a, b in told.values())
        if 1 in told:
            # a rare word's bound keeps many blocks of the common one; of one word alone, the first blocks suffice
            assert told[1][0] < told[1][1] and told[4][0] <= told[4][1] / 2
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.where("n > 4").count() == 0 and blocks.select("shard").distinct().count() == 3


def test_dice_fills_up_with_labels_that_share_nothing(spark):
    labels = spark.createDataFrame([(3, "abc"), (1, "xyz"), (2, None), (5, ""), (4, "abd")], "evidence_id long, label string")
    queries = spark.createDataFrame([(1, "ab"), (2, "qq"), (3, None)], "query_id long, text string")
    assert rows_of(lexical.dice_top(labels, queries, 3), "query_id", "rank", "evidence_id", "score") == [(1, 1, 3, 0.666667), (1, 2, 4, 0.666667), (1, 3, 1, 0.0), (2, 1, 1, 0.0), (2, 2, 2, 0.0), (2, 3, 3, 0.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0), (3, 3, 3, 0.0)]


def test_dense_rows_with_ties_nulls_and_other_lengths(spark):
    r = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in np.round(r.normal(size=4), 1)]) for i in range(300)] + [(1000, None), (1001, [1.0]), (1002, [1.0, None, 1.0, 1.0]), (1003, [1.0, 0.0, 0.0, 0.0]), (1004, [1.0, 0.0, 0.0, 0.0])]
    corpus = spark.createDataFrame(vectors, "evidence_id long, vector array<float>").repartition(5)
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.5, -1.0, 2.0, 0.0]), (3, None), (4, [2.0])], "query_id long, query array<float>")
    for limit in (4_000_000, 4):
        got = rows_of(retrieval.dense(queries, corpus, 7, limit), "query_id", "rank", "evidence_id", "score")
        want = []
        for q, asked in [(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.5, -1.0, 2.0, 0.0]), (4, [2.0])]:
            scores = sorted((-round(float(np.float32(np.array(v, np.float32)) @ np.array(asked)), 6), i) for i, v in vectors if v is not None and None not in v and len(v) == len(asked))
            want += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:7], 1)]
        assert [x[:3] for x in got] == sorted([x[:3] for x in want], key=str)
        assert all(math.isclose(a[3], b[3], abs_tol=1e-5) for a, b in zip(got, sorted(want, key=str), strict=True))


@pytest.mark.parametrize("bins", [2, 7, 1024])
def test_exact_quantiles_by_histograms(spark, bins):
    r = random.Random(9)
    rows = [("a", r.choice([0.0, 1.0, 1.0, -3.5, 1e9, 1e-9])) for _ in range(400)] + [("b", r.gauss(0, 1)) for _ in range(333)] + [(None, float(k)) for k in range(21)] + [("one", 4.25), ("two", 1.0), ("two", 2.0), ("a", None), ("none", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    shares = (0.0, 0.025, 0.5, 0.95, 1.0)
    got = {x["g"]: x for x in quantiles.exact_quantiles(df, ("g",), "v", shares, most=5, bins=bins).collect()}
    assert got.keys() == {"a", "b", None, "one", "two"}
    for g, x in got.items():
        values = [v for k, v in rows if k == g and v is not None and not math.isnan(v)]
        assert x["n"] == len(values)
        for i, q in enumerate(shares):
            assert math.isclose(x[f"q{i}"], float(np.quantile(values, q)), rel_tol=1e-12, abs_tol=1e-12)
    whole = quantiles.exact_quantiles(df, (), "v", (0.5,), most=5, bins=bins).collect()
    assert math.isclose(whole[0]["q0"], float(np.median([v for _, v in rows if v is not None and not math.isnan(v)])))


def test_quantiles_of_nothing(spark):
    assert quantiles.exact_quantiles(spark.createDataFrame([], "g string, v double"), ("g",), "v", (0.5,)).count() == 0


def test_skyline_in_four_measures(spark, monkeypatch):
    monkeypatch.setattr(skyline, "BLOCK", 5)
    monkeypatch.setattr(skyline, "HELD", 20)
    r = random.Random(2)
    rows = [(i, *(float(r.randrange(6)) for _ in range(4))) for i in range(300)] + [(1000, None, 0.0, 9.0, 9.0), (1001, float("nan"), 0.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double").repartition(7)
    points = [(i, a, b, -c, -d) for i, a, b, c, d in rows[:300]]
    want = sorted(p[0] for p in points if not any(all(x <= y for x, y in zip(o[1:], p[1:], strict=True)) and o[1:] != p[1:] for o in points))
    assert sorted(x["id"] for x in skyline.skyline(df, ("a", "b"), ("c", "d")).collect()) == want
    assert skyline.skyline(df.limit(0), ("a",), ("c",)).count() == 0


def test_numbers_without_a_window(spark):
    r = random.Random(6)
    rows = [(r.choice(["hot"] * 6 + ["a", None]), k) for k in range(500)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k long").repartition(9)
    assert [x["k"] for x in sorted(numbered(df, "k").collect(), key=lambda x: x["number"])] == list(range(500))
    place = {g: 0 for g, _ in rows}
    for x in sorted(numbered_within(df, "g", "k").collect(), key=lambda x: x["k"]):
        assert x["number"] == place[x["g"]]
        place[x["g"]] += 1
    assert numbered(df.limit(0), "k").count() == 0
    plan = numbered_within(df, "g", "k")._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_bootstraps_share_draws(spark):
    pairs = spark.createDataFrame([(k, float(k % 7), float(k % 5)) for k in range(60)], "cluster long, left double, right double")
    mean = rows_of(evaluation.bootstrap_gap(pairs, 20), "replicate", "value")
    plugged = rows_of(evaluation.bootstrap_gap(pairs, 20, lambda v: v.mean()), "replicate", "value")
    assert len(mean) == 20 and all(a[0] == b[0] and math.isclose(a[1], b[1], abs_tol=1.1e-6) for a, b in zip(mean, plugged, strict=True))
    p95 = rows_of(evaluation.bootstrap_gap(pairs, 20, "p95"), "replicate", "value")
    by_hand = rows_of(evaluation.bootstrap_gap(pairs, 20, lambda v: np.quantile(v, 0.95)), "replicate", "value")
    assert all(math.isclose(a[1], b[1], abs_tol=1.1e-6) for a, b in zip(p95, by_hand, strict=True))
    times = evaluation.drawn(pairs, 20).groupBy("replicate").agg(F.sum("times").alias("n"))
    assert {x["n"] for x in times.collect()} == {60}


def test_scripts_of_all_han_ranges(spark):
    texts = [("㐁" * 20, "zh", 1.0), ("豈" * 30, "zh", 1.0), ("a" * 19, "und", 0.0), ("a" * 20, "en", 1.0), ("a" * 10 + "更" * 10, "multilingual", 1.0), (None, "und", 0.0)]
    df = spark.createDataFrame([(t,) for t, _, _ in texts], "t string").select(lexical.script_parts(F.col("t")).alias("x"))
    assert [(r["x"]["script"], r["x"]["confidence"]) for r in df.collect()] == [(s, c) for _, s, c in texts]


def test_kept_vectors_are_checked_and_found(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 16)
    r = np.random.default_rng(3)
    x = r.normal(size=(100, 5))
    rows = [(f"e{i:03}", [float(c) for c in v]) for i, v in enumerate(x)] + [("zero", [0.0] * 5), ("none", None), (None, [1.0] * 5), ("hole", [1.0, None, 1.0, 1.0, 1.0])]
    corpus = spark.createDataFrame(rows, "evidence_id string, vector array<double>").repartition(3)
    queries = spark.createDataFrame([(1, [float(c) for c in x[7] * 3]), (2, [1.0, 0.0, 0.0, 0.0, 0.0]), (3, [1.0])], "query_id int, query array<double>")
    path = str(tmp_path / "v")
    vector_index.save(corpus, path)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = []
    for q, asked in ((1, x[7]), (2, np.eye(5)[0])):
        scores = np.round(unit @ (asked / np.linalg.norm(asked)), 6)
        want += [(q, n, f"e{i:03}") for n, i in enumerate(np.lexsort((np.arange(100), -scores))[:4], 1)]
    for limit in (4_000_000, 5):
        assert rows_of(vector_index.search(spark, path, queries, 4, limit), "query_id", "rank", "evidence_id") == want
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.count() >= 7
    changed = str(tmp_path / "w")
    blocks.withColumn("data", F.concat(F.substring("data", 1, 8), F.expr("X'0000000000000001'"), F.expr("substring(data, 17)"))).write.parquet(f"{changed}/blocks")
    spark.read.parquet(f"{path}/about").write.parquet(f"{changed}/about")
    with pytest.raises(ValueError, match="blocks differ"):
        vector_index.search(spark, changed, queries, 4)
    lost = str(tmp_path / "x")
    blocks.limit(3).write.parquet(f"{lost}/blocks")
    spark.read.parquet(f"{path}/about").write.parquet(f"{lost}/about")
    with pytest.raises(ValueError, match="rows, saved were 101"):
        vector_index.load(spark, lost)
    with pytest.raises(ValueError, match="several lengths"):
        vector_index.save(queries.select(F.col("query_id").alias("evidence_id"), F.col("query").alias("vector")), str(tmp_path / "y"))
