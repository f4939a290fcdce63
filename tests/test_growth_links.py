"""Rounds and pairs whose shuffles or tasks grew faster than their input: same results, bounded shares."""

import random
from collections import Counter

from veinworks.operators import graph, lexical, postings


def test_rounds_of_ranks_leave_the_links_where_they_lie(spark, monkeypatch):
    written, plans = [], []
    keep = graph.checkpointed

    def checkpointed(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        written.append(keep(df))
        return keep(written[-1])

    monkeypatch.setattr(graph, "checkpointed", checkpointed)
    near = [("s", "p"), ("p", "s"), ("s", "q"), ("q", "s"), ("q", "sink"), ("t", "q"), (None, "q"), ("s", None)]
    far = [(f"f{i}", f"f{(i + 1) % 50}") for i in range(50)]
    seeds = ["s", "lone"]
    got = {r["node"]: r["rank"] for r in graph.pagerank(spark.createDataFrame(near + far, "a string, b string"), spark.createDataFrame([(x,) for x in seeds], "node string"), 4).collect()}

    links = near + far
    every = {a for a, _ in links} | set(seeds)
    start = {n: 0.5 if n in seeds else 0.0 for n in every}
    degree = {n: sum(a == n for a, _ in links) for n in every}
    want = dict(start)
    for _ in range(4):
        sums = {n: sum(want[a] / degree[a] for a, b in links if b == n and n is not None and a is not None) for n in every}
        want = {n: 0.15 * start[n] + 0.85 * (sums[n] if degree[n] else want[n]) for n in every}
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-12 for n in want)
    assert all(df.count() <= 8 for df in written[:-1])  # the far circle has no rows in the rounds
    rounds = [p for p in plans if "Bucketed: true" in p and " full" in p.lower()]
    assert len(rounds) == 4
    for p in rounds:
        scans = [i for i, line in enumerate(p.splitlines()) if "Bucketed: true" in line and "b#" in line.split("PartitionFilters")[0]]
        assert scans and all("Exchange" not in "".join(p.splitlines()[i - 3 : i]) for i in scans)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


def test_keys_of_fingerprints_are_dealt_by_their_number_and_pairs_told_once(spark, monkeypatch):
    r = random.Random(5)
    monkeypatch.setattr(lexical, "BAND_KEYS", 100, raising=False)
    base = [r.getrandbits(60) for _ in range(20)]
    hashes = base + [h ^ sum(1 << b for b in r.sample(range(60), d)) for h in base for d in (1, 2, 3, 4)] + [base[0] ^ 1 << b for b in range(60)] + base[:5] + [0, (1 << 60) - 1]
    pairs = lexical.near_hashes(spark.createDataFrame([(h,) for h in hashes], "hash long"))
    n = Counter(hashes)
    distinct = sorted(n)
    want = [(a, b, n[a], n[b], (a ^ b).bit_count()) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= 3]
    assert sorted(map(tuple, pairs.select("hash", "other", "rows", "other_rows", "distance").collect())) == want
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "band#" in plan and f"{-(-len(distinct) * 20 // 100)}), REPARTITION_BY_NUM" in plan and "HashAggregate" not in plan


def test_an_index_keeps_lists_of_a_shard_and_takes_queries_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "SHARD", 40)
    monkeypatch.setattr(postings, "BLOCK", 4)
    monkeypatch.setattr(postings, "BATCH", 30, raising=False)
    written, keep = [], postings.checkpointed
    monkeypatch.setattr(postings, "checkpointed", lambda df: written.append(keep(df)) or written[-1])
    r = random.Random(6)
    words = ["the"] * 20 + [f"w{k}" for k in range(30)]
    corpus = spark.createDataFrame([(f"d{i}", " ".join(r.choice(words) for _ in range(r.randrange(0, 30)))) for i in range(110)] + [("null", None)], "doc_id string, text string")
    path = str(tmp_path / "index")
    postings.build(corpus, path)
    # a row for each token of a shard, and one for the shard, instead of one for each posting
    assert written[0].count() <= 3 * (31 + 1)
    queries = spark.createDataFrame([(q, " ".join(r.sample(words, 3))) for q in "abcde"] + [("x", "unknown"), ("y", None)], "query_id string, text string")
    want = sorted((x["query_id"], x["rank"], x["doc_id"]) for x in lexical.bm25(corpus, queries, 4).collect())
    for limit in (500, 2):
        assert sorted((x["query_id"], x["rank"], x["doc_id"]) for x in postings.search(spark, path, queries, 4, limit)[0].collect()) == want
    nothing = str(tmp_path / "nothing")
    postings.build(corpus.limit(0), nothing)
    assert postings.search(spark, nothing, queries, 4)[0].count() == 0
