"""Operators and queries read all their rows; compared with brute force and with SQL over whole tables."""

import random

import duckdb

from veinworks.operators import retrieval
from veinworks.plans import catalogue
from veinworks.plans.bindings import ASSERTIONS

SF = "/root/testdata/sf0.01"


def whole(sql):
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return sorted(con.execute(sql).fetchall())


def test_hard_negatives_rank_every_other_row(spark):
    rng = random.Random(3)
    rows = [(f"e{i:03}", rng.randrange(6), rng.randrange(3), rng.randrange(4), rng.randrange(5) / 4) for i in range(60)]
    asked = [(q, q % 6, q % 3, q % 4) for q in range(8)] + [(8, 9, 9, 9), (9, None, 1, None)]
    candidates = spark.createDataFrame(rows, "evidence_id string, fault_id int, role int, family_id int, confidence double")
    queries = spark.createDataFrame(asked, "query_id long, fault_id int, role int, family_id int")
    for pool in (3, 12, 100):
        got = retrieval.hard_negatives(queries, candidates, pool).collect()
        for q, fault, role, family in asked:
            want = sorted((r for r in rows if r[3] != family), key=lambda r: ((r[1] == fault) + (r[2] == role), r[2] == role, r[4], r[0]), reverse=True)  # noqa: B023
            assert [r["evidence_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [r[0] for r in want[:pool]]


def test_hard_negatives_of_the_tables(spark):
    want = whole(f"""WITH {ASSERTIONS}, n AS (SELECT i.item_id AS query_id, evidence_id, confidence, (fault_id = i.item_id % 10)::int + (role = i.item_id % 4)::int AS hits, role = i.item_id % 4 AS same_role
      FROM benchmark i JOIN assertions a ON a.family_id <> i.item_id % 25)
      SELECT query_id, evidence_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, same_role DESC, confidence DESC, evidence_id DESC) AS rank FROM n) WHERE rank <= 15""")
    assert sorted(map(tuple, catalogue.QUERIES["hard_negatives"](spark, SF).collect())) == want


def test_intervals_of_one_key_are_cut_and_meet_once(spark, monkeypatch):
    from veinworks.operators import bundles, intervals

    rng = random.Random(5)
    spans = [(i, 1, x := rng.randrange(90), x + rng.randrange(40)) for i in range(150)] + [(999, 2, 5, 5), (998, 1, 9, 3), (997, 1, None, 3)]
    rows = spark.createDataFrame(spans, "id long, k int, start int, end int")
    monkeypatch.setattr(intervals, "SIDE", 7)
    met = intervals.overlapping(rows, rows, ["k"], 10.0)
    assert met.rdd.getNumPartitions() > 100
    fine = [s for s in spans if s[2] is not None and s[2] <= s[3]]
    want = sorted((a[0], b[0]) for a in fine for b in fine if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])
    assert sorted((r["id"], r["other_id"]) for r in met.select("id", "other_id").collect()) == want
    cells = spark.createDataFrame([(1, 1, 0, 6), (1, 2, 0, 6), (1, 3, 50, 51), (2, 1, 3, 4), (None, 1, 3, 4)], "table_id int, cell_id int, top int, bottom int")
    lines = spark.createDataFrame([(1, 6.5)] * 30 + [(1, -0.5), (1, 6.51), (2, 3.0), (None, 3.0)], "table_id int, centre double")
    assert sorted(map(tuple, bundles.row_counts(cells, lines).collect())) == [(1, 1, 31), (1, 2, 31), (2, 1, 1)]
