"""Candidates, hybrid retrieval and curation on nulls, empty tables, ties and repeated rows."""

from pyspark.sql import functions as F

from veinworks.operators import candidates, curation, hybrid

FIELDS = "candidate_id long, head string, head_type string, relation string, tail string, tail_type string, text string, evidence string, structured string, checked boolean, split string, inferred boolean, confidence double"
CELLS = "candidate_id long, table_id string, row_id string, column_name string, group_id string, start int, end int, cell string, has_box boolean"
RULES = [("caused_by", "fault", "cause", "causes", True)]


def _validated(spark, rows, cells=()):
    constraints = spark.createDataFrame([("causes", ["cause"], ["fault"])], "relation string, heads array<string>, tails array<string>")
    found = candidates.validated(spark.createDataFrame(rows, FIELDS), spark.createDataFrame(list(cells), CELLS), constraints, RULES, {"causes": r"\bcauses\b"})
    return {r["candidate_id"]: r for r in found.collect()}


def test_validation_of_nulls_and_of_an_empty_table(spark):
    assert _validated(spark, []) == {}
    row = _validated(spark, [(1, *[None] * 12)])[1]
    assert row["decision"] == "rejected" and row["level"] is None and row["final"] == 0.0
    assert {"relation_type_invalid", "evidence_invalid", "relation_not_entailed", "inferred", "held_out"} <= set(row["reasons"])


def test_a_turned_candidate_becomes_silver(spark):
    rows = [(1, "leak", "fault", "caused_by", "wear", "cause", "Seal wear  CAUSES a leak.", "wear causes a leak", None, True, "build_train", False, 0.9)]
    row = _validated(spark, rows)[1]
    assert (row["head"], row["relation"], row["tail"], row["level"], row["status"], row["decision"], row["reasons"]) == ("wear", "causes", "leak", "E1", "entailed", "silver", [])


def test_cells_by_offset_and_by_box(spark):
    rows = [(i, "wear", "cause", "causes", "leak", "fault", "wear leak", None, "causes", True, "build_train", False, 1.0) for i in (1, 2, 3)]
    cells = [(1, "T", "r", "c", None, 0, 4, "wear", False), (1, "T", "r", "c", None, 5, 9, "leak", False)]
    cells += [(2, "T", "r", "c", None, None, None, "wear", True), (2, "T", "s", "c", None, None, None, "leak", True)]
    cells += [(3, "T", "r", "c", "g", None, None, "wear", None), (3, "T", "s", "c", "g", 5, 9, "leak", None)]
    got = _validated(spark, rows, cells)
    assert (got[1]["decision"], got[1]["method"]) == ("silver", "row")
    assert (got[2]["decision"], got[2]["method"]) == ("rejected", "unaligned") and "several_rows" in got[2]["reasons"]
    assert got[3]["method"] == "merged_rows" and "cell_without_place" in got[3]["reasons"]


QUERIES, HITS = "query_id long, role long, fault_name string", "query_id long, evidence_id long, dense double, rank int"
EVIDENCE = "evidence_id long, head_id string, tail_id string, head_label string, tail_label string, role long, family_id long, claim_id long, confidence double"


def test_every_method_with_nulls_ties_and_without_hits(spark):
    evidence = spark.createDataFrame([(i, f"h{i // 2}", f"t{(i + 1) // 2}", "pump", None, i % 2 if i else None, None if i < 2 else i, i, 0.5) for i in range(8)], EVIDENCE)
    queries = spark.createDataFrame([(1, 1, "pump"), (2, None, None)], QUERIES)
    hits = spark.createDataFrame([(1, 0, 0.5, 1), (1, 2, 0.5, 2), (1, 3, 0.4, 3), (2, 4, 0.5, 1), (2, 5, 0.5, 2)], HITS)
    got = {}
    for name, method in hybrid.METHODS.items():
        rows = hybrid.retrieved(queries, hits, evidence, method, 2, anchor_count=2).orderBy("query_id", "position").collect()
        got[name] = [(r["query_id"], r["evidence_id"]) for r in rows]
        assert hybrid.retrieved(queries, hits.where("false"), evidence, method, 2).isEmpty()
    assert got["dense"] == [(1, 2), (1, 0), (2, 5), (2, 4)]  # ties: the greatest id first
    assert got["metapath"] == [(1, 3), (2, 5), (2, 4)]  # without evidence of the role the pool stays whole
    assert {e for q, e in got["full"] if q == 1} <= {1, 3, 5}


def test_quota_pool_takes_each_page_once(spark):
    rows = [(1, "a"), (1, "b"), (1, "a"), (2, "b"), (3, "c"), (3, "c"), (4, "c"), (5, "c")]
    got = curation.quota_pool(spark.createDataFrame(rows, "page long, stratum string"), 4).orderBy("position").collect()
    assert [r["page"] for r in got] == [1, 2, 3, 4]
    assert curation.quota_pool(spark.createDataFrame([], "page long, stratum string"), 4).isEmpty()


def test_small_functions_on_nulls(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    t = F.col("t")
    got = df.select(curation.is_contents(t), curation.is_low_value(t), curation.protected(t, [r"\d+"]), curation.column_role(t), curation.json_of(t), curation.first_number(t, "a")).collect()
    assert [tuple(r) for r in got] == [(False, True, [], "unclassified", None, None)] * 2
