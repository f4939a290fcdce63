"""Every query with an oracle gives the oracle's rows; every other query runs."""

import math
import os

import duckdb
import pytest

from veinworks.plans import catalogue, catalogue_bundles, catalogue_candidates, catalogue_competency, catalogue_contracts, catalogue_curation, catalogue_evaluation, catalogue_mapping, catalogue_pages, catalogue_records  # noqa: F401  the others register their queries in the first

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, (int, float)) and math.isclose(a, b, abs_tol=1.01e-6)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    if name not in catalogue.ORACLES:
        assert rows
        return
    cur = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in cur.fetchall()), key=str)
    assert len(rows) == len(want)
    wrong = [(a, b) for a, b in zip(rows, want, strict=True) if not all(map(same, a, b))]
    assert not wrong, wrong[:3]


def test_words_end_at_letters_beyond_ascii_as_in_sql(spark, duck):
    from veinworks.operators import curation, validation
    from veinworks.plans.catalogue_records import _CLASSES, _VETOES

    texts = ["lesé", "les", "éles o", "blés", "the_", "né der!", "seaé", r"a\b", "œuf 12", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    duck.execute("CREATE OR REPLACE TEMP TABLE documents AS SELECT * FROM (VALUES " + ", ".join(f"({i}, ${i + 1})" for i in range(len(texts))) + ") t(doc_id, text)", texts)
    want = duck.execute(catalogue.ORACLES["fault_mapping"]).fetchall()
    got = validation.classified(rows, "doc_id", "text", _CLASSES, _VETOES).selectExpr("doc_id", "array_join(classes, ',')")
    duck.execute("DROP TABLE temp.documents")
    assert sorted(map(tuple, got.collect())) == sorted(want) and dict(want)[0] == "wear"
    marketing = "all rights reserved, contact us " * 4
    pages = spark.createDataFrame([(marketing + "pumpé",), (marketing + "épump",), (marketing + "xpump",)], "text string")
    assert [r[0] for r in pages.select(curation.is_low_value(pages["text"])).collect()] == [False, False, True]
