"""The library's canonical views over the driver's tables, as DataFrames and as the same SQL for DuckDB.

``VIEWS`` are common table expressions that both engines run unchanged, so a
query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evidence record per line item: ids, source, confidence, level, entailment status, split, fault, role."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_returnflag", "l_linestatus", "l_quantity")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = items.join(suppliers, items["l_suppkey"] == suppliers["s_suppkey"])
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("evidence_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("triple_id"),
        F.col("l_partkey").alias("claim_id"),
        F.col("l_orderkey").alias("doc_id"),
        F.col("s_nationkey").alias("family_id"),
        F.round(1 - F.col("l_discount").cast("double"), 6).alias("confidence"),
        F.when(F.col("l_returnflag") == "A", "E1").when(F.col("l_returnflag") == "N", "E2").otherwise("E3").alias("level"),
        F.when(F.col("l_linestatus") == "O", "entailed").otherwise("undetermined").alias("status"),
        F.when(F.col("l_orderkey") % 10 == 0, "held_out_test").when(F.col("l_orderkey") % 10 == 1, "development").otherwise("build_train").alias("split"),
        (F.col("l_partkey") % 10).alias("fault_id"),
        (F.col("l_linenumber") % 4).alias("role"),
        (F.col("l_quantity") >= 50).alias("inferred"),
        F.col("l_suppkey").alias("tail_id"),
    )


#: The same view in SQL.
ASSERTIONS = """assertions AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS evidence_id,
    concat_ws('-', l_orderkey, l_linenumber) AS triple_id, l_partkey AS claim_id, l_orderkey AS doc_id,
    s_nationkey AS family_id, round(1 - CAST(l_discount AS double), 6) AS confidence,
    CASE l_returnflag WHEN 'A' THEN 'E1' WHEN 'N' THEN 'E2' ELSE 'E3' END AS level,
    CASE WHEN l_linestatus = 'O' THEN 'entailed' ELSE 'undetermined' END AS status,
    CASE WHEN l_orderkey % 10 = 0 THEN 'held_out_test' WHEN l_orderkey % 10 = 1 THEN 'development' ELSE 'build_train' END AS split,
    l_partkey % 10 AS fault_id, l_linenumber % 4 AS role, l_quantity >= 50 AS inferred, l_suppkey AS tail_id
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""

#: Heuristic score of an assertion: confidence times the weights of its level and of its entailment status.
SCORED = (
    ASSERTIONS
    + """, scored AS (
  SELECT *, round(confidence * CASE level WHEN 'E1' THEN 1.0 WHEN 'E2' THEN 0.95 WHEN 'E3' THEN 0.75 ELSE 0.0 END
    * CASE status WHEN 'entailed' THEN 1.0 WHEN 'undetermined' THEN 0.75 ELSE 0.0 END, 6) AS q FROM assertions)"""
)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected links (a, b) between suppliers and parts of line items, each once in either direction."""
    keys = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    pairs = keys.select(F.concat(F.lit("S-"), "l_suppkey").alias("a"), F.concat(F.lit("P-"), "l_partkey").alias("b"))
    return pairs.union(pairs.select("b", "a"))


EDGES = """pairs AS (SELECT DISTINCT concat('S-', l_suppkey) AS a, concat('P-', l_partkey) AS b FROM lineitem),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs)"""


def ranked_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run rows from events: method, query_id, repeat, latency, in order of time."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("method"), F.col("user_id").alias("query_id"), (F.col("event_id") % 3).alias("repeat"), F.col("value").cast("double").alias("latency"), "ts", "event_id")


RUNS = "runs AS (SELECT event_type AS method, user_id AS query_id, event_id % 3 AS repeat, CAST(value AS double) AS latency, ts, event_id FROM events)"
