"""Queries over loads, contracts, repairs, resumed runs and boxes on pages, with their equivalents in DuckDB's SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from veinworks.functions.storage import checkpoint_dir
from veinworks.operators import contracts, intervals
from veinworks.plans.bindings import ASSERTIONS, assertions, table
from veinworks.plans.catalogue import query
from veinworks.sources import files
from veinworks.sources.keyed import read_keyed, write_keyed

# --- benchmark records: line items as records of several files --------------------------------

_RECORD = {
    "evidence_id": "CASE WHEN l_partkey % 41 = 0 THEN '' ELSE concat(l_partkey % 500, ':', l_suppkey % 10) END",
    "decision": "CASE l_linenumber % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'silver_candidate' WHEN 2 THEN 'accepted_silver' ELSE 'candidate_needs_review' END",
    "eligible": "CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE l_returnflag <> 'R' END",
    "inferred": "l_quantity >= 45",
    "_file": "l_orderkey",
    "_position": "l_linenumber",
    "claim_id": "l_partkey",
}
_RECORDS = f"records AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _RECORD.items())} FROM lineitem)"
_FIRST = """fine AS (SELECT * FROM records WHERE decision IN ('silver_candidate', 'accepted_silver') AND eligible AND NOT inferred AND evidence_id <> ''),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY _file, _position) AS n FROM fine) WHERE n = 1)"""


def _records(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(*(f"{e} AS {n}" for n, e in _RECORD.items()))


@query(f"WITH {_RECORDS}, {_FIRST} SELECT evidence_id, decision, _file AS file, _position AS position, claim_id FROM kept")
def benchmark_candidates(spark, sf_dir):
    """Released records, the first of each id by file and line."""
    return files.released(_records(spark, sf_dir)).select("evidence_id", "decision", F.col("_file").alias("file"), F.col("_position").alias("position"), "claim_id")


@query(f"WITH {_RECORDS}, {_FIRST} SELECT 'benchmark' AS label, count(*) AS rows, CAST(count(*) AS bigint) AS read_back, CAST(count(*) AS bigint) AS in_files FROM kept")
def benchmark_manifest(spark, sf_dir):
    """The benchmark written through the data source: what its manifest counts, and what is read back."""
    folder = f"{checkpoint_dir(spark)}/benchmark-{uuid.uuid4().hex}"
    kept = files.released(_records(spark, sf_dir)).select("evidence_id", "decision", "claim_id")
    write_keyed(kept, folder, "benchmark")
    fields = "label string, rows long, files array<struct<name: string, rows: long, bytes: long, sha256: string>>"
    told = spark.read.text(f"{folder}/manifest.json", wholetext=True).select(F.from_json("value", fields).alias("m")).select("m.label", "m.rows", F.aggregate("m.files.rows", F.lit(0).cast("long"), lambda a, x: a + x).alias("in_files"))
    back = read_keyed(spark, folder, "evidence_id string, decision string, claim_id long").agg(F.count("*").alias("read_back"))
    return told.join(F.broadcast(back))  # one row each


_WANTED = "wanted AS (SELECT DISTINCT l_orderkey % 20 AS family, l_linenumber * 7 AS page FROM lineitem WHERE l_quantity >= 30)"


@query(f"WITH {_WANTED} SELECT doc_id, source FROM (SELECT doc_id, source, CAST(substr(source, 4) AS bigint) AS family, doc_id % 50 AS page FROM documents) SEMI JOIN wanted USING (family, page)")
def page_lookup(spark, sf_dir):
    """The pages that line items ask for by document and page number."""
    wanted = table(spark, sf_dir, "lineitem").where("l_quantity >= 30").select((F.col("l_orderkey") % 20).alias("family"), (F.col("l_linenumber") * 7).cast("long").alias("page"))
    pages = table(spark, sf_dir, "documents").select("doc_id", "source", F.substring("source", 4, 9).cast("long").alias("family"), (F.col("doc_id") % 50).alias("page"))
    return files.lookup(pages, wanted, ["family", "page"]).select("doc_id", "source")


# --- resumed runs: orders as documents, line items as the pages that were written ------------------

_LINES = """lines AS (SELECT l_orderkey AS doc, l_linenumber AS position, CASE WHEN l_orderkey % 9 = 1 AND l_linenumber = 3 THEN 1 ELSE l_linenumber END AS page, (l_orderkey * 7 + l_linenumber) % 11 <> 0 AS readable,
  CASE WHEN l_partkey % 53 = 0 THEN 'v1' WHEN l_partkey % 59 = 0 THEN NULL ELSE 'v2' END AS version, CASE WHEN l_suppkey % 31 = 0 THEN 'other' ELSE 'digest' END AS digest FROM lineitem)"""


@query(f"""WITH {_LINES}, breaks AS (SELECT doc, min(position) AS first_break FROM lines WHERE NOT readable GROUP BY doc), prefix AS (SELECT lines.* FROM lines LEFT JOIN breaks USING (doc) WHERE first_break IS NULL OR position < first_break),
bad AS (SELECT doc FROM prefix GROUP BY doc HAVING count(DISTINCT page) < count(*) OR bool_or(version IS DISTINCT FROM 'v2' OR digest IS DISTINCT FROM 'digest'))
SELECT doc, position, page FROM prefix WHERE doc NOT IN (SELECT doc FROM bad)""")
def resume_prefix(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS doc", "l_linenumber AS position", "CASE WHEN l_orderkey % 9 = 1 AND l_linenumber = 3 THEN 1 ELSE l_linenumber END AS page", "(l_orderkey * 7 + l_linenumber) % 11 <> 0 AS readable",
        "CASE WHEN l_partkey % 53 = 0 THEN 'v1' WHEN l_partkey % 59 = 0 THEN NULL ELSE 'v2' END AS version", "CASE WHEN l_suppkey % 31 = 0 THEN 'other' ELSE 'digest' END AS digest", "'digest' AS wanted",
    )
    return files.valid_prefix(rows, "doc", "position", "v2", "wanted").select("doc", "position", "page")


# --- records of any shape -------------------------------------------------------------------------

_LINE = """CASE p_partkey % 12 WHEN 0 THEN 'no json' WHEN 1 THEN '[1, 2]'
  WHEN 2 THEN '{"subject": "' || p_name || '", "object": "x", "relation": "Caused By", "evidence_level": "e1", "evidence_text": "t", "confidence": "0.' || p_size || '"}'
  WHEN 3 THEN '{"head": "a", "relation": "r", "tail": {"deep": 1}, "evidence_level": "E1", "evidence_text": " ", "confidence": 0.5}'
  WHEN 4 THEN '{"head": "a", "relation": "r", "tail": "b", "evidence_level": "E2", "evidence_units": [{"cell": 1}, {"cell": 2}], "confidence": 1, "decision": "ACCEPTED_SILVER"}'
  WHEN 5 THEN '{"head": "a", "relation": "r", "tail": "b", "evidence_level": "E2", "evidence_units": {"cell": ' || p_size || '}, "evidence_text": "both", "confidence": 1.5}'
  WHEN 6 THEN '{"head": " ", "relation": null, "evidence_level": "E9", "decision": "maybe", "confidence": "high"}'
  WHEN 7 THEN '{"head": 12, "relation": "is-part  of", "tail": true, "evidence_level": "E3", "confidence": 0.25, "more": {"list": [1]}}'
  WHEN 8 THEN '{"head": "a", "relation": "r", "tail": "b", "evidence_level": "E1", "evidence_text": "t", "evidence_units": [1], "confidence": 0.5}'
  WHEN 9 THEN '{}' WHEN 10 THEN NULL ELSE '{"head": "a", "relation": "r", "tail": "b", "evidence_level": "E1", "evidence_text": "t", "confidence": 0.' || p_size || '}' END"""
#: A member's text, null unless it is plain and not empty.
_MEMBER = "CASE WHEN json_type(j, '$.{0}') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN nullif(trim(j ->> '$.{0}'), '') END"


@query(f"""WITH l AS (SELECT p_partkey AS id, {_LINE} AS line FROM part), p AS (SELECT id, CASE WHEN json_valid(line) THEN line::json END AS j FROM l),
f AS (SELECT id, j IS NULL OR json_type(j) <> 'OBJECT' AS unread, coalesce({_MEMBER.format('head')}, {_MEMBER.format('subject')}) AS head, coalesce({_MEMBER.format('tail')}, {_MEMBER.format('object')}) AS tail, lower(regexp_replace({_MEMBER.format('relation')}, '[\\s-]+', '_', 'g')) AS relation,
  upper({_MEMBER.format('evidence_level')}) AS evidence_level, coalesce(lower({_MEMBER.format('decision')}), 'candidate_needs_review') AS decision, TRY_CAST(j ->> '$.confidence' AS double) AS confidence, {_MEMBER.format('evidence_text')} AS span,
  CASE json_type(j, '$.evidence_units') WHEN 'ARRAY' THEN json_array_length(j, '$.evidence_units')::int WHEN 'OBJECT' THEN 1 ELSE 0 END AS units FROM p)
SELECT id, head, relation, tail, evidence_level, decision, confidence, units, CASE WHEN unread THEN 'not_an_object' ELSE array_to_string(list_filter([CASE WHEN head IS NULL THEN 'missing_head' END, CASE WHEN relation IS NULL THEN 'missing_relation' END, CASE WHEN tail IS NULL THEN 'missing_tail' END,
  CASE WHEN evidence_level IS NULL THEN 'missing_evidence_level' END, CASE WHEN evidence_level NOT IN ('E1', 'E2', 'E3') THEN 'unknown_evidence_level' END, CASE WHEN decision NOT IN ('silver_candidate', 'accepted_silver', 'candidate_needs_review', 'rejected') THEN 'unknown_decision' END,
  CASE WHEN confidence IS NULL OR confidence NOT BETWEEN 0 AND 1 THEN 'confidence_out_of_range' END, CASE WHEN evidence_level = 'E1' AND span IS NULL THEN 'e1_without_span' END, CASE WHEN evidence_level = 'E1' AND units > 0 THEN 'e1_with_units' END,
  CASE WHEN evidence_level = 'E2' AND units < 2 THEN 'e2_without_units' END, CASE WHEN evidence_level = 'E2' AND span IS NOT NULL THEN 'e2_with_span' END], lambda r: r IS NOT NULL), ',') END AS reasons FROM f""")
def contract_records(spark, sf_dir):
    lines = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{_LINE} AS line")
    return contracts.normalised(lines).select("id", "head", "relation", "tail", "evidence_level", "decision", "confidence", "units", F.array_join("reasons", ",").alias("reasons"))


_PATCH = {
    "patch_id": "p_partkey",
    "evidence_id": "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, CASE WHEN p_partkey % 8 = 0 THEN '-gone' ELSE '' END)",
    "expected_level": "CASE WHEN p_size % 5 = 0 THEN 'E9' ELSE CASE l_returnflag WHEN 'A' THEN 'E1' WHEN 'N' THEN 'E2' ELSE 'E3' END END",
    "new_level": "CASE p_size % 2 WHEN 0 THEN 'E1' ELSE NULL END",
    "expected_status": "CASE WHEN l_linestatus = 'O' THEN 'entailed' ELSE 'undetermined' END",
    "new_status": "concat('repaired ', p_size)",
    "urgency": "p_size % 4",
}
#: Up to three patches name one record: parts are matched with the items of the part of a third of their number.
_PATCHES = f"patches AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _PATCH.items())} FROM part JOIN lineitem ON l_partkey = p_partkey // 3)"


def _patches(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.floor(F.col("p_partkey") / 3).alias("_of"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    return parts.join(items, F.col("_of") == F.col("l_partkey")).selectExpr(*(f"{e} AS {n}" for n, e in _PATCH.items()))


_JUDGED = f"""{ASSERTIONS}, {_PATCHES}, met AS (SELECT p.*, a.evidence_id IS NOT NULL AS there, a.evidence_id IS NOT NULL AND a.level IS NOT DISTINCT FROM expected_level AND a.status IS NOT DISTINCT FROM expected_status AS fits FROM patches p LEFT JOIN assertions a USING (evidence_id)),
told AS (SELECT *, CASE WHEN NOT there THEN 'unmatched' WHEN NOT fits THEN 'refused' WHEN row_number() OVER (PARTITION BY evidence_id, fits ORDER BY urgency DESC, patch_id) > 1 THEN 'superseded' ELSE 'applied' END AS outcome FROM met)"""


def _repaired(spark, sf_dir):
    ordered = _patches(spark, sf_dir).withColumn("_later", -F.col("urgency"))
    return contracts.repaired(assertions(spark, sf_dir).select("evidence_id", "level", "status", "confidence"), ordered, "evidence_id", {"level": "string", "status": "string"}, ("_later", "patch_id"))


@query(f"WITH {_JUDGED} SELECT patch_id, evidence_id, outcome FROM told")
def repair_outcomes(spark, sf_dir):
    return _repaired(spark, sf_dir)[1]


@query(f"WITH {_JUDGED} SELECT a.evidence_id, CASE WHEN w.evidence_id IS NULL THEN a.level ELSE w.new_level END AS level, CASE WHEN w.evidence_id IS NULL THEN a.status ELSE w.new_status END AS status, a.confidence, w.evidence_id IS NOT NULL AS repaired FROM assertions a LEFT JOIN (FROM told WHERE outcome = 'applied') w USING (evidence_id)")
def record_repair(spark, sf_dir):
    return _repaired(spark, sf_dir)[0]


# --- boxes ------------------------------------------------------------------------------------------

_UNIT = {
    "unit_id": "p_partkey",
    "page": "p_partkey % 7",
    "table_id": "concat('T', p_partkey % 3)",
    "group_id": "CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size % 4 END",
    "x0": "CAST(p_partkey % 300 - 5 AS double)",
    "top": "p_partkey % 789 + 0.25D",
    "x1": "CAST(p_partkey % 300 + 90 AS double)",
    "bottom": "p_partkey % 789 + p_size % 60 - 4.5D",
}
_UNITS = f"units AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _UNIT.items())} FROM part), whole AS (SELECT * FROM units WHERE x0 >= 0 AND top >= 0 AND x1 <= 380 AND bottom <= 800 AND x1 > x0 AND bottom > top)".replace("0.25D", "0.25::double").replace("4.5D", "4.5::double")


@query(f"""WITH {_UNITS} SELECT a.page, a.table_id, a.group_id, a.unit_id, b.unit_id AS other_unit_id, round(least(a.bottom, b.bottom) - greatest(a.top, b.top), 6) AS overlap FROM whole a JOIN whole b ON a.page = b.page AND a.table_id = b.table_id AND a.group_id = b.group_id AND a.unit_id < b.unit_id
WHERE least(a.bottom, b.bottom) - greatest(a.top, b.top) > 0""")
def same_row_units(spark, sf_dir):
    units = table(spark, sf_dir, "part").selectExpr(*(f"{e} AS {n}" for n, e in _UNIT.items()))
    return intervals.same_row(units, 380.0, 800.0)
