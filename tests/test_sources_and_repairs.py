"""Sources, resumed runs, streams, contracts, repairs and boxes: small cases by hand."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from veinworks.operators import contracts, intervals
from veinworks.sources import files, keyed
from veinworks.streaming import ingest


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


PAGES = "doc_id string, page int, text string, _file string, _position long"


@pytest.fixture
def folder(tmp_path):
    for d in range(6):
        lines = [json.dumps({"doc_id": f"D{d}", "page": p, "text": f"text {d} {p}", "more": [1]}) for p in range(4)]
        (tmp_path / f"D{d}.pages.v2.jsonl").write_text("\n".join([lines[0], "", *lines[1:]]) + "\n")
    (tmp_path / "_half.jsonl").write_text("{")
    (tmp_path / "notes.txt").write_text("x")
    return str(tmp_path)


def test_keys_are_pushed_to_files_and_lines(spark, folder):
    pages = keyed.read_keyed(spark, folder, PAGES, "doc_id", ("page",))
    assert pages.count() == 24 and pages.rdd.getNumPartitions() == 6
    two = pages.where("doc_id in ('D1', 'D4') and page = 2 and text like 'text%'")
    assert two.rdd.getNumPartitions() == 2
    assert rows_of(two, "doc_id", "page", "_file", "_position") == [("D1", 2, "D1.pages.v2.jsonl", 3), ("D4", 2, "D4.pages.v2.jsonl", 3)]
    none = pages.where("doc_id = 'D1' and doc_id = 'D2'")
    assert none.count() == 0
    assert rows_of(files.lookup(pages, spark.createDataFrame([("D1", 1), ("D9", 1), ("D1", 1)], "doc_id string, page int"), ["doc_id", "page"]), "doc_id", "page") == [("D1", 1)]


def test_malformed_lines(spark, tmp_path):
    (tmp_path / "D1.jsonl").write_text('{"doc_id": "D1", "page": 1}\n[1]\nno json\n')
    assert keyed.read_keyed(spark, str(tmp_path), PAGES, "doc_id", strict=False).count() == 1
    with pytest.raises(Exception, match="line 2"):
        keyed.read_keyed(spark, str(tmp_path), PAGES, "doc_id").collect()


def test_written_folder_has_a_manifest_that_holds(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(i, f"é{i}", [i, i + 1]) for i in range(50)], "id long, name string, list array<long>").repartition(3)
    for overwrite in (False, True):
        keyed.write_keyed(rows, path, "bench", overwrite)
        told = json.loads((tmp_path / "out" / "manifest.json").read_text())
        assert told["rows"] == 50 and told["label"] == "bench" and sum(f["rows"] for f in told["files"]) == 50
        for f in told["files"]:
            raw = (tmp_path / "out" / f["name"]).read_bytes()
            assert len(raw) == f["bytes"] and hashlib.sha256(raw).hexdigest() == f["sha256"]
        assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == sorted([f["name"] for f in told["files"]] + ["manifest.json"])
    assert rows_of(keyed.read_keyed(spark, path, "id long, name string, list array<long>"), "id", "name", "list") == rows_of(rows, "id", "name", "list")
    manifest = spark.createDataFrame([(f["name"], f["bytes"], f["sha256"]) for f in told["files"]] + [("gone.jsonl", 1, "x"), (told["files"][0]["name"], 1, "x")], "name string, bytes long, sha256 string")
    assert rows_of(files.integrity(spark, path, manifest), "name", "problems") == sorted([("gone.jsonl", ["missing"]), (told["files"][0]["name"], ["bytes", "sha256"])], key=str)


def test_first_released_record_of_each_id(spark):
    rows = [("e1", "silver_candidate", True, False, "b", 1), ("e1", "accepted_silver", True, None, "a", 9), ("e1", "rejected", True, False, "a", 1), ("", "silver_candidate", True, False, "a", 2), (None, "silver_candidate", True, False, "a", 3), ("e2", "silver_candidate", None, False, "a", 4), ("e3", "silver_candidate", True, True, "a", 5)]
    df = spark.createDataFrame(rows, "evidence_id string, decision string, eligible boolean, inferred boolean, _file string, _position long")
    assert rows_of(files.released(df), "evidence_id", "_file", "_position") == [("e1", "a", 9)]


def test_document_tables(spark, tmp_path):
    (tmp_path / "doc.json").write_text(json.dumps({"faults": [{"id": "F1", "n": 2, "terms": ["a"], "extra": {}}, {"id": "F2"}], "roles": {"cause": {"path": "p"}, "sign": {"path": "q"}}}, indent=1))
    path = str(tmp_path / "doc.json")
    assert rows_of(files.document_table(spark, path, "$.faults", "id string, n int, terms array<string>"), "id", "n", "terms") == [("F1", 2, ["a"]), ("F2", None, None)]
    assert rows_of(files.document_table(spark, path, "$.roles", "path string"), "key", "path") == [("cause", "p"), ("sign", "q")]
    assert files.document_table(spark, path, "$.gone", "path string").count() == 0


def test_resume_by_valid_prefix(spark):
    line = lambda doc, at, page, readable=True, version="v2", digest="d": (doc, at, page, readable, version, digest, "d")
    rows = [line("whole", 0, 1), line("whole", 1, 2), line("broken", 0, 1), line("broken", 1, 2, False), line("broken", 2, 3), line("old", 0, 1), line("old", 1, 2, version="v1"), line("changed", 0, 1, digest="x"), line("twice", 0, 1), line("twice", 1, 1), line("late", 0, 1), line("late", 1, 2, False), line("late", 2, 1, version="v1"), line("first", 0, 1, False), line("none", 0, 1, version=None)]
    df = spark.createDataFrame(rows, "doc string, position int, page int, readable boolean, version string, digest string, wanted string")
    assert rows_of(files.valid_prefix(df, "doc", "position", "v2", "wanted"), "doc", "position") == [("broken", 0), ("late", 0), ("whole", 0), ("whole", 1)]
    done = files.valid_prefix(df, "doc", "position", "v2", "wanted")
    todo = spark.createDataFrame([("whole", 1), ("whole", 2), ("broken", 2), ("new", 1)], "doc string, page int")
    assert rows_of(files.still_to_do(todo, done, ["doc", "page"]), "doc", "page") == [("broken", 2), ("new", 1)]
    runs = spark.createDataFrame([("a", "f", 1, "x"), ("a", "f", 2, "y"), ("a", "g", 3, "z"), ("b", "g", 1, "z")], "key string, fingerprint string, position int, response string")
    assert rows_of(files.last_of_run(runs, "f", ["key"]), "key", "response") == [("a", "y")]


def test_a_stream_killed_and_run_again_leaves_the_rows_of_one_run(spark, tmp_path):
    schema = "id long, latency double, ts timestamp"
    for k in range(4):
        spark.range(k * 10, k * 10 + 10).selectExpr("id", "CAST(id AS double) AS latency", "timestamp_seconds(id * 600) AS ts").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    put, failed = ingest.batch_sink(str(tmp_path / "out")), []

    def fails_once(rows, batch_id):
        put(rows, batch_id)
        if batch_id == 2 and not failed:
            failed.append(batch_id)
            raise RuntimeError("killed after the write, before the commit")

    run = lambda f: source().writeStream.foreachBatch(f).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed"):
        run(fails_once).awaitTermination()
    run(fails_once).awaitTermination()
    assert failed == [2]
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(40))


def streamed(spark, df, tmp_path, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_windowed_latency_and_accepted_records(spark, tmp_path):
    spark.createDataFrame([("a", 10.0, 0), ("a", 20.0, 100), ("b", 5.0, 3700), ("b", 7.0, 90000)], "method string, latency double, s long").selectExpr("method", "latency", "timestamp_seconds(s) AS ts").write.parquet(str(tmp_path / "runs"))
    runs = spark.readStream.schema("method string, latency double, ts timestamp").parquet(str(tmp_path / "runs"))
    got = streamed(spark, ingest.windowed_latency(runs), tmp_path, "latency", "complete")
    assert rows_of(got, "method", "runs", "mean") == [("a", 2, 15.0), ("b", 1, 5.0), ("b", 1, 7.0)]
    spark.createDataFrame([("k1", [], 0), ("k1", [], 5), ("k2", ["held_out"], 5), ("k3", [], 9)], "key string, reasons array<string>, s long").selectExpr("key", "reasons", "timestamp_seconds(s) AS ts").write.parquet(str(tmp_path / "records"))
    records = spark.readStream.schema("key string, reasons array<string>, ts timestamp").parquet(str(tmp_path / "records"))
    assert rows_of(streamed(spark, ingest.accepted(records, "key", "ts", "1 minute"), tmp_path, "accepted"), "key") == [("k1",), ("k3",)]


def test_interval_joins_against_all_pairs(spark):
    r = random.Random(3)
    make = lambda n: [(k, r.choice(["x", "y"]), float(a := r.randrange(-50, 300)), a + r.choice([0.0, 0.5, 7.0, 120.0, -3.0])) for k in range(n)]
    a, b = make(80), make(90)
    schema = "id long, key string, start double, end double"
    for width in (1.0, 10.0, 1000.0):
        got = rows_of(intervals.overlapping(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["key"], width), "id", "other_id")
        assert got == sorted(((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]), key=str)


def test_records_of_odd_shapes(spark):
    lines = [(1, None), (2, ""), (3, '{"head": ["a"], "relation": "R r", "tail": "b", "evidence_level": "E1", "evidence_text": "t", "confidence": 0}'), (4, '"text"'), (5, '{"head": "a", "relation": "r", "tail": "b", "evidence_level": "e2", "evidence_units": [1, 2], "confidence": "1.0"}')]
    got = {r["id"]: r for r in contracts.normalised(spark.createDataFrame(lines, "id long, line string")).collect()}
    assert [got[k]["reasons"] for k in range(1, 6)] == [["not_an_object"], ["not_an_object"], ["missing_head"], ["not_an_object"], []]
    assert got[3]["relation"] == "r_r" and got[5]["evidence_level"] == "E2" and got[5]["units"] == 2 and got[5]["confidence"] == 1.0


def test_repairs_compare_before_they_set(spark):
    records = spark.createDataFrame([("r1", "E1", 0.5), ("r2", None, 0.6), ("r3", "E3", None)], "record_id string, level string, confidence double")
    patches = [(1, "r1", "E1", "E2", "0.5", "0.9"), (2, "r1", "E1", "E9", "0.5", "0.1"), (3, "r2", None, "E1", "0.6", None), (4, "r3", "E3", "E1", "0.1", "0.2"), (5, "gone", "E1", "E2", "1", "1")]
    df = spark.createDataFrame(patches, "patch_id long, record_id string, expected_level string, new_level string, expected_confidence string, new_confidence string")
    fields = {"level": "string", "confidence": "double"}
    after, told = contracts.repaired(records, df, "record_id", fields)
    assert rows_of(told, "patch_id", "outcome") == [(1, "applied"), (2, "superseded"), (3, "applied"), (4, "refused"), (5, "unmatched")]
    want = [("r1", "E2", 0.9, True), ("r2", "E1", None, True), ("r3", "E3", None, False)]
    assert rows_of(after, "record_id", "level", "confidence", "repaired") == want
    again, told = contracts.repaired(after.drop("repaired"), df, "record_id", fields)
    assert rows_of(again, "record_id", "level", "confidence") == [x[:3] for x in want]
    assert "applied" not in {r["outcome"] for r in told.collect()}
