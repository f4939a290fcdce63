"""Training-data operators do the whole job: cases that a narrower rule would lose."""

from veinworks.llm import neardup, secret_scan


def test_one_of_each_when_the_scan_is_split_anew(spark, tmp_path, monkeypatch):
    texts = [f"w{k} " + " ".join(f"{word}{k}" for word in "a b c d e f g h i j k l m n".split()) for k in range(30)]
    rows = [(i, texts[i % 30], "x") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(8).write.parquet(str(tmp_path / "docs"))
    sketched = neardup.sketched

    def then_split(docs):
        out = sketched(docs)
        out.count()
        out.write.parquet(str(tmp_path / "sketched"))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
        return spark.read.parquet(str(tmp_path / "sketched"))

    monkeypatch.setattr(neardup, "sketched", then_split)
    docs = spark.read.parquet(str(tmp_path / "docs"))
    try:
        kept = neardup.one_of_each(docs)
        got = kept.collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert kept.columns == docs.columns
    assert sorted(r["text"] for r in got) == sorted(texts) and {r["_row"] for r in got} == {"x"}


SECRETS = [
    ('password = "hunter2" x', "hunter2"),
    ("password: s3cr3t!pw#9 end", "s3cr3t!pw#9"),
    ("pwd = 'Tr0ub4dor&3!x' q", "Tr0ub4dor&3!x"),
    ('api_key: "QwertzLkjhgfdsaPoiuzt" y', "QwertzLkjhgfdsaPoiuzt"),
    ('password="correct horse battery staple" z', "correct horse battery staple"),
    ("the TOKEN=abcd1234efgh5678ijkl9012 ok", "abcd1234efgh5678ijkl9012"),
    ("AWS_S3_SECRET=a94a8fe5ccb19ba61c4c0873d391e987982fbbd3 a", "a94a8fe5ccb19ba61c4c0873d391e987982fbbd3"),
]
HARMLESS = ["password: required for all", '"token": "string" a', "token = config.value c", "author: Jane Smith wrote", "see section id=12345678 ok"]


def test_short_lettered_and_unquoted_secrets_are_masked(spark):
    rows = [(i, t) for i, (t, _) in enumerate(SECRETS)] + [(100 + i, t) for i, t in enumerate(HARMLESS)]
    got = {r["doc_id"]: r["text"] for r in secret_scan.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(SECRETS))] == [t.replace(v, "[SECRET]") for t, v in SECRETS]
    assert [got[100 + i] for i in range(len(HARMLESS))] == HARMLESS
