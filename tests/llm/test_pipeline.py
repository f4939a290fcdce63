"""Each stage of the pipeline against brute force over what the stage before it kept."""

import re

import duckdb
import pytest
from test_llm_operators import classes, similarity, weights, word_list

import corpus_pipeline
from veinworks.llm import tokens
from veinworks.llm.queries import ORACLES, QUERIES, tokenizer_file

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows that go into and come out of each stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.collect())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        out.append(docs.collect())
    return out


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    for rows in steps[:5]:
        assert set(rows[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_quality_rejects_labelled_junk_and_keeps_the_rest(steps):
    labels = {r[0]: r[1] for r in duckdb.execute(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall()}
    kept = {r["doc_id"] for r in steps[1]}
    wrong = [d for d, q in labels.items() if (d in kept) != (q == 1)]
    assert len(wrong) <= 0.03 * len(labels)


def test_one_document_of_each_class_stays(steps):
    texts = [r["text"] for r in steps[1] if len(r["text"]) < 4000]
    own = classes(texts)
    kept = [r["text"] for r in steps[2] if len(r["text"]) < 4000]
    assert len(kept) == len(set(own))
    assert {own[texts.index(t)] for t in kept} == set(own)


def test_no_benchmark_item_stays(steps):
    items = [word_list(r[0]) for r in duckdb.execute(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    held = lambda text: any(" " + " ".join(i) + " " in " " + " ".join(word_list(text)) + " " for i in items)
    kept = {r["doc_id"] for r in steps[3]}
    for r in steps[2]:
        assert (r["doc_id"] in kept) != held(r["text"])


def test_secrets_are_masked_in_place(steps):
    before, after = ({r["doc_id"]: r["text"] for r in steps[k]} for k in (3, 4))
    assert set(before) == set(after)
    for d in before:
        assert after[d] == re.sub(r'(token = ")[0-9a-f]{40}(")', r"\1[SECRET]\2", before[d], flags=re.I)


def test_packing_holds_all_tokens(steps):
    whole = tokens.Encoder(tokenizer_file()).whole
    want = {r["doc_id"]: len(whole.encode(r["text"], add_special_tokens=False).ids) + 1 for r in steps[4]}
    got = {}
    for r in steps[5]:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_run_gives_the_last_stage(spark, steps):
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in steps[5])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(cur.fetchall())


def test_similarity_of_equal_texts_is_one():
    assert abs(similarity(weights("a b c d e f g"), weights("A b, c d e f g")) - 1) < 1e-12
