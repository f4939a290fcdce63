"""Competency answers, fault hits and labels on odd rows, by hand."""

from veinworks.operators import competency, gates, mapping


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_answers_with_repeated_missing_and_unreleased_evidence(spark):
    paths = spark.createDataFrame([(1, 0, "p", "c1", 7), (1, 0, "p", "c1", 7), (1, 0, "q", "c2", 7), (1, 0, "p", "c3", 8), (2, 0, "p", "c4", 9)], "fault_id int, role int, path_id string, claim_id string, answer_id int")
    evidence = spark.createDataFrame([("c1", "e1", "d1", "f1", True), ("c1", "e1", "d1", "f1", True), ("c2", "e2", "d1", None, True), ("c3", "e3", "d2", "f2", False), ("c4", "e4", "d2", "f2", None)], "claim_id string, evidence_id string, doc_id string, family_id string, released boolean")
    found = competency.answers(paths, evidence)
    assert rows_of(found, "fault_id", "answer_id", "traceable", "claim_ids", "evidence_ids", "doc_ids", "family_ids", "path_ids") == [
        (1, 7, True, ["c1", "c2"], ["e1", "e2"], ["d1"], ["f1"], ["p", "q"]), (1, 8, False, [], [], [], [], []), (2, 9, False, [], [], [], [], [])
    ]
    tasks = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "fault_id int, role int")
    assert rows_of(competency.outcomes(tasks, found, 2), "fault_id", "semantic_answers", "answers", "reason") == [(1, 2, 1, competency.TOO_FEW), (2, 1, 0, competency.NO_EVIDENCE), (3, 0, 0, competency.NO_PATH)]
    ratios = {r["measure"]: (r["population"], r["satisfied"]) for r in competency.traceability(found, evidence, ("family_id", "doc_id")).collect()}
    assert ratios == {"answers_with_evidence": (3, 1), "evidence_with_provenance": (2, 1), "answers_with_documents": (1, 1)}
    assert competency.traceability(found.limit(0), evidence, ("doc_id",)).where("ratio <> 0").count() == 0


CANDIDATES = "candidate_id long, head string, tail string, evidence string, head_type string, tail_type string, relation string, head_proposed string, head_proposed_status string, tail_proposed string, tail_proposed_status string"


def candidate(i, head, tail, evidence, head_label=None, tail_label=None):
    return (i, head, tail, evidence, "cause", "fault", "causes", head_label, None, tail_label, "human_approved")


def test_aliases_are_bounded_by_words_and_keep_their_places(spark, monkeypatch):
    rows = spark.createDataFrame([candidate(1, "Seal WEAR", "Leak", "İ: the seal wear, leakage and leak."), candidate(2, None, "", None), candidate(3, "sealwear", "x_leak", "Öl-leak")], CANDIDATES)
    aliases = spark.createDataFrame([("F1", "r1", "seal wear"), ("F1", "r1", "seal wear"), ("F2", "r2", " leak "), ("F3", "r3", "leak"), ("F4", "r4", ""), ("F5", "r5", None), ("F6", "r6", "öl")], "fault_id string, rule_id string, alias string")
    for chars in (8_000_000, 5):
        monkeypatch.setattr(mapping, "ALIAS_CHARS", chars)
        hits = mapping.alias_hits(rows, aliases)
        text = {1: "Seal WEAR\nLeak\nİ: the seal wear, leakage and leak.", 3: "sealwear\nx_leak\nÖl-leak"}
        got = rows_of(hits, "candidate_id", "fault_id", "start", "end", "matched")
        assert got == [(1, "F1", 0, 9, "Seal WEAR"), (1, "F2", 10, 14, "Leak"), (1, "F3", 10, 14, "Leak"), (3, "F2", 19, 23, "leak"), (3, "F3", 19, 23, "leak"), (3, "F6", 16, 18, "Öl")]
        assert all(text[c][a:b] == m for c, _, a, b, m in got)
    assert rows_of(mapping.ambiguous(hits), "candidate_id", "fault_ids") == [(1, ["F2", "F3"]), (3, ["F2", "F3"])]
    assert mapping.alias_hits(rows, aliases.limit(0)).count() == 0
    kept = mapping.fault_hits(rows, aliases, [mapping.Pattern("F9", "p", "le(a)k.*", mapping.CLAIM)], [("F2", "leakage")])
    assert rows_of(kept, "candidate_id", "fault_id", "start", "scope") == [(1, "F1", 0, mapping.WHOLE), (1, "F3", 10, mapping.WHOLE), (1, "F9", 10, mapping.CLAIM), (3, "F2", 19, mapping.WHOLE), (3, "F3", 19, mapping.WHOLE), (3, "F6", 16, mapping.WHOLE), (3, "F9", 11, mapping.CLAIM)]


def test_the_dictionary_comes_before_the_surface_and_the_proposal(spark):
    rows = spark.createDataFrame([candidate(1, " Gear ", "环 ring", None, "错", None), candidate(2, "环", "rod", None, None, "杆 rod"), candidate(3, "bolt", "", None, "bolt", " ")], CANDIDATES)
    terms = spark.createDataFrame([("cause", "gear", "T2", "齿轮 gear", "human_approved"), ("cause", "GEAR", "T1", "齿 gear", None), ("fault", "bolt", "T3", "螺栓", "human_approved")], "type string, surface string, term_id string, label string, status string")
    told = mapping.described(rows, mapping.alias_hits(rows, spark.createDataFrame([], "fault_id string, rule_id string, alias string")), terms, ("human_approved", "dictionary_approved", "source_zh_exact"), {"causes": "导致"}, "gear|rod")
    got = {r["candidate_id"]: r for r in told.collect()}
    assert (got[1]["head_label"], got[1]["head_term"], got[1]["head_method"], got[1]["tail_label"], got[1]["tail_method"]) == ("齿 gear", "T1", "type_scoped_dictionary", "环 ring", "source_zh_exact")
    assert got[1]["ready"] and got[1]["label_reasons"] == [mapping.OVERRIDDEN] and got[1]["fault_ids"] == []
    assert got[2]["ready"] and got[2]["tail_method"] == "proposed:human_approved" and got[2]["tail_term"].startswith("TERM-")
    assert not got[3]["ready"] and got[3]["label_reasons"] == [mapping.NO_HAN, mapping.STATUS, mapping.MISSING]
    assert len({r["claim_id"] for r in got.values()}) == 3


def test_all_release_reasons(spark):
    schema = "decision string, split string, doc_id string, level string, inferred boolean, claim_id string, family_id string, relation_type_valid boolean, status string, evidence_valid boolean, evidence_silver boolean, entailment_silver boolean, q double"
    good = ("accepted_silver", "build_train", "d1", "E1", None, "c", "f", True, "entailed", True, True, True, 0.8)
    rows = spark.createDataFrame([good, (None,) * 13, ("rejected", "development", "d9", "E3", True, " ", "", False, "undetermined", False, False, False, 0.79)], schema)
    got = [r["reasons"] for r in gates.release_reasons(rows, spark.createDataFrame([("d1",), ("d1",), (None,)], "doc_id string"), 0.8).collect()]
    every = list(gates.RELEASE_REASONS)
    assert sorted(got) == sorted([[], [r for r in every if r != "missing_doc_id"], [r for r in every if r != "inferred_edge"]])


def test_rules_that_share_aliases_are_found_as_one_and_listed_each(spark, monkeypatch):
    monkeypatch.setattr(mapping, "HITS", 3)
    rows = spark.createDataFrame([candidate(i, "seal", "leak", "seal leak") for i in range(20)], CANDIDATES)
    many = [(f"F{j % 2}", f"r{j}", "seal") for j in range(400)] + [("F0", "two", "leak"), ("F0", "two", "seal"), ("F1", "two", "leak")]
    aliases = spark.createDataFrame(many, "fault_id string, rule_id string, alias string")
    [(found, members)] = mapping._group_hits(rows, aliases)
    assert (found.count(), members.count()) == (20 * 4, 402)
    places = sorted((f, r, 0, 4) for f, r, a in many if a == "seal") + [("F1", "two", 5, 9)]
    got = mapping.fault_hits(rows, aliases, [], [("F9", "leak")])
    assert rows_of(got.where("candidate_id = 7"), "fault_id", "rule_id", "start", "end") == sorted(places, key=str)
    assert got.count() == 20 * 402
    few = mapping.fault_hits(rows, aliases, [], [("F0", "leak")], by_rule=False)
    assert few.count() == 20 * 2 and "rule_id" not in few.columns
    assert rows_of(mapping.fault_classes(few).where("candidate_id = 7"), "fault_ids") == [(["F1"],)]
