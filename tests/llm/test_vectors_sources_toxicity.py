"""Vector codes, the source divergence audit and toxicity: against brute force and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from veinworks.llm import divergence, toxicity, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, vector string, error string, _label int, cell int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", "x", 3, 1) for i, v, y in rows], VECTORS)


def coded_by_hand(rows, width):
    """Whole distances between all runs and entries, in Python's integers."""
    kept = [(i, [math.floor(1024 * np.float32(c).item()) for c in v] + [0] * (4 * width - len(v)), y) for i, v, y in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    runs = [[r[1][p * width : (p + 1) * width] for r in kept] for p in range(4)]
    books = [x[: vector_codes.ENTRIES] for x in runs]

    def near(run, book):
        return min((sum((a - b) ** 2 for a, b in zip(run, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(4):
        for p in range(4):
            of = [near(run, books[p])[1] for run in runs[p]]
            new = []
            for k, entry in enumerate(books[p]):
                own = [run for run, o in zip(runs[p], of, strict=True) if o == k]
                new.append([sum(c) // len(own) for c in zip(*own, strict=True)] if own else entry)
            books[p] = new
    found = [[near(runs[p][r], books[p]) for p in range(4)] for r in range(len(kept))]
    by_label = Counter()
    for r, f in zip(kept, found, strict=True):
        by_label[r[2]] += sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), by_label[r[2]], sha) for r, f in zip(kept, found, strict=True)), key=str)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


CODES = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


def test_vector_codes_equal_whole_distances(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "ENTRIES", 16)
    monkeypatch.setattr(vector_codes, "BLOCK", 7)
    r = random.Random(3)
    rows = [(r.randrange(10**6), [r.choice([-1, 1]) * r.random() for _ in range(12)], r.choice([1, 2, None])) for _ in range(150)]
    rows += [(10**7 + k, [round(r.random() * 2) / 8 - 0.1 for _ in range(12)], 2) for k in range(60)]  # many ties
    rows += [(5, rows[0][1], 1)] * 3 + [(6, None, 1), (7, [0.5] * 11 + [None], 1), (8, [float("nan")] + [0.1] * 11, 2), (9, [float("-inf")] * 12, 2), (None, [0.25] * 12, None)]
    assert rows_of(vector_codes.vector_codes(vectors(spark, rows)), *CODES) == coded_by_hand(rows, 3)


def test_vector_codes_of_few_short_and_no_rows(spark):
    rows = [(4, [0.5, -0.5, 0.25, 0.1, 0.7], 1), (2, [0.5], None), (9, [], None)]
    assert rows_of(vector_codes.vector_codes(vectors(spark, rows)), *CODES) == coded_by_hand(rows, 2)
    assert vector_codes.vector_codes(vectors(spark, [(1, None, 1)])).count() == 0
    assert vector_codes.vector_codes(vectors(spark, [])).columns == list(CODES)


def test_nearest_entry_and_ties():
    r = np.random.default_rng(1)
    for spread in (3, 2000):
        x, book = r.integers(-spread, spread, (500, 16)), r.integers(-spread, spread, (256, 16))
        book[100] = book[40]
        code, distance = vector_codes.nearest(x, book)
        full = ((x[:, None, :] - book[None]) ** 2).sum(2)
        assert (code == full.argmin(1)).all() and (distance == full.min(1)).all()
    big = np.full((1, 16), vector_codes.LIMIT)
    assert vector_codes.nearest(big, -big)[1][0] == 16 * (2 * vector_codes.LIMIT) ** 2


def audited_by_hand(rows):
    lower = str.maketrans(divergence._CAPITALS, divergence._SMALL)
    n, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", (text or "").translate(lower))
        n[lang or "", source or ""].update(found)
        df[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in n}:
        kept = sorted(t for t, k in df[lang].items() if k >= 10)
        sources = sorted(s for x, s in n if x == lang)
        whole = {t: sum(n[lang, s][t] for s in sources) for t in kept}

        def share(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: share(n[lang, s]) for s in sources}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [("pair", o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [("term", t, f(p[s][t], q[t])) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for found, most in ((pairs, None), (terms, 10)):
                found.sort(key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (part, item, value) in enumerate(found[:most], 1)]
    return sorted(out, key=str)


def test_divergence_equals_plain_code(spark):
    r = random.Random(7)
    names = ["the", "The", "THE", "çà", "Çà", "straße", "x", "İ", "K", "日本", "a", "b", "cc", "dd"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(" ".join(r.choice(names[k % 5 :]) for _ in range(r.randrange(30))) + r.choice(["", ".", "\x00é", "|x~y"]), r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", "ä", None, "S1"])) for k in range(300)]
    rows += [(None, "en", "empty"), ("", "fr", "only"), ("", "fr", "other"), ("word " * 5000, "en", "s1"), ("the the", "xx", "single")] + [("the same text", "en", "copies")] * 40
    docs = spark.createDataFrame([(*x, 1, "t", 2) for x in rows], "text string, lang string, source string, n int, term string, kind int")
    got = rows_of(divergence.divergence_audit(docs), "lang", "source", "part", "item", "value", "rank")
    assert got == audited_by_hand(rows)
    assert divergence.divergence_audit(docs.limit(0)).count() == 0


def test_proportions_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(10**13, 3 * 10**15, 7 * 10**6)], "a long, b long, c long").select(divergence.proportion(F.col("a"), F.col("b"), F.col("c"))).first()
    assert row[0] == 1 + 10**9 * (10**13 + 2) // (3 * 10**15 + 14 * 10**6)


# --- toxicity -----------------------------------------------------------------

RNG = random.Random(11)
CALM = [a + b for a in "ba do fi ku lo mi na pe ra su".split() for b in "ten ral mos vik dun".split()]


def sentence(toxic=False, n=8):
    found = [RNG.choice(CALM) for _ in range(n)]
    if toxic:
        found[RNG.randrange(n)] = "Grump" + RNG.choice(["y", "ish", "let", "ed"])
    return " ".join(found)


def labelled_rows(n=900):
    rows = []
    for i in range(n):
        toxic = i % 5 == 0
        k = RNG.randrange(1, 12)
        at = RNG.randrange(k)
        rows.append((i, ". ".join(sentence(toxic and j == at) for j in range(k)) + ".", int(toxic), at if toxic else None))
    return rows


@pytest.fixture(scope="module")
def learnt(spark):
    rows = labelled_rows()
    docs = spark.createDataFrame([(i, t, 9.0, 9) for i, t, _, _ in rows], "doc_id long, text string, score double, label int")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y, _ in rows] + [(1, None, 1), (3, 7, 1), (99999, 1, 1)], "doc_id long, toxic int, quality int")
    return rows, docs, labels, toxicity.fit(toxicity.labelled(docs, labels))


def test_toxic_documents_and_their_sentences(learnt):
    rows, docs, _, model = learnt
    truth = {i: (t, y, at) for i, t, y, at in rows}
    right = placed = 0
    for r in toxicity.scored(docs, model).collect():
        text, y, at = truth[r["doc_id"]]
        right += r["predicted"] == y
        assert r["predicted"] == int(r["score"] >= toxicity.TOXIC)
        if y and r["predicted"]:
            assert [text[s["start"] : s["end"]].strip(" .") for s in r["offending"]] == [text.split(".")[at].strip()]
            placed += 1
    assert right >= 0.98 * len(rows) and placed >= 0.95 * sum(y for _, _, y, _ in rows)


def test_held_out_accuracy(spark, learnt):
    rows, docs, labels, _ = learnt
    truth = {i: y for i, _, y, _ in rows}
    got = [r for r in toxicity.toxicity_scores(docs, labels).collect() if r["held_out"]]
    toxic = [r for r in got if truth[r["doc_id"]]]
    assert len(got) > 200 and sum(r["predicted"] for r in toxic) >= 0.95 * len(toxic)
    assert sum(r["predicted"] for r in got if not truth[r["doc_id"]]) == 0


def test_held_out_labels_change_no_score(spark, learnt):
    _, docs, labels, _ = learnt
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    few = docs.limit(40)
    scores = [{r["doc_id"]: r["score"] for r in toxicity.scored(few, toxicity.fit(toxicity.labelled(docs, x))).collect()} for x in (labels, turned)]
    assert scores[0].keys() == scores[1].keys() and all(math.isclose(scores[0][k], scores[1][k], abs_tol=1e-9) for k in scores[0])


def test_noisy_or_gradient_against_differences():
    r = np.random.default_rng(2)
    sizes, cues = [[2, 1], [], [3], [1, 1]], [[0, 1, 2], [], [0, 2, 3], [3, 1]]
    batch = pa.RecordBatch.from_pydict({"label": pa.array([1, 1, 0, 1], pa.int32()), "sizes": pa.array(sizes, pa.list_(pa.int32())), "cues": pa.array(cues, pa.list_(pa.int32()))})
    model = toxicity.Noisy(0.1, -0.7, np.arange(4, dtype=np.uint64), r.normal(size=4))

    def likely(bias, weights):
        total = 0.0
        for y, size, cue in zip([1, 1, 0, 1], sizes, cues, strict=True):
            none, at = 0.9, 0
            for k in size:
                none *= 1 - 1 / (1 + math.exp(-bias - sum(weights[c] for c in cue[at : at + k])))
                at += k
            total += math.log(1 - none if y else none)
        return total

    got = toxicity.expectations(batch, model)
    assert math.isclose(got[0, -1], likely(model.bias, model.weights), rel_tol=1e-9)
    e = 1e-6
    assert math.isclose(got[0, 0], (likely(model.bias + e, model.weights) - likely(model.bias - e, model.weights)) / (2 * e), rel_tol=1e-5)
    for c in range(4):
        d = e * (np.arange(4) == c)
        assert math.isclose(got[0, 1 + c], (likely(model.bias, model.weights + d) - likely(model.bias, model.weights - d)) / (2 * e), rel_tol=1e-5, abs_tol=1e-8)


def test_words_and_sentences_by_plain_code():
    texts = ["Ärger ÉTÉ über. Grumpy-x? ×÷ ß\nLast", "", None, "!!!", "abc abcd abcdefgh", "x" * 5000 + ". y"]
    w = toxicity.words(pa.array(texts))
    plain = lambda t: [m.group() for m in re.finditer(r"(?:[a-z0-9]|[^\x00-\x7f])+", "".join(c.lower() if c in divergence._CAPITALS or "À" <= c <= "Þ" and c != "×" else c for c in t or ""))]
    found = [x for t in texts for x in plain(t)]
    assert len(w.first) == len(found) and w.row.tolist() == [i for i, t in enumerate(texts) for _ in plain(t)]
    # a feature stands for the same bytes everywhere, and different bytes differ
    names = {}
    for word, hashes in zip(found, w.features, strict=True):
        raw = word.encode()
        for h, name in zip(hashes.tolist(), [raw, *(b"^" + raw[:k] if len(raw) > k else raw for k in toxicity.PREFIXES)], strict=True):
            assert names.setdefault(h, name) == name
    assert len(set(names.values())) == len(names)
    number = w.sentence(np.arange(len(w.first)))
    start, end = toxicity._spans(w, number, w.row)
    said = [texts[r][a:b].strip() for r, a, b in zip(w.row, start, end, strict=True)]
    assert said[:3] == ["Ärger ÉTÉ über."] * 3 and said[3:5] == ["Grumpy-x?"] * 2 and said[-1] == "y" and "Last" in said


def test_toxicity_on_odd_rows(spark, learnt):
    _, docs, labels, model = learnt
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "Grumpy. Grumpy!"), (3, "Grumpy " * 20000), (4, "plain"), (4, "plain")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), round(r["score"], 9), len(r["offending"])) for r in toxicity.scored(odd, model).collect())
    by = {k: [x[1:] for x in got if x[0] == k] for k in "1 2 3 4 None".split()}
    assert by["1"] == by["2"] == [(round(model.leak, 9), 0)] and by["4"] == by["4"][:1] * 2
    assert by["None"][0][1] == 2 and by["3"][0][0] > 0.7
    assert toxicity.toxicity_scores(odd.limit(0), labels).count() == 0
    none = toxicity.toxicity_scores(odd, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and len(none) == 6 and {r["predicted"] for r in none} == {0}
    clean = toxicity.toxicity_scores(docs.limit(5), labels.where("toxic = 0")).collect()
    assert {r["score"] for r in clean} == {0.0}
