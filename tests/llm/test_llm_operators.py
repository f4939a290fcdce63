"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; and against brute force."""

import hashlib
import math
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veinworks.llm import chat, decontam, media, neardup, packing, pii, quality, secret_scan, sharding, shingles, token_files, tokens
from veinworks.llm.queries import CONTROL_TEXT, tokenizer_file

DOCS = "doc_id long, text string, source string, n_chars long, node long, start long, row long, label int, _row long, features array<double>"
RNG = random.Random(5)
WORDS = ["w" + str(i) for i in range(400)]


def prose(n, seed=None):
    r = random.Random(seed) if seed is not None else RNG
    return " ".join(r.choice(WORDS) for _ in range(n))


LONG = prose(60_000, 1)
TEXTS = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "One, two!"), (6, prose(50, 2)), (6, prose(50, 2)), (None, prose(50, 3)), (None, None), (9, LONG), (10, "x" * 50_000), (11, "é" * 300 + " ß ſ 日本"), (12, prose(50, 2) + " end")]


def docs(spark, rows=TEXTS):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "src", len(t or ""), 7, 7, 7, 1, 7, [0.0]) for i, t in rows], DOCS)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# --- tokens and token files -------------------------------------------------

HARD = ["", "Don't SHOULDN'T 'S", "naïve É É <|endoftext|>x", "a\x1cb\x85c\xa0d", "İstanbul ΣΑΣ", "½ ² x 12a34", "</w> a</w>b", "日本語 🙂", "x" * 3000, " ́a é", "tab\tnew\nline\x0b\x0c"]


def test_encoder_equals_the_library():
    e = tokens.Encoder(tokenizer_file())
    texts = HARD + [t or "" for _, t in TEXTS]
    ids, at = e.encode(pa.array(texts))
    assert e.by_word
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == e.whole.encode(t, add_special_tokens=False).ids


def test_encoder_forgets_words_without_harm(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY_WORDS", 3)
    e = tokens.Encoder(tokenizer_file())
    for _ in range(3):
        ids, _ = e.encode(pa.array(["alpha beta gamma delta", "beta epsilon"]))
        assert ids.tolist() == e.whole.encode("alpha beta gamma delta", add_special_tokens=False).ids + e.whole.encode("beta epsilon", add_special_tokens=False).ids


def test_token_files_round_trip(spark):
    whole = tokens.Encoder(tokenizer_file()).whole
    written = token_files.write_token_files(docs(spark), tokenizer_file(), 1)
    got = token_files.read_token_files(spark, written, with_ids=True).collect()
    assert len(got) == len(TEXTS)
    ordered = sorted(got, key=lambda r: r["start"])
    start = 0
    for r in ordered:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 1
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    assert [r["doc_id"] for r in ordered] == [None, None, *sorted(i for i, _ in TEXTS if i is not None)]
    want = sorted((str(i), whole.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in TEXTS)
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in got) == want
    assert token_files.token_files(docs(spark, []), tokenizer_file()).count() == 0


# --- packing ----------------------------------------------------------------


def test_packing_places_every_id_once(spark):
    pieces = packing.pack_documents(docs(spark), tokenizer_file()).collect()
    whole = tokens.Encoder(tokenizer_file()).whole
    by_doc = {}
    for p in pieces:
        by_doc.setdefault((str(p["doc_id"]), p["doc_tokens"]), []).append(p)
    want = sorted((str(i), len(whole.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in TEXTS)
    copies = {k: want.count(k) for k in want}
    assert set(by_doc) == set(copies)
    for (_, n), own in by_doc.items():
        spans = sorted((p["start"], p["length"]) for p in own)
        assert sum(x for _, x in spans) == n * copies[(str(own[0]["doc_id"]), n)]
    long_ids = np.array(whole.encode(LONG, add_special_tokens=False).ids + [2], "<u4")
    for p in by_doc[("9", len(long_ids))]:
        assert p["ids_crc32"] == zlib.crc32(long_ids[p["start"] : p["start"] + p["length"]].tobytes())
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert packing.pack_documents(docs(spark, []), tokenizer_file()).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 300])
def test_differencing_is_balanced_and_keeps_capacity(n):
    sizes = np.random.default_rng(n).integers(1, 4096, n)
    found = packing.windows_of(sizes, 4096)
    loads = np.bincount(found, sizes)
    assert loads.max() <= 4096 and len(found) == n
    small = np.random.default_rng(n).integers(1, 300, 50 * n)
    loads = np.bincount(packing.differenced(small, 10), small, 10)
    assert loads.max() - loads.min() <= 300
    assert packing.windows_of(np.full(6, 4096), 4096).tolist() != [0] * 6


# --- sharding ---------------------------------------------------------------


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_follow_the_published_walk(spark):
    keys = spark.range(3000).select(sharding.jump_shards(sharding.stable_key(F.col("id")), 24, 25).alias("s"), "id").collect()
    for r in keys:
        k = int(hashlib.md5(str(r["id"]).encode()).hexdigest()[:15], 16)
        assert (r["s"]["s24"], r["s"]["s25"]) == (jump(k, 24), jump(k, 25))
        assert r["s"]["s24"] == r["s"]["s25"] or r["s"]["s25"] == 24


def test_slots_are_gapless(spark):
    got = sharding.shard_slots(docs(spark), 5).collect()
    assert len(got) == len(TEXTS)
    for s in {r["shard"] for r in got}:
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.shard_slots(docs(spark, []), 5).count() == 0


# --- media ------------------------------------------------------------------


@pytest.mark.parametrize("kind", range(5))
def test_png_filters_round_trip(kind):
    pixels = np.random.default_rng(kind).integers(0, 256, (9, 64)).astype(np.uint8)
    assert (media.decode_png(media.encode_png(pixels, kind)) == pixels).all()
    assert (media.decode_png(media.encode_png(pixels, np.arange(9) % 5)) == pixels).all()


def test_png_damage_is_found():
    image = media.encode_png(np.zeros((2, 64), np.uint8))
    for at in (0, 20, 45, len(image) - 2):
        with pytest.raises(media.MediaError):
            media.decode_png(image[:at] + bytes([image[at] ^ 1]) + image[at + 1 :])
    with pytest.raises(media.MediaError):
        media.decode_png(image[:-4])


def test_media_column(spark):
    got = media.media_column(docs(spark)).collect()
    assert len(got) == len(TEXTS)
    want = sorted((str(i), len((t or "").encode()), hashlib.sha256(media.payload(t)[0]).hexdigest(), zlib.crc32(media.payload(t)[0][-64:])) for i, t in TEXTS)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    assert all(r["payload_bytes"] % 64 == 0 and r["payload_bytes"] >= 64 for r in got)
    same = [r for r in got if r["doc_id"] == 6]
    assert same[0]["feature"] == same[1]["feature"] and same[0]["media_sha256"] == same[1]["media_sha256"]
    assert media.media_column(docs(spark, [])).count() == 0


# --- near duplicates --------------------------------------------------------


def word_list(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def weights(text):
    w = word_list(text)
    found = {}
    for k in range(len(w) - 4 if len(w) >= 5 else min(len(w), 1)):
        s = tuple(w[k : k + 5])
        found[s] = found.get(s, 0) + 1
    return {s: 1 + math.log(n) for s, n in found.items()}


def similarity(a, b):
    if not a or not b:
        return float(not a and not b)
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())


def classes(texts, threshold=0.8):
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [weights(t) for t in texts]
    for i, j in combinations(range(len(texts)), 2):
        if word_list(texts[i]) == word_list(texts[j]) or similarity(sets[i], sets[j]) >= threshold:
            parent[find(j)] = find(i)
    return [find(i) for i in range(len(texts))]


def edited(text, edits, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = "edit" + str(r.randrange(10**6))
    return " ".join(w)


def corpus():
    base, chain, repeated = prose(150, 11), prose(150, 12), "the same line again and again. " * 20
    out = [base, base.upper(), base + "!", None, "", "...", "a b", "A, b", "a b c"]
    out += [edited(base, 2, k) for k in range(12)] + [edited(base, 8, k) for k in range(12)]
    for k in range(8):  # each like the one before, the ends unlike each other
        chain = edited(chain, 2, k)
        out.append(chain)
    return out + [repeated + prose(60, k) for k in range(6)] + [prose(80, 40 + k) for k in range(10)]


def test_near_duplicates_against_brute_force(spark):
    texts = corpus()
    got = neardup.near_duplicates(docs(spark, list(enumerate(texts)))).collect()
    want = classes(texts)
    least = {c: min(i for i, x in enumerate(want) if x == c) for c in set(want)}
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: least[c] for i, c in enumerate(want)}
    assert sum(r["kept"] for r in got) == len(least)


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 1)
    monkeypatch.setattr(neardup, "PART", 3)
    texts = corpus()
    got = neardup.near_duplicates(docs(spark, list(enumerate(texts)))).collect()
    want = classes(texts)
    assert len({(r["class_id"], want[r["doc_id"]]) for r in got}) == len(set(want))


def test_prefixes_meet_for_every_similar_pair(spark):
    """The filter alone, without buckets: every pair at the threshold shares a prefix shingle that the bound allows."""
    texts = corpus()
    nodes = spark.createDataFrame([(i, t or "") for i, t in enumerate(texts)], "node long, text string")
    prefixes = neardup._prefixes(nodes, 0.8)
    labels = spark.createDataFrame([], "node long, label long")
    met = {(r["a"], r["b"]) for r in neardup._prefix_pairs(prefixes, labels, 0.8).collect()}
    sets = [weights(t) for t in texts]
    alike = {(i, j) for i, j in combinations(range(len(texts)), 2) if sets[i] and sets[j] and similarity(sets[i], sets[j]) >= 0.8}
    assert alike <= met and len(met) < len(texts) ** 2 / 4


def test_long_repetitive_texts_have_different_digests():
    bits = [0]
    for _ in range(12):
        bits += [1 - b for b in bits]
    pair = pa.array([" ".join("ab"[b] for b in bits), " ".join("ba"[b] for b in bits)])
    runs = pa.array(["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)])
    for half in shingles.sequence_digests(pair):
        assert half[0] != half[1]
    assert len(set(shingles.words(runs)[0].tolist())) == 2
    same = shingles.sequence_digests(pa.array(["One, two!", "one two", "onetwo", "", None, " \n"]))[0].tolist()
    assert same[0] == same[1] != same[2] and same[3] == same[4] == same[5]


def test_near_duplicates_of_odd_rows(spark):
    got = neardup.near_duplicates(docs(spark)).collect()
    assert len(got) == len(TEXTS)
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert of[1] == of[2] == of[3] == {1} and of[4] == of[5] == {4} and of[6] == of[12] == {6}
    kept = [r["class_key"] for r in got if r["kept"]]
    assert sorted(kept) == sorted({r["class_key"] for r in got})  # one of each, of null and repeated ids too
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    kept = neardup.one_of_each(docs(spark))
    assert kept.columns == docs(spark).columns
    assert kept.count() == len({(r["class_id"], r["class_key"]) for r in got})


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    a = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    b = np.sort(np.concatenate([a[:240], rng.integers(0, 2**63, 60).astype(np.uint64)]))
    wa, wb = (1 + np.log(rng.integers(1, 6, 300)) for _ in range(2))
    exact = shingles.probability_jaccard((a, wa), (b, wb))
    agree = neardup.signatures(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([0, 300, 600]), 20_000)
    assert abs((agree[0] == agree[1]).mean() - exact) < 0.02


def test_exact_similarity_equals_its_definition():
    for k in range(20):
        x, y = prose(30, k).split(), prose(30, k + 1).split()
        x, y = " ".join(x[:20] * 2 + y[:8]), " ".join(y + x[:12])
        w, at = shingles.words(pa.array([x, y]))
        h, v, e = shingles.weighted(*shingles.shingled(w, at))
        got = shingles.probability_jaccard((h[: e[1]], v[: e[1]]), (h[e[1] :], v[e[1] :]))
        assert abs(got - similarity(weights(x), weights(y))) < 1e-9


# --- decontamination --------------------------------------------------------


def test_decontamination_against_brute_force(spark):
    items = [prose(n, 100 + n) for n in (3, 7, 12, 15, 16, 23, 30, 44, 59)] + ["", None, prose(30, 130)]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    texts = [prose(k, 200 + k) + " " + items[k % 9].upper().replace(" ", ", ") + " " + prose(40, 300 + k) for k in range(27)]
    texts += [items[8], " ".join(items[7].split()[1:]), " ".join(items[7].split()[:20]), prose(100, 400), None, "", edited(items[8] + " ", 1, 3)]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.matches(docs(spark, list(enumerate(texts))), benchmark).collect()}
    want = set()
    for d, t in enumerate(texts):
        w = word_list(t)
        for i, item in enumerate(items):
            n = len(word_list(item))
            if n and any(similarity(weights(" ".join(w[max(k, 0) : max(k + n, 0)])), weights(item)) >= 0.8 for k in range(1 - n, len(w))):
                want.add((d, i))
    assert set(got) == want
    clean = decontam.decontaminated(docs(spark, list(enumerate(texts))), benchmark)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(set(range(len(texts))) - {d for d, _ in want})
    assert clean.columns == docs(spark).columns
    assert decontam.matches(docs(spark, []), benchmark).count() == 0
    assert decontam.matches(docs(spark), benchmark.limit(0)).count() == 0


def test_index_finds_every_fingerprint_within_the_radius():
    index = decontam.Index([0], [prose(30, 7)])
    (prints, _, _, lists) = next(iter(index.classes.values()))
    rng = random.Random(1)
    for _ in range(300):
        print_ = int(prints[rng.randrange(len(prints))])
        for bit in rng.sample(range(64), decontam.RADIUS):
            print_ ^= 1 << bit
        values = np.array([print_], np.uint64).view(np.uint16)
        found = {int(e) for b, (start, entries) in enumerate(lists) for e in entries[start[values[b]] : start[int(values[b]) + 1]]}
        near = {i for i, p in enumerate(prints) if bin(int(p) ^ print_).count("1") <= decontam.RADIUS}
        assert near <= found


def test_edited_and_cut_occurrences_are_found():
    """All that reach 0.8 of items of under 45 words, and at least 99 % of longer ones."""
    r = random.Random(11)
    planted = []
    for n in (*range(5, 60), 80, 120):
        item = [r.choice(WORDS) for _ in range(n)]
        for k in range(24):
            part = list(item)
            for _ in range(r.choice((1, 2, 3))):
                place = r.choice((r.randrange(len(part)), 0, len(part) - 1, 1, len(part) - 2))
                what = r.choice("rid")
                part[place : place + (what != "i")] = [] if what == "d" else [f"new{r.random()}"] + ([] if what == "r" else part[place : place])
                if len(part) < 3:
                    break
            cut = r.randrange(1 + n // 5)
            before, after = ["pad"] * r.randrange(9), ["pad"] * r.randrange(9)
            text = {0: part[cut:] + after, 1: before + part[: len(part) - cut]}.get(k % 4, before + part + after)
            whole = weights(" ".join(item))
            if any(similarity(weights(" ".join(text[max(a, 0) : max(a + n, 0)])), whole) >= 0.8 for a in range(1 - n, len(text))):
                planted.append((n, item, text))
    missed = [n for n, item, text in planted if not decontam.Index([0], [" ".join(item)]).matches(pa.array([" ".join(text)]), 0.8)]
    assert len(planted) > 300
    assert not [n for n in missed if n < 45] and len(missed) <= len(planted) // 100


def test_sliced_benchmarks_match_whole_ones(spark, monkeypatch):
    items = spark.createDataFrame([(i, prose(20, i)) for i in range(9)], "item_id long, text string")
    some = docs(spark, [(i, prose(10, 50 + i) + " " + prose(20, i)) for i in range(9)])
    whole = rows_of(decontam.matches(some, items), "doc_id", "item_id")
    monkeypatch.setattr(decontam, "SLICE_BYTES", 100_000)  # two items
    assert rows_of(decontam.matches(some, items), "doc_id", "item_id") == whole == [(i, i) for i in range(9)]
    left = decontam.decontaminated(docs(spark, [(5, prose(30, 77)), *((i, prose(20, i)) for i in range(9)), (None, None), (5, prose(30, 77))]), items)
    assert left.columns == docs(spark).columns and rows_of(left, "doc_id", "text") == [(5, prose(30, 77)), (5, prose(30, 77)), (None, None)]


# --- quality ----------------------------------------------------------------


def test_quality_learns_and_scores_all_rows(spark):
    r = random.Random(2)
    rows = [(i, prose(60, i) if i % 4 else " ".join(w.upper() + "!!" for w in prose(60, i).split())) for i in range(200)]
    odd = [(None, None), (900, ""), (901, LONG), (6, prose(50, 2))]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), r.choice([0, 1])) for i in range(200)] + [(3, None, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs(spark, rows + odd), labels).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in got)
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode() if x["doc_id"] is not None else b"") % 3 == 1) for x in got)
    held = [x for x in got if x["held_out"] and x["doc_id"] is not None and x["doc_id"] < 200]
    assert sum(x["predicted"] == int(x["doc_id"] % 4 > 0) for x in held) / len(held) > 0.97


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {x["score"] for x in quality.quality_scores(docs(spark), none).collect()} == {0.5}
    assert quality.quality_scores(docs(spark, []), none).count() == 0


def test_discriminant_equals_dense_algebra(spark):
    rng = np.random.default_rng(3)
    p = len(quality.FEATURES)
    x = {c: rng.normal(c, 1 + c, (80, p)) for c in (0, 1)}
    frame = spark.createDataFrame([(v.tolist(), c) for c in x for v in x[c]], "features array<double>, label int")
    model = quality.fit(frame)
    common = sum(np.cov(x[c].T, bias=True) for c in x) / 2
    at = rng.normal(0.5, 1, (5, p))
    log = []
    for c in (0, 1):
        s = 0.85 * np.cov(x[c].T, bias=True) + 0.1 * common + 0.05 * np.eye(p) * np.trace(common) / p
        d = at - x[c].mean(axis=0)
        log.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1])
    assert np.allclose(model.scores(at), 1 / (1 + np.exp(log[0] - log[1])))


# --- personal data ----------------------------------------------------------

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for k, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text or ""):
            d = [int(c) for c in m.group() if c.isdigit()]
            luhn = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


TRICKY = ["a@b.c_d@e.f x", "1.2.3.4.5 256.1.1.1 01.002.3.004 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111111", "+1 (234) 555-0000 +1 2 +12345678901234567 +1((((", "é🙂 a.b@c.de, 10.0.0.1;+1 (234) 555-0000.", "@.@ a@b a@b. a@b.c", "9" * 30_000, "a" * 30_000, "a." * 20_000 + "@x", "1.1." * 10_000, "+1" + " " * 30_000, "x@y.zz " * 2000, "٣٣٣٣ 4111１１１１"]


def test_base_spans_equal_the_plain_rules(spark):
    texts = TRICKY + [t for _, t in TEXTS]
    got = {r["doc_id"]: r for r in pii.personal_data(docs(spark, list(enumerate(texts)))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t[:60]
        assert set(want) <= set(got[i]["spans"].split(",")) | {""}
        assert got[i]["n_email"] == sum(x.startswith("email") for x in want)
    assert pii.personal_data(docs(spark, [])).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    cards = [f"411111111111{n:04d}" for n in range(10_000)]
    good = [c for c in cards if base_spans(c)][:40]
    bad = next(c for c in cards if not base_spans(c))
    texts = [f"please charge card number {c} today thanks" for c in good] + [f"please charge card number {bad} today thanks", f"something else {bad[::-1]} here"]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs(spark, list(enumerate(texts)))).collect()}
    assert got[40] == f"card:26:{26 + len(bad)}" and got[41] == ""


def test_discovered_instances_reach_further_ones(spark):
    """Seeds teach a first context; what it discovers teaches a second one, which no seed stands in."""
    seeds = [(f"mail me at user{k}@corp{k}.com please", True) for k in range(12)]
    first = [(f"mail me at jane{c}(at)corp please", True) for c in "abcdef"]
    bridge = [(f"contact: jane{c}(at)corp soon", True) for c in "abcdef"]
    second = [(f"contact: zoe{c}(at)else soon", True) for c in "abcdef"]
    other = [(f"the number of {c}_rows is small", False) for c in "abcdef"]
    rows = seeds + first + bridge + second + other
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs(spark, [(i, t) for i, (t, _) in enumerate(rows)])).collect()}
    found = {i for i, s in got.items() if s}
    assert found == {i for i, (_, wanted) in enumerate(rows) if wanted}


def test_graph_scores_equal_plain_loops(spark):
    r = random.Random(3)
    edges = {(i, ("email", "phone", None)[i % 3], p) for i in range(60) for p in r.sample(range(25), 4)}
    edges |= {(i, "email", 99) for i in range(0, 60, 3)} | {(i, None, 99) for i in (2, 5, 8)}
    got = {x["instance"]: (x["kind"], round(x["belief"], 9)) for x in pii.bootstrapped(spark.createDataFrame(list(edges), "instance long, kind string, pattern long")).collect()}
    size, seeded = {}, {}
    for i, k, p in edges:
        size[p] = size.get(p, 0) + 1
        if k:
            seeded[p, k] = seeded.get((p, k), 0) + 1
    told = {x: (n, n) for x, n in seeded.items()}
    for _ in range(pii.ROUNDS):
        sure = {(p, k): min(1 - 1e-9, s / size[p] * (1 - 2.0**-s)) for (p, k), (n, s) in told.items() if n >= pii.SUPPORT}
        belief = {}
        for i, own, p in edges:
            if own is None:
                for k in ("email", "phone"):
                    if (p, k) in sure:
                        belief[i, k] = 1 - (1 - belief.get((i, k), 0)) * (1 - sure[p, k])
        best = {}
        for (i, k), b in belief.items():
            best[i] = max(best.get(i, (0, "")), (b, k))
        want = {i: (k, b) for i, (b, k) in best.items() if b >= pii.ACCEPT}
        told = {x: [n, n] for x, n in seeded.items()}
        for i, own, p in edges:
            if own is None:
                for k in ("email", "phone"):
                    if (i, k) in belief:
                        n, s = told.get((p, k), (0, 0))
                        told[p, k] = [n + (want.get(i, ("",))[0] == k), s + belief[i, k]]
    assert want and got == {i: (k, round(b, 9)) for i, (k, b) in want.items()}


# --- chat -------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string, message long, parent long, score double, tree long"


def chats(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 9.0, 1) for r in rows], CHAT)


def test_chat_digests_equal_the_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\b <|im_end|> <\\| \\\\<| é🙂"), (1, 3, "assistant", None), (1, 3, "assistant", "tie"), (2, 5, None, ""), (None, 0, "assistant", "n"), (None, 1, "us\ner\\n<|", "m\n")]
    rows += [(3, 0, "user", "same"), (3, 0, "user", "same")] + [(4, k, "assistant" if k % 2 else "user", str(k)) for k in range(70)] + [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)]
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(chat.reply_paths(chat.turn_tree(chats(spark, rows))))).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.formatted(chat.reply_paths(chat.turn_tree(chats(spark, []))))).count() == 0


def test_branches_are_ranked_by_score(spark):
    tree = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.5), (1, 5, 4, "assistant", "x", 0.2), (1, 6, 4, "assistant", "y", 0.8), (2, 1, 2, "user", "cycle", 1.0), (2, 2, 1, "user", "cycle", 1.0), (3, 1, 77, "user", "lost parent", None)]
    paths = chat.reply_paths(spark.createDataFrame(tree, "tree long, message long, parent long, role string, text string, score double"), best=2)
    got = {(r["tree"], r["rank"]): r["formatted"] for r in chat.formatted(paths).collect()}
    turn = lambda *x: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in x)
    assert got[1, 1] == turn(("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "y"))
    assert got[1, 2] == turn(("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "x"))
    assert got[3, 1] == turn(("user", "lost parent")) and (2, 1) not in got


# --- secrets ----------------------------------------------------------------

SECRET = hashlib.sha1(b"s").hexdigest()


def test_secrets_are_masked_and_the_rest_is_kept(spark):
    texts = [(1, f'the token = "{SECRET}" ends'), (2, f'THE TOKEN = "{SECRET.upper()}"!! ENDS'), (3, "card 4111111111111111 of no one"), (4, f"see commit {SECRET} for it"), *TEXTS]
    some = docs(spark, texts)
    got = secret_scan.redacted(some)
    assert got.columns == some.columns and got.count() == len(texts)
    out = {r["doc_id"]: r for r in got.collect()}
    assert out[1]["text"] == 'the token = "[SECRET]" ends' and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] == 'THE TOKEN = "[SECRET]"!! ENDS'
    assert out[3]["text"] == texts[2][1] and out[4]["text"] == texts[3][1] and out[9]["text"] == LONG and out[10]["text"] == "x" * 50_000
    every = secret_scan.secret_findings(some).collect()
    whole = dict(TEXTS) | dict(texts[:4])
    for r in (r for r in every if r["doc_id"] is not None):  # no offset depends on a column of the input
        assert hashlib.sha256(whole[r["doc_id"]][r["start"] : r["end"]].encode()).hexdigest() == r["value_sha256"]
    clash = some.withColumn("_verdicts", F.lit(1)).withColumn("verdicts", F.lit(2)).withColumn("doc", F.lit(3))
    assert rows_of(secret_scan.redacted(clash).drop("_verdicts", "verdicts", "doc"), *some.columns) == rows_of(got, *some.columns)
    found = rows_of(secret_scan.secret_findings(some).where("is_secret"), "doc_id", "start", "end", "value_sha256")
    assert found[0][:3] == (1, 13, 53) and found[0][3] == hashlib.sha256(SECRET.encode()).hexdigest() and len(found) == 2
    assert secret_scan.redacted(docs(spark, [])).count() == 0 and secret_scan.secret_findings(docs(spark, [])).count() == 0


def test_forest_on_held_out_findings(spark):
    all_ = secret_scan.builtin_findings(spark, 8000).withColumn("_k", F.pmod(F.xxhash64("value"), F.lit(4)))
    model = secret_scan.train(all_.where("_k < 3").drop("_k"))
    told = secret_scan.scored(all_.where("_k = 3"), model).select("label", "is_secret").collect()
    assert sum(bool(r["label"]) == r["is_secret"] for r in told) / len(told) > 0.97
