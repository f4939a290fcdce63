"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, are trained from document labels.

A text is cut into sentences at stops, exclamation and question marks and line
ends. A sentence's features are its words (runs of letters and digits; A-Z and
the Latin-1 capitals in lower case) and the words' first 3 to 6 bytes. *Cues*
are the features that toxic labelled documents hold more often than others, by
the likelihood ratio G of their document counts. A sentence without a cue can't
offend; one with cues offends with the probability p = sigmoid(bias + sum of the
cues' weights), and a document is toxic unless no sentence offends:

    score = 1 - (1 - leak) * product over its sentences of (1 - p)

``leak`` is the share of toxic documents that no sentence explains. Bias,
weights and leak are fitted by expectation-maximisation: given its label, a
sentence of a toxic document offends with the probability p / score, one of a
clean document with 0. Each round is one Spark aggregation of bounded size (a
row for each cue); the driver holds the cues' weights and nothing else.

The fit uses at most about TRAINING_ROWS labelled documents, chosen by a hash of
their ids; their ids are the only table that is broadcast. Equal texts with
equal labels count once in the fit, so that copies do not pass for evidence.

Defined cases: a null text counts as empty; a document without cues scores
``leak``; without toxic or without clean labelled documents there are no cues
and every score is the share of toxic labels (0.5 without labels); labels other
than 0 and 1 are not used; a document with several labels is toxic if one says
so; repeated rows are scored one by one; an empty table gives no rows; other
columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinworks.llm.quality import held_out
from veinworks.llm.shingles import mixed, turns
from veinworks.llm.storage import checkpointed

#: Labelled documents used for the fit, about; cues kept; the least G of a cue (chi-square with one degree of freedom).
TRAINING_ROWS, MAX_CUES, LEAST_G = 20_000, 8192, 11.0
ROUNDS, RIDGE = 40, 0.1
PREFIXES = (3, 4, 5, 6)
#: From this score on a document is predicted to be toxic, and a sentence to offend.
TOXIC = 0.7
TURN_BYTES = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ENDS = np.zeros(256, bool)
_ENDS[np.frombuffer(b".!?\n", np.uint8)] = True


@dataclass(frozen=True)
class Words:
    """Words of some texts: their features (a row each), text numbers and first bytes; bytes, text edges and sentence ends."""

    features: np.ndarray
    row: np.ndarray
    first: np.ndarray
    raw: np.ndarray
    at: np.ndarray
    ends: np.ndarray

    def sentence(self, word: np.ndarray) -> np.ndarray:
        """A number for the sentence of each word, unique over all texts; texts end sentences too."""
        return np.searchsorted(self.ends, self.first[word]) + self.row[word]


def words(texts: pa.Array) -> Words:
    """Positions are those of the unchanged bytes, since the lower case keeps every length."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    low = raw.copy()
    capital = (low >= 65) & (low <= 90)
    if len(low):
        capital[1:] |= (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
    low[capital] += 32
    inside = _IN_WORD[low]
    n = len(inside)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[at[:-1][at[:-1] < n]] = False
    after[at[1:][at[1:] > 0] - 1] = False
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    length = last - first
    # the hash of a run of bytes is a sum of products with a pseudo-random factor for each place in its word
    upto = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    place = np.arange(upto[-1]) - np.repeat(upto[:-1], length)
    factor = mixed(np.arange(1, int(length.max(initial=0)) + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_OF_BYTE[low[inside]] * factor[place], dtype=np.uint64)])
    found = np.empty((len(first), 1 + len(PREFIXES)), np.uint64)
    found[:, 0] = mixed(sums[upto[1:]] - sums[upto[:-1]] + length.astype(np.uint64))
    for k, size in enumerate(PREFIXES, 1):
        # a shorter word's prefix is the word itself and brings no feature of its own
        found[:, k] = np.where(length > size, mixed(sums[np.minimum(upto[:-1] + size, upto[1:])] - sums[upto[:-1]] + np.uint64(size + 1_000_000)), found[:, 0])
    return Words(found, np.searchsorted(at, first, side="right") - 1, first, raw, at, np.flatnonzero(_ENDS[raw]))


@dataclass(frozen=True)
class Noisy:
    """The leak, the bias, and the cues (ascending hashes) with their weights."""

    leak: float
    bias: float
    cues: np.ndarray
    weights: np.ndarray


def _hits(w: Words, cues: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (sentence, cue) pairs: the sentence's number, its text's number, the cue's; by sentence."""
    if not len(cues) or not w.features.size:
        none = np.zeros(0, np.int64)
        return none, none, none
    near = np.zeros(1 << 20, bool)
    near[(cues >> np.uint64(44)).astype(np.int64)] = True
    word, k = np.nonzero(near[(w.features >> np.uint64(44)).astype(np.int64)])
    h = w.features[word, k]
    cue = np.minimum(np.searchsorted(cues, h), len(cues) - 1)
    same = cues[cue] == h
    word, cue = word[same], cue[same]
    sentence = w.sentence(word)
    _, one = np.unique(sentence * len(cues) + cue, return_index=True)
    return sentence[one], w.row[word[one]], cue[one]


def sentence_scores(w: Words, model: Noisy) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each sentence with cues, its text's number and its p."""
    sentence, row, cue = _hits(w, model.cues)
    number, first, group = np.unique(sentence, return_index=True, return_inverse=True)
    z = model.bias + np.bincount(group, model.weights[cue], minlength=len(number)) if len(number) else np.zeros(0)
    return number, row[first], 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def document_scores(n: int, row: np.ndarray, p: np.ndarray, leak: float) -> np.ndarray:
    """The noisy-or over each text's sentences."""
    return 1 - (1 - leak) * np.exp(np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))


def _spans(w: Words, number: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sentences begin and end in their texts, in characters; the mark that ends one belongs to it."""
    end = number - row
    edges = np.concatenate([[-1], w.ends, [len(w.raw)]])
    start, stop = np.maximum(edges[end] + 1, w.at[row]), np.minimum(edges[end + 1] + 1, w.at[row + 1])
    chars = np.concatenate([[0], np.cumsum((w.raw & 0xC0) != 0x80)])
    return chars[start] - chars[w.at[row]], chars[stop] - chars[w.at[row]]


def feature_counts(rows: DataFrame) -> DataFrame:
    """For each feature the numbers of toxic and of clean documents (``label``) that hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in turns(pc.fill_null(batch.column("text"), ""), TURN_BYTES):
                w = words(texts)
                toxic = batch.column("label").slice(at, len(texts)).to_numpy(zero_copy_only=False) == 1
                row = np.repeat(w.row, w.features.shape[1])
                h = w.features.ravel()
                _, one = np.unique(mixed(h + row.astype(np.uint64) * _BASE), return_index=True)
                feature, group = np.unique(h[one], return_inverse=True)
                in_toxic = np.bincount(group, toxic[row[one]], minlength=len(feature)).astype(np.int64)
                every = np.bincount(group, minlength=len(feature)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"feature": feature.view(np.int64), "toxic": in_toxic, "clean": every - in_toxic})

    counted = rows.select("text", "label").mapInArrow(count, "feature long, toxic long, clean long")
    return counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def likelihood_ratio(toxic: str, clean: str, n_toxic: int, n_clean: int):
    """G of the two shares of documents that hold a feature, as a column."""
    a, b = F.col(toxic).cast("double"), F.col(clean).cast("double")
    n = float(n_toxic + n_clean)
    part = lambda x, of: F.when(x > 0, x * F.ln(x / of)).otherwise(0.0)
    held, rest = a + b, F.lit(n) - a - b
    return 2 * (part(a, held * n_toxic / n) + part(b, held * n_clean / n) + part(n_toxic - a, rest * n_toxic / n) + part(n_clean - b, rest * n_clean / n))


def sentence_cues(rows: DataFrame, cues: np.ndarray) -> DataFrame:
    """For each document its label, and for its sentences with cues how many cues they have and which, one after the other."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in turns(pc.fill_null(batch.column("text"), ""), TURN_BYTES):
                sentence, row, cue = _hits(words(texts), cues)
                number, first, size = np.unique(sentence, return_index=True, return_counts=True)
                n = np.arange(len(texts) + 1)
                sizes = pa.ListArray.from_arrays(np.searchsorted(row[first], n).astype(np.int32), pa.array(size.astype(np.int32)))
                found = pa.ListArray.from_arrays(np.searchsorted(row, n).astype(np.int32), pa.array(cue.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(at, len(texts)).cast(pa.int32()), sizes, found], names=["label", "sizes", "cues"])

    return rows.select("text", "label").mapInArrow(find, "label int, sizes array<int>, cues array<int>")


def expectations(batch: pa.RecordBatch, model: Noisy) -> np.ndarray:
    """Gradient and curvature of the log likelihood for the bias and each weight; then the expected leaks, and the log likelihood itself, each above the number of documents."""
    sizes, cue = batch.column("sizes"), batch.column("cues").flatten().to_numpy(zero_copy_only=False)
    size = sizes.flatten().to_numpy(zero_copy_only=False)
    per_row = pc.list_value_length(sizes).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(per_row)), per_row)
    of = np.repeat(np.arange(len(size)), size)
    z = model.bias + np.bincount(of, model.weights[cue], minlength=len(size)) if len(size) else np.zeros(0)
    p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    toxic = batch.column("label").to_numpy(zero_copy_only=False) == 1
    score = np.maximum(document_scores(len(per_row), row, p, model.leak), 1e-12)
    residual = np.where(toxic[row], p / score[row], 0.0) - p
    # a bound of the curvature: each sentence's, times the number of its parameters
    bend = p * (1 - p) * (size + 1)
    k = len(model.cues)
    by_cue = lambda x: np.bincount(cue, x[of], minlength=k)
    likely = np.log(np.where(toxic, score, np.maximum(1 - score, 1e-12))).sum()
    return np.array([[residual.sum(), *by_cue(residual), (model.leak / score)[toxic].sum(), likely], [bend.sum(), *by_cue(bend), len(per_row), len(per_row)]])


def fit(rows: DataFrame) -> Noisy:
    """Fit on the columns ``text`` and ``label``. ``rows`` is read a few times: write it first."""
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    share = n_toxic / (n_toxic + n_clean) if n_toxic + n_clean else 0.5
    if not n_toxic or not n_clean:
        return Noisy(share, 0.0, np.zeros(0, np.uint64), np.zeros(0))
    g = likelihood_ratio("toxic", "clean", n_toxic, n_clean)
    found = feature_counts(rows).where(F.col("toxic") * n_clean > F.col("clean") * n_toxic).withColumn("g", g).where(F.col("g") >= LEAST_G)
    cues = np.sort(np.array([r["feature"] for r in found.orderBy(F.desc("g"), "feature").limit(MAX_CUES).select("feature").collect()], np.int64).view(np.uint64))
    model = last = Noisy(min(share, 0.05), -1.0, cues, np.zeros(len(cues)))
    bags = checkpointed(sentence_cues(rows, cues))
    best, speed = -np.inf, 0
    for _ in range(ROUNDS):
        # each step starts a little further on in the direction of the last one (Nesterov), until that makes matters worse
        ahead = speed / (speed + 3)
        likely, after = _improved(bags, Noisy(model.leak, model.bias + ahead * (model.bias - last.bias), cues, model.weights + ahead * (model.weights - last.weights)))
        speed = speed + 1 if likely >= best else 0
        best, last, model = likely, model, after
    return model


def _improved(bags: DataFrame, model: Noisy) -> tuple[float, Noisy]:
    """The penalised log likelihood of ``model``, and it after one round: expectations summed by Spark, then a step for each parameter."""
    k = len(model.cues)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, k + 3))
        for batch in batches:
            sums += expectations(batch, model)
        some = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_pydict({"at": some.astype(np.int32), "g": sums[0, some], "h": sums[1, some]})

    g, h = np.zeros(k + 3), np.zeros(k + 3)
    for r in bags.mapInArrow(expect, "at int, g double, h double").groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
        g[r["at"]], h[r["at"]] = r["g"], r["h"]
    at = np.concatenate([[model.bias], model.weights])
    step = np.clip((g[: k + 1] - RIDGE * at) / (h[: k + 1] + RIDGE), -2.0, 2.0)
    # the last sums are the log likelihood and the documents, those before them the expected leaks and the documents
    leak = float(np.clip((g[k + 1] + 0.5) / (h[k + 1] + 1.0), 1e-6, 0.5))
    return float(g[k + 2] - RIDGE / 2 * (at @ at)), Noisy(leak, float(at[0] + step[0]), model.cues, at[1:] + step[1:])


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text`` and ``label`` of about TRAINING_ROWS labelled documents that aren't held out, equal rows once; written to the shared folder."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    n = known.count()
    if n > TRAINING_ROWS:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * (TRAINING_ROWS / n)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    return checkpointed(rows.select("text", "label", F.md5("text").alias("digest")).dropDuplicates(["digest", "label"]).select("text", "label"))


RESULT = "doc_id long, score double, predicted int, offending array<struct<start:long,end:long,score:double>>"


def scored(docs: DataFrame, model: Noisy, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted and ``offending``: the sentences with p of TOXIC or more, in order, by their characters. No shuffle."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in turns(pc.fill_null(batch.column("_text"), ""), TURN_BYTES):
                w = words(texts)
                number, row, p = sentence_scores(w, model)
                score = document_scores(len(texts), row, p, model.leak)
                bad = p >= TOXIC
                start, end = _spans(w, number[bad], row[bad])
                spans = pa.StructArray.from_arrays([pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64)), pa.array(p[bad])], names=["start", "end", "score"])
                offending = pa.ListArray.from_arrays(np.searchsorted(row[bad], np.arange(len(texts) + 1)).astype(np.int32), spans)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(score), pa.array((score >= TOXIC).astype(np.int32)), offending], names=["doc_id", "score", "predicted", "offending"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInArrow(measure, RESULT)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences of each row of ``docs``."""
    return scored(docs, fit(labelled(docs, labels))).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "offending")
