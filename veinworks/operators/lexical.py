"""Text predicates and lexical retrieval: scripts, bigrams, postings, BM25 and fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinworks.functions.storage import checkpointed
from veinworks.operators import matrix


#: Keys of fingerprints in a partition.
BAND_KEYS = 250_000
#: The ranges of Han letters that count for a text's script.
HAN = "\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff"


def script(text: Column) -> Column:
    """Language by script: und below 20 letters; zh, en or multilingual by the share of Han letters."""
    return script_parts(text)["script"]


def script_parts(text: Column) -> Column:
    """script and its confidence: 0 below 20 letters, the share of the prevailing script, nearness to one half for mixed texts."""

    def told(n: Column) -> Column:
        han, latin = n["bare"] - n["no_han"], n["whole"] - n["bare"]
        share = han / F.greatest(han + latin, F.lit(1))
        few = han + latin < 20
        name = F.when(few, "und").when(share >= 0.7, "zh").when(share <= 0.15, "en").otherwise("multilingual")
        sure = F.when(few, 0.0).when(share >= 0.7, share).when(share <= 0.15, 1 - share).otherwise(1 - F.abs(share - 0.5) * 2)
        return F.struct(name.alias("script"), F.round(sure, 4).alias("confidence"))

    # runs of letters are dropped instead of counting matches one by one; a variable holds the lengths, so each text is searched once
    first = lambda value, f: F.transform(F.array(value), f)[0]
    length = lambda t: F.coalesce(F.char_length(t), F.lit(0))
    bare = lambda t: F.struct(length(t).alias("whole"), F.regexp_replace(t, "[A-Za-z]+", "").alias("text"))
    lengths = lambda s: F.struct(s["whole"].alias("whole"), length(s["text"]).alias("bare"), length(F.regexp_replace(s["text"], f"[{HAN}]+", "")).alias("no_han"))
    return first(first(first(text, bare), lengths), told)


def page_exclusion(pages: DataFrame) -> DataFrame:
    """Why a page is left out, first reason first: duplicate, blank, cover, or none. Pages are (doc_id, page, text)."""
    digest = F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256)
    seen = F.row_number().over(Window.partitionBy("doc_id", "_hash").orderBy("page"))
    n = F.char_length("text")
    reason = F.when(F.col("_seen") > 1, "duplicate").when(n < 80, "blank").when((F.col("page") <= 2) & (n < 700), "cover").otherwise("none")
    return pages.withColumn("_hash", digest).withColumn("_seen", seen).select("doc_id", "page", reason.alias("reason"))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters, lower case, without white space; a lone character stands for itself."""
    bare = F.regexp_replace(F.lower(text), r"\s+", "")
    n = F.char_length(bare)
    return F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(bare)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: bare.substr(i, F.lit(2)))))


def dice(a: Column, b: Column) -> Column:
    """Twice the common share of two sets; 0 if either is empty."""
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(a, b)), F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(a) + F.size(b))), F.lit(0.0))


def tokens(text: Column) -> Column:
    """All runs of Latin letters and digits, lower case; none for a null text."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), F.array().cast("array<string>"))


def _held(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    return rows.select(F.col(key), tokens(F.col(text)).alias("_t"))


class _Terms:
    """The distinct tokens of a block of queries, as columns of a matrix."""

    def __init__(self, asked: list[list[str]]):
        self.words = sorted({t for ts in asked for t in ts})
        at = {t: i for i, t in enumerate(self.words)}
        self.matrix = np.zeros((len(self.words), len(asked)))
        for q, ts in enumerate(asked):
            self.matrix[[at[t] for t in ts], q] = 1.0

    def counts(self, lists: pa.Array) -> np.ndarray:
        """How often each list holds each token."""
        code = pc.index_in(lists.flatten(), value_set=pa.array(self.words, pa.string()))
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
        known = code.is_valid().to_numpy(zero_copy_only=False)
        cell = row[known] * len(self.words) + code.drop_null().to_numpy()
        return np.bincount(cell, minlength=len(lists) * len(self.words)).reshape(len(lists), len(self.words)).astype(float)


def _term_statistics(held: DataFrame, terms: _Terms) -> tuple[np.ndarray, int, float]:
    """Documents with each term, documents with tokens, and their mean length; only sums leave the tasks."""
    k = len(terms.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + 2, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                lists = whole.column("_t").slice(at, step)
                length = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                total += np.concatenate([(terms.counts(lists) > 0).sum(0), [(length > 0).sum(), length.sum()]])
        yield pa.RecordBatch.from_pydict({"at": np.arange(k + 2, dtype=np.int32), "n": total})

    step = max(1, matrix.CELLS // (k + 1))
    sums = np.zeros(k + 2, np.int64)
    for r in held.select("_t").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        sums[r["at"]] = r["n"]
    return sums[:k], int(sums[k]), sums[k + 1] / max(1, sums[k])


def bm25(corpus: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, limit: int = 500) -> DataFrame:
    """The ``k`` best documents of each query by BM25: query_id, rank, doc_id, score.

    Queries are a stated set held against all documents, in blocks of ``limit``. The first pass counts the block's terms,
    the second multiplies the terms' weights in each batch of documents with the queries; no postings are shuffled.
    """
    held = _held(corpus, "doc_id")

    def block(asked: list) -> DataFrame:
        terms = _Terms([sorted(set(r["_t"])) for r in asked])
        df, n, mean = _term_statistics(held, terms)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))

        def score(batch: pa.RecordBatch) -> Callable[[slice], np.ndarray]:
            tf = terms.counts(batch.column("_t"))
            length = pc.list_value_length(batch.column("_t")).to_numpy(zero_copy_only=False)[:, None]
            weight = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / (mean or 1.0)))
            return lambda some: weight @ terms.matrix[:, some]

        return matrix.best_rows(held, score, [r["query_id"] for r in asked], _kind(queries), k, "doc_id", len(terms.words), above=0.0)

    return matrix.united(block(asked) for asked in matrix.blocks(_held(queries, "query_id"), "query_id", limit))


def bm25_scores(corpus: DataFrame, queries: list[tuple[str, str]], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score) of every document that shares a token with a query (a short list of ids and texts), unrounded; one pass for the counts, one for the scores."""
    held = _held(corpus, "doc_id")
    asked = queries and held.sparkSession.createDataFrame(queries, "query_id string, text string").select("query_id", tokens(F.col("text")).alias("_t")).collect()
    terms = _Terms([sorted(set(r["_t"])) for r in asked])
    df, n, mean = _term_statistics(held, terms)
    idf, names = np.log(1 + (n - df + 0.5) / (df + 0.5)), np.array([r["query_id"] for r in asked], object)
    step, kind = max(1, matrix.CELLS // (len(terms.words) + len(names) + 1)), corpus.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                tf, length = terms.counts(batch.column("_t")), pc.list_value_length(batch.column("_t")).to_numpy(zero_copy_only=False)[:, None]
                scores = (idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / max(mean, 1e-9)))) @ terms.matrix
                row, query = np.nonzero(scores > 0)
                yield pa.RecordBatch.from_arrays([pa.array(names[query], pa.string()), batch.column("doc_id").take(pa.array(row)), pa.array(scores[row, query])], names=["query_id", "doc_id", "score"])

    return held.mapInArrow(score, f"query_id string, doc_id {kind}, score double")


def postings_hits(corpus: DataFrame, queries: DataFrame, k: int, limit: int = 500) -> DataFrame:
    """The ``k`` documents of each query that hold most of its distinct tokens: query_id, rank, doc_id, hits. Ties go to the greatest id."""
    held = _held(corpus, "doc_id")

    def block(asked: list) -> DataFrame:
        terms = _Terms([sorted(set(r["_t"])) for r in asked])
        def score(batch: pa.RecordBatch) -> Callable[[slice], np.ndarray]:
            has = (terms.counts(batch.column("_t")) > 0).astype(float)
            return lambda some: has @ terms.matrix[:, some]

        best = matrix.best_rows(held, score, [r["query_id"] for r in asked], _kind(queries), k, "doc_id", len(terms.words), above=0.0, last_id_first=True, measure="hits")
        return best.withColumn("hits", F.col("hits").cast("long"))

    return matrix.united(block(asked) for asked in matrix.blocks(_held(queries, "query_id"), "query_id", limit))


def dice_top(labels: DataFrame, queries: DataFrame, k: int, limit: int = 500) -> DataFrame:
    """The ``k`` labels (evidence_id, label) most like each query (query_id, text) by Dice's measure of their bigrams; labels without a common one score 0."""
    held = labels.select("evidence_id", bigrams(F.col("label")).alias("_t"))

    def block(asked: list) -> DataFrame:
        terms = _Terms([r["_t"] or [] for r in asked])
        sizes = np.array([len(r["_t"] or []) for r in asked])

        def score(batch: pa.RecordBatch) -> Callable[[slice], np.ndarray]:
            own = pc.list_value_length(batch.column("_t")).fill_null(0).to_numpy(zero_copy_only=False)[:, None]
            counts = terms.counts(batch.column("_t"))
            return lambda some: 2.0 * (counts @ terms.matrix[:, some]) / np.maximum(own + sizes[some], 1)

        return matrix.best_rows(held, score, [r["query_id"] for r in asked], _kind(queries), k, width=len(terms.words))

    return matrix.united(block(asked) for asked in matrix.blocks(queries.select("query_id", bigrams(F.col("text")).alias("_t")), "query_id", limit))


def _kind(queries: DataFrame) -> str:
    return queries.schema["query_id"].dataType.simpleString()


def simhash(rows: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 60) -> DataFrame:
    """(key, hash): each bit is set where its tokens, signed by the bits of their MD5, sum to 0 or more; texts without tokens are left out.

    Sums are made inside the row, so nothing is shuffled; each distinct token of a batch is hashed once.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_t")
            known = lists.flatten().dictionary_encode()
            first = np.array([int(hashlib.md5(t.encode()).hexdigest()[:15], 16) for t in known.dictionary.to_pylist()], np.int64)
            signs = (((first[:, None] >> np.arange(bits)) & 1) * 2 - 1).astype(np.int8)
            code, at = known.indices.to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            total = [signs[code[x:y]].sum(0, dtype=np.int64) for x, y in zip(at[:-1], at[1:], strict=True)]
            hashes = [int((np.int64(1) << np.flatnonzero(t >= 0)).sum()) for t in total]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(hashes, pa.int64())], names=[key, "hash"])

    kind = rows.schema[key].dataType.simpleString()
    return _held(rows, key, text).where(F.size("_t") > 0).mapInArrow(sums, f"{key} {kind}, hash long")


def near_hashes(hashes: DataFrame, distance: int = 3, key: str = "doc_id") -> DataFrame:
    """Pairs of different hashes within ``distance`` (at most 3) of 60 bits, with the number of rows of each.

    Equal hashes are first counted, so copies are not paired. Of six blocks of ten bits, three are equal in every such
    pair; each choice of three makes a key of 30 bits, which stays selective for many hashes. A pair that shares several
    keys is told under the first, that of its three lowest equal blocks. Keys are dealt into as many partitions as
    their number asks for: the hashes are few bytes, so partitions sized by these would hold ever more keys.
    """
    counted = checkpointed(hashes.groupBy("hash").agg(F.count("*").alias("rows")))
    block = lambda c, i: F.shiftright(c, 10 * i).bitwiseAND(F.lit(1023))
    bands = list(combinations(range(6), 3))
    keys = F.array(*(F.shiftleft(block("hash", x), 20).bitwiseOR(F.shiftleft(block("hash", y), 10)).bitwiseOR(block("hash", z)) for x, y, z in bands))
    parts = max(counted.sparkSession.sparkContext.defaultParallelism, -(-counted.count() * len(bands) // BAND_KEYS))
    # the hashes are dealt out before each makes its keys, as a task can't hold the keys of all
    banded = counted.repartition(max(1, parts // len(bands)), "hash").select("hash", "rows", F.posexplode(keys).alias("band", "value")).repartition(parts, "band", "value")
    away = F.bit_count(F.col("hash").bitwiseXOR(F.col("other")))
    equal = sum((F.when(block(F.col("hash").bitwiseXOR(F.col("other")), w) == 0, 1 << w).otherwise(0) for w in range(6)), F.lit(0))
    lower = F.array(*(F.lit(sum(1 << w for w in range(z) if w not in (x, y))) for x, y, z in bands))[F.col("band")]
    first = equal.bitwiseAND(lower) == 0
    met = banded.join(banded.withColumnsRenamed({"hash": "other", "rows": "other_rows"}), ["band", "value"]).where((F.col("hash") < F.col("other")) & (away <= distance))
    return met.where(first).select("hash", "other", "rows", "other_rows", away.alias("distance"))


def capped(pages: DataFrame, per_family: int, per_group: int) -> DataFrame:
    """At most ``per_family`` pages of a (fault, role, family), then at most ``per_group`` of a (fault, role), best score first."""
    inner = Window.partitionBy("fault_id", "role", "family_id").orderBy(F.desc("score"), "page_id")
    outer = Window.partitionBy("fault_id", "role").orderBy(F.desc("score"), "page_id")
    return pages.withColumn("_i", F.row_number().over(inner)).where(F.col("_i") <= per_family).withColumn("rank", F.row_number().over(outer)).where(F.col("rank") <= per_group).drop("_i")


def adjacent(pages: DataFrame, width: int, decay: float) -> DataFrame:
    """For each page of a document, its neighbours up to ``width`` pages away, the score lowered by the distance.

    Offsets are exploded, so the join is an equality on (doc_id, page).
    """
    offsets = F.explode(F.array(*(F.lit(i) for i in range(-width, width + 1) if i))).alias("offset")
    near = pages.select("doc_id", F.col("page").alias("base"), F.col("score").alias("_s"), offsets).withColumn("page", F.col("base") + F.col("offset"))
    return near.join(pages.select("doc_id", "page"), ["doc_id", "page"]).select("doc_id", "base", "page", F.round(F.col("_s") - F.abs("offset") * decay, 6).alias("score"))
