"""Quality scores by regularised quadratic discriminant analysis.

Every text is described by statistics of its whole length (``FEATURES``),
transformed so that they spread evenly. Spark sums counts, means and products
for each class of the labelled rows; each class covariance is shrunk towards
the mean of both classes' covariances and towards a multiple of the identity
matrix, and factored once (Cholesky). A score is the logistic function of the
difference of the two Gaussian log densities plus that of the log priors; the
distances come from the cached factors.

Only sums leave the executors, so nothing that is collected grows with the
data. Defined cases: a null text counts as empty and gets the statistics of
one; labels other than 0 and 1 are not used; a document with several labels
counts with each; a class without rows makes every score the other's prior
(0.5 without any labels); an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinworks.llm.shingles import turns
from veinworks.llm.storage import checkpointed

FEATURES = ("log_bytes", "upper", "digits", "spaces", "lines", "stops", "commas", "marks", "bangs", "pipes", "other_signs", "non_ascii", "word_bytes", "distinct_words", "repeated_lines", "signed_words")
#: Weight of the common covariance and of the identity in each class covariance.
TO_COMMON, TO_IDENTITY = 0.1, 0.05
TURN_BYTES = 2_000_000
#: ``training_rows`` takes about so many labelled documents at most; their ids are broadcast.
TRAINING_ROWS = 50_000

_CLASSES = ("upper", "digits", "spaces", "lines", "stops", "commas", "bangs", "pipes", "other_signs", "non_ascii")


def _byte_classes() -> np.ndarray:
    """The class of each byte, as its place in _CLASSES; 255 for none."""
    of = np.full(256, 255, np.uint8)
    of[128:] = _CLASSES.index("non_ascii")
    for low, high in ((33, 47), (58, 64), (91, 96), (123, 126)):
        of[low : high + 1] = _CLASSES.index("other_signs")
    for name, chars in (("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digits", "0123456789"), ("spaces", " \t\r\f\v"), ("lines", "\n"), ("stops", ".?"), ("commas", ",;:'\"-"), ("bangs", "!"), ("pipes", "|")):
        of[np.frombuffer(chars.encode(), np.uint8)] = _CLASSES.index(name)
    return of


_CLASS_OF = _byte_classes()


def _distinct_per_row(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of values in each list, and of distinct ones."""
    edges = lists.offsets.to_numpy().astype(np.int64)
    code = lists.values.slice(edges[0], edges[-1] - edges[0]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.diff(edges)
    row = np.repeat(np.arange(len(n)), n)
    pairs = np.unique(row * (int(code.max(initial=0)) + 1) + code)
    return n, np.bincount(pairs // (int(code.max(initial=0)) + 1), minlength=len(n))


def text_statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    size = np.diff(at)
    kind = _CLASS_OF[raw]
    count = {}
    for i, name in enumerate(_CLASSES):
        upto = np.concatenate([[0], np.flatnonzero(kind == i)])
        count[name] = np.searchsorted(upto[1:], at[1:]) - np.searchsorted(upto[1:], at[:-1])
    words, distinct = _distinct_per_row(pc.ascii_split_whitespace(pc.ascii_lower(texts)))
    lines, distinct_lines = _distinct_per_row(pc.split_pattern(texts, "\n"))
    sign = np.isin(kind, [_CLASSES.index(x) for x in ("other_signs", "bangs", "pipes")])
    last = np.flatnonzero(sign[:-1] & np.isin(kind[1:], [_CLASSES.index(x) for x in ("spaces", "lines")])) if len(kind) else np.zeros(0, np.int64)
    signed = np.searchsorted(last, at[1:]) - np.searchsorted(last, at[:-1])
    bytes_, w = np.maximum(size, 1), np.maximum(words, 1)
    share = lambda x, n: np.log((x + 0.5) / (n + 1.0))
    columns = {
        "log_bytes": np.log1p(size),
        "marks": share(count["stops"] + count["commas"] + count["bangs"] + count["other_signs"], w),
        "word_bytes": np.log(bytes_ / w),
        "distinct_words": np.log((distinct + 0.5) / (w + 1.0)) + 0.1 * np.log1p(words),
        "repeated_lines": share(lines - distinct_lines, lines),
        "signed_words": share(signed, w),
        **{k: share(count[k], bytes_ if k in ("upper", "spaces", "non_ascii") else w) for k in _CLASSES},
    }
    return np.column_stack([columns[k] for k in FEATURES])


def measured(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Statistics of texts in turns of about TURN_BYTES, each with its first row's number."""
    for at, some in turns(pc.fill_null(texts, ""), TURN_BYTES):
        yield at, text_statistics(some)


def with_statistics(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and its ``features``."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in measured(batch.column("_text")):
                features = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(x)), features], names=["doc_id", "features"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInArrow(measure, "doc_id long, features array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Priors, means and the lower Cholesky factors of both classes; ``factors`` is None where a class had no rows."""

    prior: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.factors is None:
            return np.full(len(x), self.prior)
        log = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            log.append(-0.5 * np.einsum("ij,ij->j", z, z) - np.log(np.diag(factor)).sum())
        gap = log[1] - log[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def fit(labelled: DataFrame) -> Discriminant:
    """Fit on the columns ``features`` and ``label`` (0 or 1)."""
    p = len(FEATURES)
    cells = [(i, j) for i in range(p) for j in range(i + 1)]
    x = lambda i: F.get("features", F.lit(i))
    # the origin is moved near the data so that sums of squares keep their digits
    rows = labelled.where(F.col("label").isin(0, 1))
    sums = {r["label"]: r for r in rows.groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"), *(F.avg(x(i)).alias(f"m{i}") for i in range(p)), *(F.covar_pop(x(i), x(j)).alias(f"c{i}_{j}") for i, j in cells)).collect()}
    n = np.array([sums[c]["n"] if c in sums else 0 for c in (0, 1)], float)
    if not n.all():
        return Discriminant(float(n[1] / n.sum()) if n.sum() else 0.5)
    means, own = np.zeros((2, p)), np.zeros((2, p, p))
    for c in (0, 1):
        means[c] = [sums[c][f"m{i}"] for i in range(p)]
        for i, j in cells:
            own[c, i, j] = own[c, j, i] = sums[c][f"c{i}_{j}"]
    common = np.tensordot(n / n.sum(), own, 1)
    shrunk = (1 - TO_COMMON - TO_IDENTITY) * own + TO_COMMON * common + TO_IDENTITY * np.eye(p) * max(np.trace(common) / p, 1e-6)
    return Discriminant(float(n[1] / n.sum()), means, np.linalg.cholesky(shrunk))


def score(features: DataFrame, model: Discriminant) -> DataFrame:
    """Add ``score`` and ``predicted`` to rows of ``doc_id`` and ``features``."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            s = model.scores(x)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    return features.select("doc_id", "features").mapInArrow(measure, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: Discriminant, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``model`` predicts to be good. No shuffle."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [model.scores(x) >= 0.5 for _, x in measured(batch.column(text))]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *good])))

    return docs.mapInArrow(keep, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels are kept for testing: the checksum of its id, modulo 3, is 1."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3) == 1


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose labels may be learnt from, about TRAINING_ROWS at most, chosen by a hash of their ids. No text is shuffled."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id")).where(F.col("_id").isNotNull() & ~held_out(F.col("_id"))).distinct()
    n = known.count()
    if n > TRAINING_ROWS:
        known = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * (TRAINING_ROWS / n)))
    return docs.join(F.broadcast(known), docs["doc_id"].cast("long") == F.col("_id"), "left_semi")


def fitted(features: DataFrame, labels: DataFrame) -> Discriminant:
    """The discriminant of documents' features and the labels that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).where(~held_out(F.col("doc_id")))
    return fit(features.join(known, "doc_id"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``; only labels that aren't held out are learnt from."""
    features = checkpointed(with_statistics(docs))
    return score(features, fitted(features, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
