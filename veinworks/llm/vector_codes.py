"""Product quantisation of vectors with integer codebooks, assigned by partial-distance search.

A component x becomes floor(1024 x). Vectors are cut into PARTS equal runs of
components; each run is coded by the nearest of at most ENTRIES entries of its
codebook (squared Euclidean distance, ties to the lower index). A codebook
starts as the runs of the rows with the smallest ids; each of ROUNDS rounds
assigns all rows and replaces an entry by floor(sum / count) of its runs.

Partial-distance search: for each run, dimensions are taken in descending
variance of the codebook. After the first few, the entry that leads so far is
measured in full; that complete distance is the bound. Each further dimension
adds its squares to the pairs of row and entry that remain, and pairs whose
accumulated distance strictly exceeds the row's bound are dropped by a mask, so
the nearest entry and all its ties stay to the end. Equal rows of a batch are
measured once.

All sums are integers, so results do not depend on the order of rows or tasks.
A round is one aggregation: each task sums its own rows for each entry, so at
most PARTS x ENTRIES rows a task are shuffled and as many are collected.

Defined cases: rows whose vector is null or holds null or non-finite components
are dropped; with fewer than ENTRIES rows the codebooks are smaller; an entry
without rows stays; components beyond +-LIMIT are clamped, so that distances fit
in 64 bits (+-65,536 before scaling, for vectors of up to 512 components);
vectors that are shorter than the longest kept one, or whose length 4 doesn't
divide, are filled up with zeros; rows with a null id come last, equal ids in
the order of their vectors; an empty table gives no rows; other columns are not
returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinworks.llm.storage import checkpointed

SCALE, PARTS, ENTRIES, ROUNDS, LIMIT = 1024, 4, 256, 4, 1 << 26
#: Dimensions summed for all entries before the first bound is known.
FIRST = 2
#: Rows measured at a time: rows x ENTRIES distances of 8 bytes lie in memory.
BLOCK = 2048


def integer_components(vectors: pa.Array, width: int) -> np.ndarray:
    """A row of ``width`` integers for each list."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    scaled = np.clip(np.floor(SCALE * values), -LIMIT, LIMIT).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(scaled)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = scaled
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each row's nearest entry, the lowest of equals, and its squared distance."""
    best, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    order = np.argsort(-((book - book.mean(0)) ** 2).sum(0), kind="stable")
    x, book = x[:, order], book[:, order]
    for at in range(0, len(x), BLOCK):
        some = x[at : at + BLOCK]
        upto = np.zeros((len(some), len(book)), np.int64)
        for d in range(min(FIRST, x.shape[1])):
            upto += (some[:, d, None] - book[None, :, d]) ** 2
        leader = upto.argmin(1)
        bound = ((some - book[leader]) ** 2).sum(1)
        row, entry = np.nonzero(upto <= bound[:, None])
        left = upto[row, entry]
        for d in range(FIRST, x.shape[1]):
            left = left + (some[row, d] - book[entry, d]) ** 2
            near = left <= bound[row]
            row, entry, left = row[near], entry[near], left[near]
        # what remains is complete: the least distance, then the lowest index
        by = np.lexsort((entry, left, row))
        first = by[np.unique(row[by], return_index=True)[1]]
        best[at : at + BLOCK], distance[at : at + BLOCK] = entry[first], left[first]
    return best, distance


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances (rows x PARTS) of whole vectors; ``books`` is PARTS x entries x components."""
    width = books.shape[2]
    codes, distances = np.zeros((len(x), PARTS), np.int64), np.zeros((len(x), PARTS), np.int64)
    for part in range(PARTS):
        runs, of = np.unique(x[:, part * width : (part + 1) * width], axis=0, return_inverse=True)
        code, distance = nearest(runs, books[part])
        codes[:, part], distances[:, part] = code[of.ravel()], distance[of.ravel()]
    return codes, distances


def kept(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, vector and label of the rows whose vector is whole; written to the shared folder."""
    v = F.col(embedding)
    whole = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return checkpointed(vectors.where(whole).select(F.col(vec_id).cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"), F.col(label).alias("label")))


def first_books(rows: DataFrame, width: int) -> np.ndarray:
    """PARTS codebooks of the rows with the smallest ids."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()
    x = integer_components(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), width * PARTS)
    return x.reshape(len(x), PARTS, width).transpose(1, 0, 2).copy()


def moved_books(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all rows."""
    entries, width = books.shape[1:]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(PARTS * entries, np.int64), np.zeros((PARTS * entries, width), np.int64)
        for batch in batches:
            x = integer_components(batch.column("vector"), width * PARTS)
            cell = assigned(x, books)[0] + np.arange(PARTS) * entries
            for part in range(PARTS):
                np.add.at(total, cell[:, part], x[:, part * width : (part + 1) * width])
            count += np.bincount(cell.ravel(), minlength=len(count))
        used = np.flatnonzero(count)
        columns = {"cell": used.astype(np.int32), "n": count[used]} | {f"s{d}": total[used, d] for d in range(width)}
        yield pa.RecordBatch.from_pydict(columns)

    schema = "cell int, n long, " + ", ".join(f"s{d} long" for d in range(width))
    sums = rows.select("vector").mapInArrow(add, schema).groupBy("cell").agg(F.sum("n").alias("n"), *(F.sum(f"s{d}").alias(f"s{d}") for d in range(width)))
    moved = books.copy().reshape(PARTS * entries, width)
    for r in sums.collect():
        moved[r["cell"]] = [r[f"s{d}"] // r["n"] for d in range(width)]
    return moved.reshape(books.shape)


def trained(rows: DataFrame) -> np.ndarray | None:
    """The codebooks after ROUNDS rounds; None for an empty table. ``rows`` is that of ``kept``."""
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return None
    books = first_books(rows, -(-longest // PARTS))
    for _ in range(ROUNDS):
        books = moved_books(rows, books)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of each row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexed = np.array([f"{k:02x}" for k in range(ENTRIES)])
        for batch in batches:
            codes, distances = assigned(integer_components(batch.column("vector"), books.shape[2] * PARTS), books)
            code = ["".join(x) for x in hexed[codes].tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(distances.sum(1))], names=["vec_id", "label", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(encode, f"vec_id long, label {label}, code string, error long")


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each kept row."""
    rows = kept(vectors)
    books = trained(rows)
    if books is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    codes = checkpointed(coded(rows, books))
    by_label = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
