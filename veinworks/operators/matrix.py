"""Top-k by matrix products: a stated set of queries held against all rows, one Arrow batch at a time.

The queries come in blocks of bounded size, which the driver reads and hands to
the tasks. A task multiplies its batches with the block's matrix and keeps the
``k`` best rows of each query, so at most k rows a query and task are shuffled;
the rows themselves never move.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Scores of so many pairs lie in memory at once.
CELLS = 4_000_000
#: Queries that are scored at once: few, so that a batch has many more rows than are kept of each query.
PIECE = 512


def _leading(best: list[np.ndarray], k: int, last_id_first: bool) -> list[np.ndarray]:
    """Of (query, score, id, ...) the ``k`` best of each query: highest score, then the least id, or the greatest."""
    query, score, key = best[:3]
    code = np.unique(key, return_inverse=True)[1]
    order = np.lexsort((-code if last_id_first else code, -score, query))
    query = query[order]
    new = np.concatenate([[True], query[1:] != query[:-1]]) if len(query) else np.zeros(0, bool)
    place = np.arange(len(query)) - np.repeat(np.flatnonzero(new), np.diff(np.concatenate([np.flatnonzero(new), [len(query)]])))
    kept = order[place < k]
    return [x[kept] for x in best]


def _near_the_top(scores: np.ndarray, k: int, above: float | None) -> np.ndarray:
    """A mask of what may be among the ``k`` best of its column; all ties of the last place stay."""
    mask = np.isfinite(scores) if above is None else scores > above
    if len(scores) > k:
        mask &= scores >= np.partition(np.where(mask, scores, -np.inf), len(scores) - k, axis=0)[len(scores) - k]
    return mask


def best_rows(rows: DataFrame, score: Callable[[pa.RecordBatch], Callable[[slice], np.ndarray]], queries: list, query_type: str, k: int, key: str = "evidence_id", width: int = 0, **how) -> DataFrame:
    """(query_id, key, score, rank) of the ``k`` best rows of each query; see ``best_parts`` for ``how``.

    ``score`` takes a batch, of which it may hold ``width`` numbers a row, and gives a function that makes a matrix of the
    batch's rows by a slice of ``queries``. Rows without a key are left out.
    """
    step = max(1, CELLS // max(width, PIECE))

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, Callable[[slice], np.ndarray]]]:
        for at in range(0, batch.num_rows, step):
            some = batch.slice(at, step)
            yield some.column(key), score(some)

    return best_parts(rows.where(F.col(key).isNotNull()), parts, queries, query_type, k, key, rows.schema[key].dataType.simpleString(), **how)


def best_parts(
    rows: DataFrame, parts: Callable[[pa.RecordBatch], Iterator[tuple[pa.Array, Callable[[slice], np.ndarray]]]], queries: list, query_type: str, k: int, key: str, kind: str, above: float | None = None, last_id_first: bool = False, measure: str = "score"
) -> DataFrame:
    """The same for batches that hold any number of keys: ``parts`` yields keys and a function of their scores by a slice of ``queries``.

    NaN stands for no score, and so does what isn't above ``above``. Scores are rounded to six places before they are
    compared. Ties go to the least key, or to the greatest. A task holds the scores of PIECE queries at a time and the
    k best rows of each query, and hands these on by pieces too.
    """

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for ids, scores_of in parts(batch):
                keys = ids.to_numpy(zero_copy_only=False) if pa.types.is_integer(ids.type) else np.array(ids.to_pylist(), object)
                for at in range(0, len(queries), PIECE):
                    scores = np.round(scores_of(slice(at, at + PIECE)), 6)
                    row, query = np.nonzero(_near_the_top(scores, k, above))
                    found = [query + at, scores[row, query], keys[row]]
                    best[at] = _leading(found if at not in best else [np.concatenate(x) for x in zip(best[at], found, strict=True)], k, last_id_first)
        for at in sorted(best):
            query, score, key_of = best.pop(at)
            yield pa.RecordBatch.from_pydict({"_query": query.astype(np.int32), measure: score.astype(float), key: pa.array(key_of if key_of.dtype != object else key_of.tolist(), out)})

    out = pa.int64() if kind in ("bigint", "int", "smallint", "tinyint") else pa.string()
    chosen = rows.mapInArrow(choose, f"_query int, {measure} double, {key} {'bigint' if out == pa.int64() else 'string'}")
    names = rows.sparkSession.createDataFrame(list(enumerate(queries)), f"_query int, query_id {query_type}")
    order = Window.partitionBy("_query").orderBy(F.desc(measure), F.desc(key) if last_id_first else key)
    ranked = chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # the block's queries are bounded by its caller
    return ranked.join(F.broadcast(names), "_query").select("query_id", F.col(key).cast(kind).alias(key), measure, "rank")


def blocks(queries: DataFrame, key: str, most: int) -> Iterator[list]:
    """The rows of ``queries`` in lists of about ``most``, chosen by a hash of their key."""
    parts = max(1, -(-queries.count() // most))
    for i in range(parts):
        some = queries if parts == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i)
        yield some.collect()


def united(frames: Iterator[DataFrame]) -> DataFrame:
    out = None
    for df in frames:
        out = df if out is None else out.unionByName(df)
    return out


def vectors_of(column: pa.Array, width: int) -> np.ndarray:
    """A matrix of lists of numbers; NaN where a list is null, of another length, or holds a null."""
    lengths = np.array([width if n == width else -1 for n in column.value_lengths().to_pylist()])
    out = np.full((len(column), width), np.nan)
    right = lengths == width
    if right.any():
        out[right] = column.filter(pa.array(right)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    return out
