"""Skylines: the rows that no other row dominates in any number of measures, and the choice among them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinworks.functions.storage import checkpointed

#: Pairs compared at once, rows that the driver hands to all tasks at a time, and rows a task holds before it drops dominated ones.
CELLS, BLOCK, HELD = 4_000_000, 20_000, 50_000


def dominated(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which rows of ``x`` have a row in ``by`` that is no greater in any measure and less in one."""
    out = np.zeros(len(x), bool)
    step = max(1, CELLS // max(1, len(by) * max(1, x.shape[1])))
    for at in range(0, len(x) if len(by) else 0, step):
        some = x[at : at + step, None, :]
        out[at : at + step] = ((by[None] <= some).all(2) & (by[None] < some).any(2)).any(1)
    return out


def front(x: np.ndarray) -> np.ndarray:
    """The places of the rows that no other dominates; rows with the least sums are compared first, since they rule out most."""
    order = np.argsort(x.sum(1), kind="stable")
    left = np.zeros(0, np.int64)
    for at in range(0, len(order), 2000):
        some = order[at : at + 2000]
        some = some[~dominated(x[some], x[left])]
        # a row's dominators have no greater sum, but equal sums may lie in either part when rounded
        some = some[~dominated(x[some], x[some])]
        left = np.concatenate([left[~dominated(x[left], x[some])], some])
    return left


def skyline(rows: DataFrame, low: tuple[str, ...] = (), high: tuple[str, ...] = ()) -> DataFrame:
    """The rows that no other is at least as good as in all measures and better in one: ``low`` are best small, ``high`` large. Rows with a null or NaN measure are left out.

    Each task first keeps the front of its own rows. What is left is held against itself in blocks of BLOCK rows, the
    most promising first: a block is handed to all tasks, which drop what it dominates, and later blocks are those rows
    that are still there. No task gets all rows, and the driver holds one block.
    """
    names = [f"_m{i}" for i in range(len(low) + len(high))]
    measures = [F.col(c).cast("double") for c in low] + [-F.col(c).cast("double") for c in high]
    kept = rows.select("*", *(m.alias(n) for m, n in zip(measures, names, strict=True)))
    for n in names:
        kept = kept.where(F.col(n).isNotNull() & ~F.isnan(n))

    def measured(batch: pa.RecordBatch) -> np.ndarray:
        return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])

    def own_front(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        most = HELD
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= most:
                held = reduced(held)
                most = max(HELD, 2 * sum(b.num_rows for b in held))
        yield from reduced(held)

    def reduced(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        if not held:
            return []
        table = pa.Table.from_batches(held)
        x = np.concatenate([measured(b) for b in held])
        return table.take(pa.array(np.sort(front(x)))).combine_chunks().to_batches()

    left = checkpointed(kept.mapInArrow(own_front, kept.schema).withColumn("_sum", sum((F.col(n) for n in names), F.lit(0.0))))
    done = None
    while True:
        todo = left if done is None else left.where((F.col("_sum") > done[0]) | ((F.col("_sum") == done[0]) & (F.struct(*names) > F.struct(*(F.lit(v).alias(n) for v, n in zip(done[1], names, strict=True))))))
        block = todo.select("_sum", *names).distinct().orderBy("_sum", F.struct(*names)).limit(BLOCK).collect()
        if not block:
            return left.drop("_sum", *names)
        by = np.array([[r[n] for n in names] for r in block], float)
        done = (block[-1]["_sum"], tuple(block[-1][n] for n in names))

        def drop(batches: Iterator[pa.RecordBatch], by: np.ndarray = by) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(~dominated(measured(batch), by)))

        left = checkpointed(left.mapInArrow(drop, left.schema))
