"""Packing of tokenized documents into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut at multiples of the window size. Whole windows stand
alone; the rest pieces are dealt by row number into groups of about
``GROUP_PIECES``, and every group is split into the least number of windows
of near-equal length that Karmarkar-Karp differencing finds room for: the
partial partitions with the largest imbalance are merged, the fullest window
of one with the emptiest of the other, until one is left; when a window
exceeds the capacity, the count rises by one and the group is split anew.

Groups have a bounded size whatever the keys are, so no task gets an unbounded
group. Defined cases: a null text counts as empty and has only its end id;
repeated rows are each packed; an empty table gives no pieces; of the input
only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinworks.llm.storage import checkpointed
from veinworks.llm.tokens import encoder

WINDOW = 4096
#: Pieces of a group: enough that rounding the window count up costs little, few enough for one task's moment.
GROUP_PIECES = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(df: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Encode every whole text, append ``end_id`` and cut the ids at multiples of ``window``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = encoder(tokenizer).encode(batch.column("_text"))
            doc = batch.column("_id").to_pylist()
            ids = np.insert(ids, at[1:], end_id) if len(at) > 1 else ids
            at = at + np.arange(len(at))
            rows = []
            for i, d in enumerate(doc):
                for k in range(at[i], at[i + 1], window):
                    piece = ids[k : min(k + window, at[i + 1])].astype("<u4")
                    rows.append((d, k - at[i], len(piece), zlib.crc32(piece.tobytes()), at[i + 1] - at[i], *([piece.astype(np.int32)] * with_ids)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * (5 + with_ids)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.list_(pa.int32())) for c in cols[5:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    rows = df.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    return rows.mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


def differenced(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each piece, by Karmarkar-Karp differencing into ``windows`` parts."""
    n = len(sizes)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    made = n
    heap = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        sums, nodes = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[0], nodes[0] = sizes[i], i
        heap.append((-int(sums[0]), len(heap), sums, nodes))
    heapq.heapify(heap)
    order = len(heap)
    starts = []
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums, y = a + b[::-1], y[::-1]
        nodes = np.maximum(x, y)
        both = np.flatnonzero((x >= 0) & (y >= 0))
        if len(both):
            starts.append(made)
            left.append(x[both])
            right.append(y[both])
            nodes[both] = made + np.arange(len(both))
            made += len(both)
        by_size = np.argsort(-sums, kind="stable")
        sums, nodes = sums[by_size], nodes[by_size]
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), order, sums, nodes))
        order += 1
    owner = np.full(made, -1, np.int64)
    nodes = heap[0][3]
    owner[nodes[nodes >= 0]] = np.flatnonzero(nodes >= 0)
    for start, x, y in zip(reversed(starts), reversed(left), reversed(right), strict=True):
        own = owner[start : start + len(x)]
        owner[x] = own
        owner[y] = own
    return owner[:n]


def windows_of(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each piece; none holds more than ``capacity``, and the count is the least that differencing fills."""
    windows = max(1, -(-int(sizes.sum()) // capacity), int((sizes * 2 > capacity).sum()))
    while True:
        found = differenced(sizes, windows)
        if np.bincount(found, sizes, windows).max() <= capacity:
            return found
        windows += 1


def pack(pieces: DataFrame, window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to checkpointed ``pieces``: gapless in each sequence, at most ``window`` tokens."""
    groups = max(1, -(-pieces.count() // group_pieces))
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(pdf["_group"].iloc[0])
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        whole = (pdf["length"] >= window).to_numpy()
        own = np.zeros(len(pdf), np.int64)
        if not whole.all():
            own[~whole] = windows_of(pdf.loc[~whole, "length"].to_numpy(np.int64), window)
        own[whole] = own[~whole].max(initial=-1) + 1 + np.arange(whole.sum())
        own = pd.factorize(own)[0]
        return pdf.assign(sequence_id=(group << 24) + own, offset=pdf["length"].groupby(own).cumsum() - pdf["length"])[[*columns, "sequence_id", "offset"]]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(*columns).schema) + ", sequence_id long, offset long"
    dealt = pieces.select(*columns).withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(split, schema)


def pack_documents(df: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """One row per piece of each document with its place in a sequence."""
    return pack(checkpointed(token_pieces(df, tokenizer, end_id, window)), window)
