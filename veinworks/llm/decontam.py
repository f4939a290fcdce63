"""Benchmark decontamination by SimHash windows, multi-index Hamming blocks and exact verification.

Words are hashed as in ``shingles``. A window's SimHash has a bit for each of
the 64 bits of its words' hashes: whether more than half of the words have it.

Documents are cut into blocks of ``g`` words (8; fewer for short items), and
windows are runs of whole blocks. Words at the ends of an occurrence may be
edited, or cut off by the document's end: at a similarity of 0.8, an item of n
shingles that don't repeat loses at most n / 5 of them, and a word at an end
takes one with it, so R = L - floor(n / 5) of the item's L words in a row are
unchanged. They hold a window of W = g * ((R - g + 1) // g) words wherever the
occurrence starts. Up to ``WHOLE_SIZES`` words W is used as it is, and all
sub-windows of W words of the item are indexed; longer ones are rounded down to
a few steps, each half again as long as the one before, so that the work on a
document doesn't grow with the number of different lengths. As rounded windows
are shorter than the unchanged run, some runs of ``g`` starts suffice: they lie
so close that every run of R words holds one of each remainder modulo g. So an
occurrence with edited ends has a window that equals an indexed one bit for bit,
and an item has a few dozen windows at most, however long it is. An edit
further inside costs five shingles and more, which only items of 41 shingles
(45 words) and more survive; there, the windows beside the edit or those within
the radius find it.

The index cuts a fingerprint into four blocks of 16 bits and lists, for each
value, the fingerprints within two bits in that block. Two fingerprints within
a radius of 11 bits differ by two or fewer in some block, so all of them are
found. Candidates within the radius are verified: the item's weighted shingles
against those of the L words from where the occurrence would start, by exact
probability Jaccard similarity of 0.8 or more.

The benchmark is dealt by a hash into slices whose items take at most
``SLICE_BYTES`` in the index, by the numbers of their windows and words; with the
tables of the steps an index stays below 64 MB. It is broadcast, and each slice
scans the documents once. With several slices, what one finds is written before
the next is built, so that one index at a time is held. A million items of 100
words are some 1,600 slices and as many scans: this is a plan for benchmarks,
which are small beside the corpus.

Defined cases: null texts count as empty; an item without words matches
nothing, one of one to four words matches those words in a row; documents that
repeat each give their matches, and so do items of equal text and other ids,
but equal rows of the benchmark count once; null ids are carried;
empty tables give no matches; other columns are kept by ``decontaminated`` and
ignored by ``matches``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinworks.llm import shingles as S
from veinworks.llm.storage import checkpointed

THRESHOLD = 0.8
#: At a similarity of THRESHOLD, an occurrence lacks at most one of so many shingles of its item.
LOSS = 5
RADIUS, BLOCK_RADIUS, BLOCKS = 11, 2, 4
GRID = 8
#: Window sizes up to this many words are not rounded; longer items have this many runs of starts at least.
WHOLE_SIZES, LEAST_RUNS = 88, 5
#: Bytes of one slice's items in the index, and of one window: 8 for the fingerprint, 16 for its place, 4 for each near value of each block.
SLICE_BYTES, WINDOW_BYTES = 32_000_000, 24 + 4 * 4 * 137
MATCHES = "doc_id long, item_id long, word_start long, n_words long, similarity double"


def _near_values() -> np.ndarray:
    """All 16-bit patterns of at most BLOCK_RADIUS bits."""
    return np.array([sum(1 << b for b in bits) for n in range(BLOCK_RADIUS + 1) for bits in combinations(range(16), n)], np.uint16)


def _bits(word: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(word).view(np.uint8).reshape(-1, 8), axis=1)


def _fingerprints(counts: np.ndarray, words: int) -> np.ndarray:
    return np.packbits(counts * 2 > words, axis=1).view(np.uint64).ravel()


def _distinct(row: np.ndarray, item: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct triples in ascending order."""
    order = np.lexsort((start, item, row))
    row, item, start = row[order], item[order], start[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] != start[:-1])
    return row[new], item[new], start[new]


def _window(length: int) -> tuple[int, int, np.ndarray]:
    """Grid, window size and the starts of the indexed windows for an item of ``length`` words."""
    run = length - max(0, length - S.SIZE + 1) // LOSS
    g = next(x for x in (GRID, 4, 2, 1) if run >= 2 * x - 1)
    size = g * ((run - g + 1) // g)
    if size > WHOLE_SIZES:
        most, size = run - max(g - 1, run // 8), WHOLE_SIZES
        while (longer := size * 3 // 2 // g * g) <= most:
            size = longer
    spare, span = run - size - (g - 1), length - size - (g - 1)
    runs = max(LEAST_RUNS, -(-span // (spare + 1)) + 1)
    if runs * g > length - size:
        return g, size, np.arange(length - size + 1)
    return g, size, np.unique(np.linspace(0, span, runs).astype(np.int64)[:, None] + np.arange(g))


def _index_bytes(words: Column) -> Column:
    """An upper estimate of what an item of so many words takes in the index: its windows, and its shingles with their weights."""
    return F.least(words / LOSS + 2 * GRID, F.lit(9 * GRID)) * WINDOW_BYTES + words * 32


class Index:
    """The items of one slice: their fingerprints by grid and window size, and their weighted shingles."""

    def __init__(self, ids: list, texts: list):
        word, at = S.words(pa.array(texts, pa.string()))
        h, w, edges = S.weighted(*S.shingled(word, at))
        self.ids = ids
        self.length = np.diff(at)
        self.any_item = np.unique(h)
        self.sets = [(h[edges[i] : edges[i + 1]], w[edges[i] : edges[i + 1]]) for i in range(len(ids))]
        found: dict[tuple[int, int], list] = {}
        for i, n in enumerate(self.length.tolist()):
            if n:
                g, size, starts = _window(n)
                bits = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_bits(word[at[i] : at[i] + n]), axis=0, dtype=np.int32)])
                own = _fingerprints(bits[starts + size] - bits[starts], size)
                found.setdefault((g, size), []).append((own, np.full(len(own), i), starts))
        self.classes = {}
        near = _near_values()
        for key, parts in found.items():
            prints, item, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
            blocks = np.ascontiguousarray(prints).view(np.uint16).reshape(-1, BLOCKS)
            lists = []
            for b in range(BLOCKS):
                value = (blocks[:, b, None] ^ near).ravel()
                order = np.argsort(value, kind="stable")
                lists.append((np.searchsorted(value[order], np.arange(2**16 + 1)).astype(np.int32), (order // len(near)).astype(np.int32)))
            self.classes[key] = (prints, item, offset, lists)

    def candidates(self, word: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Arrays of text number, item number and first word (within its text, maybe negative), of windows within the radius."""
        n = np.diff(at)
        for grid in sorted({g for g, _ in self.classes}):
            blocks = n // grid
            edges = np.concatenate([[0], np.cumsum(blocks)])
            place = np.repeat(at[:-1] - grid * edges[:-1], grid * blocks) + np.arange(grid * edges[-1])
            each = _bits(word[place]).reshape(-1, grid, 64)
            summed = each[:, 0].copy()
            for k in range(1, grid):
                summed += each[:, k]
            upto = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(summed, axis=0, dtype=np.int32)])
            row = np.repeat(np.arange(len(n)), blocks)
            nth = np.arange(edges[-1]) - edges[row]
            for (g, size), (prints, item, offset, lists) in self.classes.items():
                if g != grid:
                    continue
                first = np.flatnonzero(nth + size // g <= blocks[row])
                own = _fingerprints(upto[first + size // g] - upto[first], size)
                values = own.view(np.uint16).reshape(-1, BLOCKS)
                for b, (start, entries) in enumerate(lists):
                    v = values[:, b].astype(np.int64)
                    many = (start[v + 1] - start[v]).astype(np.int64)
                    which = np.repeat(np.arange(len(v)), many)
                    entry = entries[np.repeat(start[v] - (np.cumsum(many) - many), many) + np.arange(len(which))]
                    near = np.bitwise_count(own[which] ^ prints[entry]) <= RADIUS
                    which, entry = which[near], entry[near]
                    window = first[which]
                    yield row[window], item[entry], nth[window] * g - offset[entry]

    def matches(self, texts: pa.Array, threshold: float) -> list[tuple[int, int, int, int, float]]:
        """(text number, item number, first word, number of words, similarity) of each occurrence."""
        word, at = S.words(texts)
        found = [np.stack(x) for x in self.candidates(word, at)]
        if not found:
            return []
        row, item, start = np.concatenate(found, axis=1)
        n = np.diff(at)
        # a window that shares no shingle with any item cannot be similar to one; windows of under five words are not looked up
        shingle, edges = S.shingled(word, at)
        place = np.minimum(np.searchsorted(self.any_item, shingle), len(self.any_item) - 1)
        shared = np.concatenate([[0], np.cumsum(self.any_item[place] == shingle)])
        room = np.maximum(0, self.length - S.SIZE + 1) // LOSS
        low, high = np.maximum(start - room[item], 0), np.minimum(start + self.length[item] + room[item], n[row])
        first = edges[row] + low
        hopeful = (high - low < 2 * S.SIZE) | (shared[np.minimum(first + high - low - S.SIZE + 1, edges[row + 1])] > shared[np.minimum(first, edges[row + 1])])
        row, item, start = _distinct(row[hopeful], item[hopeful], start[hopeful])
        # at a document's ends, a window that starts elsewhere may be shorter and hold fewer edited words
        near_end = (start < room[item]) | (start + self.length[item] + room[item] > n[row])
        tries = np.where(near_end, 2 * room[item] + 1, 1)
        shift = np.arange(tries.sum()) - np.repeat(np.cumsum(tries) - tries + tries // 2, tries)
        row, item, start = _distinct(np.repeat(row, tries), np.repeat(item, tries), np.repeat(start, tries) + shift)
        low, high = np.maximum(start, 0), np.minimum(start + self.length[item], n[row])
        whole = low < high
        best: list[tuple[int, int, int, int, float]] = []
        for t, i, low, high in np.stack([row, item, low, high])[:, whole].T.tolist():
            part = word[at[t] + low : at[t] + high]
            h, w, _ = S.weighted(*S.shingled(part, np.array([0, len(part)])))
            similar = S.probability_jaccard((h, w), self.sets[i])
            if similar >= threshold - 1e-9:
                # starts that overlap the one before are the same occurrence, placed a little off
                if best and best[-1][:2] == (t, i) and low < best[-1][2] + best[-1][3]:
                    if similar > best[-1][4]:
                        best[-1] = (t, i, low, high - low, similar)
                else:
                    best.append((t, i, low, high - low, similar))
        return best


def _indexes(benchmark: DataFrame, item_id: str, text: str) -> tuple[int, Iterator[Index]]:
    """The number of slices, and their indexes as they are asked for."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("text is not null").distinct()
    size = items.select("item_id", "text", _index_bytes(F.size(F.regexp_extract_all(F.col("text"), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"), F.lit(0)))).alias("size"))
    total = size.agg(F.sum("size")).first()[0] or 0
    slices = max(1, -(-int(total) // SLICE_BYTES))
    # a hash deals unevenly: add slices until the largest fits, or holds one item
    while slices > 1:
        largest = size.groupBy(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices))).agg(F.sum("size").alias("size"), F.count("*").alias("n")).where("n > 1").agg(F.max("size")).first()[0] or 0
        if largest <= 1.25 * SLICE_BYTES:
            break
        slices += -(-slices // 4)

    def built() -> Iterator[Index]:
        for k in range(slices):
            rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).orderBy("item_id", "text").collect()
            if rows:
                yield Index([r["item_id"] for r in rows], [r["text"] for r in rows])

    return slices, built()


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per occurrence: doc_id, item_id, word_start, n_words and similarity."""
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    found = _found(rows, benchmark, threshold)
    return found if found is not None else docs.sparkSession.createDataFrame([], MATCHES)


def _found(rows: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame | None:
    """The matches of rows (_id, _text), slice by slice; none without items."""
    spark = rows.sparkSession
    out = None
    slices, indexes = _indexes(benchmark, "item_id", "text")
    for index in indexes:
        shared = spark.sparkContext.broadcast(index)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                ids = batch.column("_id").to_pylist()
                for at, texts in S.turns(batch.column("_text")):
                    if found := own.matches(texts, threshold):
                        t, i, low, n, similar = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array([ids[at + x] for x in t], pa.int64()), pa.array([own.ids[x] for x in i], pa.int64()), pa.array(low, pa.int64()), pa.array(n, pa.int64()), pa.array(similar, pa.float64())], names=["doc_id", "item_id", "word_start", "n_words", "similarity"])

        own = rows.mapInArrow(find, MATCHES)
        if slices > 1:
            own = checkpointed(own)
            shared.destroy()
        out = own if out is None else out.unionByName(own)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item of ``benchmark`` occurs.

    One slice needs no shuffle; for several, the rows are numbered and written once, and those found are left out at the end.
    """
    spark = docs.sparkSession
    slices, indexes = _indexes(benchmark, "item_id", "text")
    if slices > 1:
        placed = checkpointed(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")))
        rows = placed.select(F.col("row").alias("_id"), F.coalesce(F.col("doc")[text], F.lit("")).alias("_text"))
        found = _found(rows, benchmark, threshold).select(F.col("doc_id").alias("row"))
        return placed.join(found, "row", "left_anti").select("doc.*")
    for index in indexes:
        shared = spark.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for at, texts in S.turns(pc.fill_null(batch.column(text), "")):
                    clean[[at + x[0] for x in shared.value.matches(texts, threshold)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
