"""Near-duplicate classes by ProbMinHash, banding and verification.

1. Texts of equal word sequences (128-bit digests) collapse to one node.
2. Each node gets a ProbMinHash signature: every weighted shingle sends points
   of a Poisson process whose rate is its weight to uniformly chosen registers,
   a register keeps the shingle of its earliest point, and a shingle stops as
   soon as its next point comes later than all registers hold. Registers of two
   texts agree with their probability Jaccard similarity J.
3. Bands of registers put nodes into buckets. With 36 bands of 8 registers, two
   texts of similarity 0.8 share a bucket but for 13 in ten thousand, and two of
   similarity 0.5 do in 13 of a hundred cases.
4. First, each member of a bucket is compared with the bucket's leader. Buckets
   whose members then lie in one class are done. Of the others, those with at
   most ``SMALL`` members are compared throughout.
5. In crowded buckets of several classes, pairs are looked up by an exact filter.
   Let cx be the share of x's weight that lies in shingles common with y. Then
   J <= 1 / (1/cx + 1/cy - 1). With all shingles in one order, rarest first, the
   first shingle that x and y have in common has a weight of at most 1 - t of x
   and of y before it, and of at most 1 - 2t/(1+t) of one of them, if J >= t. So
   every such pair meets in a shingle of x's long and y's short prefix, and a
   shared passage, which lies behind the shingles of each text's own, brings no
   pairs. Members first meet the most central text of each shingle (that of the
   least weight of its own); then members of different classes meet, unless the
   bound rules them out. Members of a shingle's largest class don't meet one
   another. Nothing is capped, and no link between different classes is lost.
6. A comparison first looks at two bits of each register (a pair is dropped if
   its estimate lies 0.16, over five standard deviations, below the threshold),
   then computes the exact probability Jaccard similarity of the weighted
   shingles. Links of 0.8 or more are joined to classes by label propagation
   with pointer jumping, each round written down; later links join classes.

Defined cases: a null text counts as empty; texts without words are copies of
each other; a text of one to four words has one shingle; rows that repeat are
members of one class; a class is named by its least non-null ``doc_id``, or by
null if it has none (``class_key`` tells such classes apart); of each class
exactly one row is ``kept``, the first of the least id (null comes last); an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinworks.llm import shingles as S
from veinworks.llm.storage import checkpointed, discard, released

THRESHOLD = 0.8
BANDS, ROWS = 36, 8
#: How far below the threshold an estimate from the registers must lie for a pair to be dropped.
SLACK = 0.16
#: Buckets of more members than this are looked up by the prefix filter.
SMALL = 24
#: A crowded shingle's rows are dealt into parts of about this many.
PART = 512
#: Long integers that hold two bits of each register.
SKETCH = -(-BANDS * ROWS // 32)
EPSILON = 1e-9


def signatures(shingle: np.ndarray, weight: np.ndarray, edges: np.ndarray, registers: int = BANDS * ROWS) -> np.ndarray:
    """A row of registers for each text: the shingle of the earliest point in each (0 for a text without shingles)."""
    rows = len(edges) - 1
    earliest = np.full(rows * registers, np.inf)
    holder = np.zeros(rows * registers, np.uint64)
    row = np.repeat(np.arange(rows), np.diff(edges))
    d, w, time = shingle, weight, np.zeros(len(shingle))
    step = np.uint64(0)
    while len(d):
        many = int(np.clip(4096 // len(d), 1, 64))
        bits = S.mixed(d[:, None] + (step + np.arange(1, many + 1, dtype=np.uint64)) * np.uint64(0xD1342543DE82EF95))
        wait = -np.log(((bits >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / w[:, None]
        at = time[:, None] + np.cumsum(wait, axis=1)
        where = row[:, None] * registers + ((S.mixed(bits) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        flat, when = where.ravel(), at.ravel()
        np.minimum.at(earliest, flat, when)
        won = np.flatnonzero(when == earliest[flat])
        holder[flat[won]] = d[won // many]
        latest = earliest.reshape(rows, registers).max(axis=1)
        time = at[:, -1]
        going = time < latest[row]
        d, w, row, time = d[going], w[going], row[going], time[going]
        step += np.uint64(many)
    return holder.reshape(rows, registers)


def _bands(registers: np.ndarray) -> np.ndarray:
    """A row of BANDS bucket names for each row of registers."""
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(registers), BANDS)).copy()
    parts = registers.reshape(len(registers), BANDS, ROWS)
    for k in range(ROWS):
        out = S.mixed(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out.astype(np.int64)


def sketched(rows: DataFrame) -> DataFrame:
    """row, doc_id, the digest (d1, d2) of the words, the bucket names ``bands``, and two bits of each register in ``sketch``."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in S.turns(batch.column("text"), least=1000):
                d1, d2 = S.sequence_digests(texts)
                word, edges = S.words(texts)
                registers = signatures(*S.weighted(*S.shingled(word, edges)))
                bands = _bands(registers)
                bits = np.zeros((len(texts), SKETCH * 64), np.uint8)
                bits[:, : 2 * BANDS * ROWS] = np.unpackbits(np.ascontiguousarray(S.mixed(registers).astype(np.uint8))[:, :, None], axis=2)[:, :, :2].reshape(len(texts), -1)
                packed = np.packbits(bits, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(at, len(texts)),
                        batch.column("doc_id").slice(at, len(texts)),
                        pa.array(d1),
                        pa.array(d2),
                        pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32), bands.ravel()),
                        pa.ListArray.from_arrays(np.arange(0, packed.size + 1, SKETCH, dtype=np.int32), packed.ravel()),
                        pa.array(np.diff(edges) > 0),
                    ],
                    names=["row", "doc_id", "d1", "d2", "bands", "sketch", "worded"],
                )

    return rows.select("row", "doc_id", "text").mapInArrow(sketch, "row long, doc_id long, d1 long, d2 long, bands array<long>, sketch array<long>, worded boolean")


def _paired(pairs: DataFrame, values: DataFrame, name: str, how: str = "inner") -> DataFrame:
    """Add ``a_<name>`` and ``b_<name>`` to pairs (a, b). A popular ``b`` makes a skewed join, which adaptive execution splits."""
    of = lambda side: values.select(F.col("node").alias(side), F.col(name).alias(f"{side}_{name}"))
    return pairs.join(of("a"), "a", how).join(of("b"), "b", how)


def _estimated(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose registers don't rule out the threshold."""

    def unlike(k: int) -> Column:
        differ = F.get("a_sketch", F.lit(k)).bitwiseXOR(F.get("b_sketch", F.lit(k)))
        return F.bit_count(differ.bitwiseOR(F.shiftright(differ, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    total = unlike(0)
    for k in range(1, SKETCH):
        total = total + unlike(k)
    # registers that differ agree in both bits one time in four
    similar = 1 - total / (BANDS * ROWS) / 0.75
    return _paired(pairs, sketches, "sketch").where(similar >= threshold - SLACK).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs of similarity ``threshold`` or more, with it."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                text = dict(zip(a, part.column("a_text").to_pylist(), strict=True)) | dict(zip(b, part.column("b_text").to_pylist(), strict=True))
                sets = {}
                nodes, all_texts = list(text), pa.array(text.values(), pa.string())
                for first, some in S.turns(all_texts):
                    h, w, e = S.weighted(*S.shingled(*S.words(some)))
                    sets.update((nodes[first + i], (h[e[i] : e[i + 1]], w[e[i] : e[i + 1]])) for i in range(len(some)))
                similar = np.array([S.probability_jaccard(sets[x], sets[y]) for x, y in zip(a, b, strict=True)])
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(similar)], names=["a", "b", "similarity"]).filter(pa.array(similar >= threshold - 1e-9))

    return _paired(pairs, texts, "text").select("a", "b", "a_text", "b_text").mapInArrow(compare, "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """node and label, the least node of its component, for every node in ``edges`` (a, b)."""
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = checkpointed(labels)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        before, moved = labels, checkpointed(hooked.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("label"), "old"))
        discard(before)
        labels = moved
        if moved.where("label <> old").isEmpty():
            return labels.select("node", "label")


def _labelled(rows: DataFrame, labels: DataFrame, node: str = "node", label: str = "label") -> DataFrame:
    """Add the label of ``node``, which is the node itself where it has no links."""
    own = labels.select(F.col("node").alias(node), F.col("label").alias("_l"))
    return rows.join(own, node, "left").withColumn(label, F.coalesce("_l", node)).drop("_l")


def joined_classes(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, label) after the classes that ``edges`` (a, b) link have become one; only labels are propagated."""
    links = checkpointed(_labelled(_labelled(edges, labels, "a", "_a"), labels, "b", "_b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b").distinct())
    if links.isEmpty():
        return labels
    up = components(links).select(F.col("node").alias("label"), F.col("label").alias("_up"))
    alone = up.select(F.col("label").alias("node"), "label").join(labels.select("node"), "node", "left_anti")
    return checkpointed(labels.select("node", "label").unionByName(alone).join(up, "label", "left").select("node", F.coalesce("_up", "label").alias("label")))


def _shingle_rows(texts: DataFrame) -> DataFrame:
    """A row for each distinct shingle of each text: node, h, its share of the text's weight, that weight, and the largest weight of a shingle."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy()
            for at, some in S.turns(batch.column("text"), S.TURN_BYTES // 4):
                h, w, edges = S.weighted(*S.shingled(*S.words(some)))
                n = np.diff(edges)
                row = np.repeat(np.arange(len(n)), n)
                total = np.bincount(row, w, len(n))
                most = np.zeros(len(n))
                np.maximum.at(most, row, w)
                yield pa.RecordBatch.from_pydict({"node": node[at + row], "h": h.view(np.int64), "share": w / total[row], "total": total[row], "most": most[row]})

    return texts.select("node", "text").mapInArrow(split, "node long, h long, share double, total double, most double")


def _prefixes(texts: DataFrame, threshold: float) -> DataFrame:
    """The long prefix of each text: node, h, ``before`` (the weight share before h), ``own`` (that of shingles no other text has), total and most."""
    rows = checkpointed(_shingle_rows(texts))
    known = rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    node = Window.partitionBy("node")
    earlier = node.orderBy("n", "h").rowsBetween(Window.unboundedPreceding, -1)
    own = 1 - F.sum("share").over(node)
    placed = rows.join(known, "h").withColumns({"own": own, "before": own + F.coalesce(F.sum("share").over(earlier), F.lit(0.0))})
    found = checkpointed(placed.where(F.col("before") <= 1 - threshold + EPSILON).select("node", "h", "before", "own", "total", "most"))
    discard(rows)
    return found


def _bounded(a: str, b: str, threshold: float) -> Column:
    """Whether the bound on the similarity of two prefix rows that meet in a shingle reaches the threshold."""

    def share(x: str, y: str) -> Column:
        # what is common weighs at most the largest weight times the other's common weight, whose weights are one or more
        other = F.col(f"{x}most") * F.col(f"{y}total") * (1 - F.col(f"{y}before")) / F.col(f"{x}total")
        return F.greatest(F.least(1 - F.col(f"{x}before"), other), F.lit(EPSILON))

    return 1 / share(a, b) + 1 / share(b, a) <= 1 + 1 / threshold + EPSILON


def _central_pairs(prefixes: DataFrame) -> DataFrame:
    """Each text with the most central text of each shingle in its prefix."""
    heads = prefixes.groupBy("h").agg(F.min(F.struct("own", "node")).alias("_head"), F.count("*").alias("_n")).where("_n > 1")
    return prefixes.join(heads.select("h", F.col("_head.node").alias("b")), "h").select(F.col("node").alias("a"), "b").where("a <> b").distinct()


def _prefix_pairs(prefixes: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different classes that meet in a shingle of their prefixes and that the bound allows."""
    rows = checkpointed(_labelled(prefixes, labels))
    # the best partner that a shingle's rows could make for each of them
    best = rows.groupBy("h").agg(F.min("before").alias("_before"), F.min("total").alias("_least"), F.max("total").alias("_total"), F.max("most").alias("_most"), F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high")
    ahead = F.least(1 - F.col("before"), F.col("most") * F.col("_total") * (1 - F.col("_before")) / F.col("total"))
    there = F.least(1 - F.col("_before"), F.col("_most") * F.col("total") * (1 - F.col("before")) / F.col("_least"))
    useful = 1 / F.greatest(ahead, F.lit(EPSILON)) + 1 / F.greatest(there, F.lit(EPSILON)) <= 1 + 1 / threshold + EPSILON
    left = checkpointed(rows.join(best, "h").where(useful).select(*rows.columns))
    counts = left.groupBy("h", "label").agg(F.count("*").alias("_k"))
    major = counts.groupBy("h").agg(F.max(F.struct("_k", "label")).alias("_major"), F.sum("_k").alias("_all"), F.count("*").alias("_classes")).where("_classes > 1")
    dealt = left.join(major.select("h", F.col("_major.label").alias("_major"), F.ceil(F.col("_all") / PART).cast("int").alias("_parts")), "h")
    side = lambda df, x, *more: df.select("h", "_part", *(F.col(c).alias(f"{x}_{c}") for c in ("node", "label", "before", "total", "most")), *more)
    few = side(dealt.where("label <> _major").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))), "a")
    all_ = side(dealt.withColumn("_part", F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int")), "b")
    met = few.join(all_, ["h", "_part"]).where((F.col("a_label") != F.col("b_label")) & _bounded("a_", "b_", threshold))
    return met.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def _classes(placed: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """node and label of the nodes that have links."""
    bands = reps.where("worded").select("node", F.explode("bands").alias("bucket"))
    led = bands.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = checkpointed(bands.join(led, "bucket").select("bucket", "node", "leader", "n"))
    texts = checkpointed(placed.select("row", "text").join(reps.join(members.select("node").distinct(), "node").select("row", "node"), "row").select("node", "text"))
    sketches = reps.select("node", "sketch")
    linked = lambda pairs: checkpointed(_verified(_estimated(pairs, sketches, threshold), texts, threshold).select("a", "b"))
    labels = components(linked(members.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()))
    released(placed.sparkSession)
    # members that the leader didn't link; with the leader there is a link to look for only if two of them are left
    labelled = _labelled(members.select("bucket", "node", "n"), labels)
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high").select("bucket")
    open_ = checkpointed(labelled.join(mixed, "bucket"))
    small, crowded = open_.where(F.col("n") <= SMALL), open_.where(F.col("n") > SMALL).select("node").distinct()
    a, b = (small.select("bucket", F.col("node").alias(x), F.col("label").alias(f"{x}_label")) for x in "ab")
    near = a.join(b, "bucket").where("a < b and a_label <> b_label").select("a", "b").distinct()
    prefixes = _prefixes(texts.join(crowded, "node"), threshold)
    first = near.unionByName(_central_pairs(prefixes)).distinct()
    labels = joined_classes(labels, linked(first))
    released(placed.sparkSession)
    labels = joined_classes(labels, linked(_prefix_pairs(prefixes, labels, threshold)))
    discard(members, texts, open_, prefixes)
    return labels


def _members(placed: DataFrame, threshold: float) -> DataFrame:
    """The class of each row of ``placed`` (row, doc_id, text), and whether it is the one that stays."""
    rows = checkpointed(sketched(placed))
    # random numbers that are unique; the least of a bucket's is its leader
    grouped = rows.groupBy("d1", "d2").agg(F.min("row").alias("row")).withColumn("node", F.xxhash64("row"))
    reps = checkpointed(rows.select("row", "bands", "sketch", "worded").join(grouped, "row"))
    labels = _classes(placed, reps, threshold)
    named = _labelled(reps.select("node", "d1", "d2"), labels)
    of = rows.select("row", "doc_id", "d1", "d2").join(named, ["d1", "d2"])
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    names = checkpointed(of.groupBy("label").agg(F.min(first).alias("first")))
    found = of.select("row", "doc_id", "label").join(names, "label")
    return found.select("row", "doc_id", F.col("first.doc_id").alias("class_id"), (F.col("row") == F.col("first.row")).alias("kept"), F.col("label").alias("class_key"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the least doc_id of its class), kept (whether it stays as the class's one) and class_key."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return _members(checkpointed(rows), threshold).drop("row")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay when each class keeps one row.

    The numbered table is written once: another scan may be split in another way, as after the loss of an executor,
    and number rows anew.
    """
    placed = checkpointed(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")))
    rows = placed.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.coalesce("doc.text", F.lit("")).alias("text"))
    kept = _members(rows, threshold).where("kept").select("row")
    return placed.join(kept, "row", "left_semi").select("doc.*")
