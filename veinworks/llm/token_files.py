"""Token ids as flat unsigned integer files with 64-bit document offsets.

A written set is a folder with three files for each partition: ``NNNNNN.ids``
(all token ids in a row, 16 or 32 bits wide as the vocabulary asks),
``NNNNNN.off`` (64-bit offsets in the whole set: where each document begins,
and where the last one ends) and ``NNNNNN.doc`` (64-bit document ids). All
are read through memory maps.

Texts are dealt to partitions by ranges of ``doc_id``, so partition order is
document order. A first pass writes ids and offsets within the partition, a
prefix sum over the partitions' counts gives the bases, and a second pass
puts the bases into the offset files. A file is written under another name
and then renamed, so a task that is run again replaces it by the same bytes.

Defined cases: a null text counts as empty and has only its end id; a null
``doc_id`` comes first and is stored as -2**63; rows that repeat are each
written; an empty table gives an empty set; columns other than ``doc_id`` and
``text`` are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinworks.llm.storage import checkpointed, shared_folder
from veinworks.llm.tokens import encoder

NULL_ID = -(2**63)
MANIFEST = "part long, documents long, ids long"
#: Bytes in which ids are copied into and out of the files.
BLOCK = 1 << 22


@dataclass(frozen=True)
class TokenFiles:
    """A written set: its folder, the width of an id in bytes, the number of partitions, and a row (part, documents, ids, base) for each."""

    folder: str
    width: int
    parts: int
    manifest: DataFrame


def _put(path: str, write) -> None:
    attempt = f"{path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.tmp"
    with open(attempt, "wb") as f:
        write(f)
    os.replace(attempt, path)


def write_token_files(df: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> TokenFiles:
    """Encode every whole text of ``df`` with the tokenizer file, append ``end_id``, and write the ids in ascending order of the documents."""
    spark = df.sparkSession
    folder = folder or shared_folder(spark, "token-files")
    width = 2 if max(encoder(tokenizer).vocabulary - 1, end_id) < 2**16 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        docs: list[np.ndarray] = []
        offsets = [np.zeros(1, np.int64)]

        def all_ids(f) -> None:
            upto = 0
            for batch in batches:
                ids, at = encoder(tokenizer).encode(batch.column("_text"))
                ids = np.insert(ids, at[1:], end_id) if len(at) > 1 else ids
                f.write(ids.astype(f"<u{width}").tobytes())
                ends = at[1:] + np.arange(1, len(at))
                offsets.append(upto + ends)
                upto += len(ids)
                docs.append(batch.column("_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False))

        _put(f"{folder}/{part:06d}.ids", all_ids)
        at = np.concatenate(offsets).astype("<i8")
        _put(f"{folder}/{part:06d}.off", lambda f: f.write(at.tobytes()))
        _put(f"{folder}/{part:06d}.doc", lambda f: f.write(np.concatenate([np.zeros(0, np.int64), *docs]).astype("<i8").tobytes()))
        yield pa.RecordBatch.from_pydict({"part": [part], "documents": [len(at) - 1], "ids": [int(at[-1])]})

    rows = df.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    dealt = rows.repartitionByRange(F.col("_id").asc_nulls_first(), F.xxhash64("_text"), F.monotonically_increasing_id()).sortWithinPartitions(F.col("_id").asc_nulls_first(), F.xxhash64("_text"))
    counts = checkpointed(dealt.mapInArrow(write, MANIFEST))
    parts = max(1, counts.count())
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = counts.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))

    def rebase(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{folder}/{row['part']:06d}.off"
                at = np.fromfile(path, "<i8")
                based = (at - at[0] + row["base"]).astype("<i8")
                _put(path, lambda f, based=based: f.write(based.tobytes()))
            yield batch

    schema = f"{MANIFEST}, base long"
    return TokenFiles(folder, width, parts, checkpointed(manifest.repartition(parts, "part").mapInArrow(rebase, schema)))


def read_token_files(spark: SparkSession, files: TokenFiles, with_ids: bool = False) -> DataFrame:
    """One row per document from the memory-mapped files: doc_id, start, n_tokens, ids_crc32, and the ids if asked for."""
    folder, width = files.folder, files.width

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("part").to_pylist():
                off = np.memmap(f"{folder}/{part:06d}.off", "<i8", "r")
                if len(off) < 2:
                    continue
                doc = np.memmap(f"{folder}/{part:06d}.doc", "<i8", "r")
                ids = np.memmap(f"{folder}/{part:06d}.ids", f"<u{width}", "r")
                at = np.asarray(off) - off[0]
                for first in range(0, len(doc), 5000):
                    last = min(first + 5000, len(doc))
                    crcs = np.zeros(last - first, np.int64)
                    for i in range(first, last):
                        c = 0
                        for k in range(at[i], at[i + 1], BLOCK):
                            c = zlib.crc32(ids[k : min(k + BLOCK, at[i + 1])].astype("<u4").tobytes(), c)
                        crcs[i - first] = c
                    some = np.asarray(doc[first:last])
                    cols = {"doc_id": pa.array(some, mask=some == NULL_ID), "start": np.asarray(off[first:last]), "n_tokens": np.diff(at[first : last + 1]), "ids_crc32": crcs}
                    if with_ids:
                        cols["ids"] = pa.array([ids[at[i] : at[i + 1]].astype(np.int32) for i in range(first, last)], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(cols)

    # the manifest is small, its files are not: a task for each
    return files.manifest.select("part").repartition(files.parts, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_files(df: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write ``df`` and read it back."""
    return read_token_files(df.sparkSession, write_token_files(df, tokenizer, end_id))
