"""Shards by jump consistent hashing.

The key's shard follows from the key and the number of shards alone, without
a ring table; when a shard is appended, keys move only into it. The key is
the first 60 bits of the MD5 of the key's text, and the generator is the
64-bit linear congruential one of the published algorithm, computed in two
32-bit halves so that no step overflows a long.

Defined cases: a null key counts as the empty text; a null text has no bytes
and the checksum of none; repeated rows share a shard and get slots of their
own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinworks.llm.storage import checkpointed

#: Fixed value: the multiplier of the published generator.
MULTIPLIER = 2862933555777941757
LOW = 0xFFFFFFFF
#: Equal rows that one task makes at a time.
PART = 1_000_000


def stable_key(key: Column) -> Column:
    """A non-negative long from the key's text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _times(a: Column, b: int) -> Column:
    """The low 32 bits of ``a * b`` for 32-bit halves."""
    low, high = a.bitwiseAND(F.lit(0xFFFF)) * b, F.shiftrightunsigned(a, 16) * b
    return (low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(LOW))


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """``(hi:lo) * MULTIPLIER + 1`` modulo 2**64."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & LOW
    p0 = lo.bitwiseAND(F.lit(0xFFFF)) * m_lo
    p1 = F.shiftrightunsigned(lo, 16) * m_lo
    low = p0.bitwiseAND(F.lit(LOW)) + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16) + 1
    high = F.shiftrightunsigned(p0, 32) + F.shiftrightunsigned(p1, 16) + F.shiftrightunsigned(low, 32) + _times(hi, m_lo) + _times(lo, m_hi)
    return high.bitwiseAND(F.lit(LOW)), low.bitwiseAND(F.lit(LOW))


def jump_shards(key: Column, *shards: int) -> Column:
    """A struct with the shard of ``key`` for each number of shards, as ``s<number>``; one walk serves all."""
    most = max(shards)
    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(LOW)).alias("lo"), F.lit(0).cast("long").alias("j"), *(F.lit(0).cast("long").alias(f"s{n}") for n in shards))

    def walk(state: Column, _: Column) -> Column:
        j = state["j"]
        hi, lo = _step(state["hi"], state["lo"])
        jumped = F.floor((j + 1) * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(hi, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), jumped.alias("j"), *(F.when(j < n, j).otherwise(state[f"s{n}"]).alias(f"s{n}") for n in shards))
        return F.when(j < most, moved).otherwise(state)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, walk)
    return F.transform(F.array(end), lambda e: F.struct(*(e[f"s{n}"].cast("int").alias(f"s{n}") for n in shards)))[0]


def assign_shards(df: DataFrame, shards: int, key: str = "doc_id", to: str = "shard", grown_to: str = "grown_shard") -> DataFrame:
    """``df`` with each row's shard, and its shard if one more were appended."""
    found = df.withColumn("_jump", jump_shards(stable_key(F.col(key)), shards, shards + 1))
    return found.withColumns({to: F.col(f"_jump.s{shards}"), grown_to: F.col(f"_jump.s{shards + 1}")}).drop("_jump")


def shard_slots(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its size and checksum, its shard, and its slot there, gapless from 0.

    Slots follow the order (first digit of the key's MD5, top bits of the
    checksum, MD5, checksum, size). Equal rows are counted before they are
    dealt; ranks are counted in cells of a shard, and prefix sums over the
    cells' counts give each cell's base, so no task gets a whole shard.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = df.select(F.col(key).alias("doc_id"), (F.octet_length(raw).cast("long") + 8).alias("size"), F.crc32(raw).alias("text_crc32"))
    counted = slim.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_copies"))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    placed = checkpointed(assign_shards(counted, shards).withColumns({"_md5": digest, "_a": F.substring(digest, 1, 1), "_b": F.shiftright("text_crc32", 27)}))
    cell = Window.partitionBy("shard", "_a", "_b").orderBy("_md5", "text_crc32", "size")
    ranked = placed.withColumn("_end", F.sum("_copies").over(cell.rowsBetween(Window.unboundedPreceding, 0)))
    cells = placed.groupBy("shard", "_a", "_b").agg(F.sum("_copies").alias("_n"))
    base = cells.withColumn("_base", F.sum("_n").over(Window.partitionBy("shard").orderBy("_a", "_b")) - F.col("_n")).drop("_n")
    found = ranked.join(base, ["shard", "_a", "_b"])
    found = found.withColumn("_first", F.col("_base") + F.col("_end") - F.col("_copies"))
    if (placed.agg(F.max("_copies")).first()[0] or 0) > PART:
        # very many equal rows are dealt out before they are made
        parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(PART).cast("long"))).alias("_from")
        found = found.select("*", parts).withColumns({"_first": F.col("_first") + F.col("_from"), "_copies": F.least(F.col("_copies") - F.col("_from"), F.lit(PART))}).repartition("shard", "_first")
    slots = F.explode(F.sequence("_first", F.col("_first") + F.col("_copies") - 1)).alias("slot")
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slots, "grown_shard")


def write_shards(df: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """Write ``df`` as Parquet, one folder for each shard."""
    assign_shards(df, shards, key).drop("grown_shard").write.partitionBy("shard").parquet(path)
