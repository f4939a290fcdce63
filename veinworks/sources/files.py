"""Readers and writers: records, manifests, layers, caches and resumable runs.

All are DataFrame jobs over paths that Spark can read; writers rely on Spark's
committer, so a result appears whole or not at all.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_records(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """One JSON object per line; blank lines are skipped. Strict reading fails on a malformed line, else it is dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of lines that hold no JSON object."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.col("value").alias("line"))
    return lines.where("trim(line) <> ''").where(F.from_json("line", "map<string,string>").isNull())


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; a byte order mark before the first name is dropped, and fields are trimmed."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*(F.trim(F.col(f"`{c}`")).alias(c.removeprefix("﻿").strip()) for c in raw.columns))


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def repeated_ids(layers: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(layer, id, rows) for ids that occur more than once, over layers given as (rows, id column)."""
    out = None
    for name, (rows, key) in layers.items():
        found = rows.groupBy(F.col(key).cast("string").alias("id")).agg(F.count("*").alias("rows")).where("rows > 1").select(F.lit(name).alias("layer"), "id", "rows")
        out = found if out is None else out.unionByName(found)
    return out


def require_empty(violations: DataFrame, what: str) -> None:
    """Raise where a table of violations has rows; the message shows a few."""
    some = violations.take(5)
    if some:
        raise ValueError(f"{what}: {[r.asDict() for r in some]}")


def lookup(pages: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The pages whose keys are wanted."""
    return pages.join(wanted.select(*keys).distinct(), keys, "left_semi")


def cache_key(*parts) -> Column:
    """The SHA-256 of a request's canonical JSON."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def read_through(requests: DataFrame, cache: DataFrame, compute, key: str = "key") -> DataFrame:
    """Answers for all requests, with where they come from: CACHE for keys that ``cache`` holds, else MODEL.

    ``compute`` takes the distinct missing requests and returns (key, response).
    """
    held = requests.join(cache.select(key, "response"), key).withColumn("origin", F.lit("CACHE"))
    missing = requests.join(cache.select(key), key, "left_anti")
    made = missing.join(compute(missing.dropDuplicates([key])).select(key, "response"), key).withColumn("origin", F.lit("MODEL"))
    return held.unionByName(made)


def last_of_run(rows: DataFrame, fingerprint: str, keys: list[str], position: str = "position") -> DataFrame:
    """Rows written under a protocol, the last of each key."""
    order = Window.partitionBy(*keys).orderBy(F.desc(position))
    return rows.where(F.col("fingerprint") == fingerprint).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


#: Decisions of released records.
RELEASED = ("silver_candidate", "accepted_silver")


def released(records: DataFrame, key: str = "evidence_id", position: tuple[str, ...] = ("_file", "_position")) -> DataFrame:
    """Released records (decision, eligible, inferred) with a key, the first of each key by position.

    Only the least position of a key is shuffled, not its rows, so a key may be repeated any number of times.
    """
    fine = records.where(F.col("decision").isin(*RELEASED) & F.coalesce("eligible", F.lit(False)) & ~F.coalesce("inferred", F.lit(False)) & (F.coalesce(F.col(key), F.lit("")) != ""))
    place = F.struct(*position)
    first = fine.groupBy(key).agg(F.min(place).alias("_first"))
    return fine.join(first, key).where(place == F.col("_first")).drop("_first")


#: Rows of a partition.
PART_ROWS = 200_000


def valid_prefix(rows: DataFrame, key: str, position: str, version: str, digest: str) -> DataFrame:
    """What an interrupted run of each document left that may be kept: rows (key, position, page, readable, version, digest) before the first unreadable one.

    A document whose readable prefix holds a row of another version or digest, or a page twice, is begun anew. Rows are
    shuffled once, by document, into partitions of PART_ROWS on average, so that no task's share grows with the table.
    """
    rows = rows.repartition(max(1, -(-rows.count() // PART_ROWS)), key)
    broken = rows.where(~F.col("readable")).groupBy(key).agg(F.min(position).alias("_break"))
    prefix = rows.join(broken, key, "left").where(F.col("_break").isNull() | (F.col(position) < F.col("_break"))).drop("_break")
    other = ~(F.col("version").eqNullSafe(F.lit(version)) & F.col("digest").eqNullSafe(F.col(digest) if digest in rows.columns else F.lit(digest)))
    bad = prefix.groupBy(key, "page").agg(F.count("*").alias("_n"), F.bool_or(other).alias("_other")).where((F.col("_n") > 1) | F.col("_other")).select(key).distinct()
    return prefix.join(bad, key, "left_anti")


def document_table(spark: SparkSession, path: str, at: str, fields: str) -> DataFrame:
    """A dimension table from one JSON document: the list or the map of objects at ``at`` (such as $.faults), with ``fields`` as DDL; entries of a map get their name as ``key``.

    The document is read as VARIANT, so members that ``fields`` lacks do no harm; a missing list gives no rows.
    """
    text = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("_v"))
    entries = text.select(F.try_variant_get("_v", at, "variant").alias("_e")).where(F.col("_e").isNotNull())
    entries.createOrReplaceTempView("_document_entries")
    each = spark.sql("SELECT e.key, e.pos, e.value FROM _document_entries, LATERAL variant_explode(_e) AS e")
    schema = StructType.fromDDL(fields)
    columns = [F.try_variant_get("value", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in schema]
    return each.orderBy("pos").select("key", *columns)


def still_to_do(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs without a finished row of the same keys (such as document, page, parser version and checksum)."""
    return inputs.join(done.select(*keys).distinct(), keys, "left_anti")


def integrity(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Mismatches of files' sizes and SHA-256 with a manifest of (name, bytes, sha256)."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "length", F.sha2("content", 256).alias("digest"))
    joined = manifest.join(files, "name", "left")
    problems = F.array_compact(F.array(F.when(F.col("length").isNull(), "missing"), F.when(F.col("length") != F.col("bytes").cast("long"), "bytes"), F.when(F.col("digest") != F.col("sha256"), "sha256")))
    return joined.select("name", problems.alias("problems")).where(F.size("problems") > 0)
