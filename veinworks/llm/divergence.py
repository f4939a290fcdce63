"""Source divergence audit: how the vocabulary of each source differs from those of the language's other sources.

Plain relational: terms are exploded regexp matches (texts are split at the runs
of all other characters, which gives the same strings faster); their counts by
language, source and term are crossed with the language's kept vocabulary, so that absent
terms count 0; a self-join on language and term compares sources; windows rank.

All arithmetic is exact. A group's proportion of a term is
p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), where N sums the counts of the V
kept terms; the divergence of two proportions is f = floor((p - q)^2 / (p + q)).

Sizes. Counts are aggregated in each task before they are shuffled, so a source
with a third of all rows sends one row a term and task. Groups and vocabulary
are crossed by a join on the language and a salt of the term, so that a language
is not one task. The self-join holds each pair of sources once (f is symmetric)
and is summed in each task; a key of it has as many rows as the language has
sources. The parts' rows grow with the square of the sources of a language:
that is the result.

Defined cases: null text, language and source count as ''; a group without terms
has pairs too; a language without kept terms has pairs of value 0 and no terms;
a language with one source has no pairs; ties in value rank by item in the order
of UTF-8 bytes; repeated rows count each time, as documents of their own; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinworks.llm.storage import checkpointed

#: Fixed value: runs of ASCII letters and of characters beyond ASCII; and what lies between them.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCUMENTS, SCALE, TOP_TERMS = 10, 1_000_000_000, 10
SALTS = 32

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case, all else unchanged; ``lower`` does that to texts of ASCII alone, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _CAPITALS, _SMALL))


def term_counts(docs: DataFrame) -> DataFrame:
    """``n`` occurrences of and ``df`` documents with each term, by lang and source. The empty term, which splitting leaves at a text's ends, keeps groups without terms."""
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = docs.select(text(F.col("lang")).alias("lang"), text(F.col("source")).alias("source"), F.split(ascii_lower(text(F.col("text"))), BETWEEN).alias("terms"))
    # kind 0 lists all occurrences, 1 each term of the document once
    kinds = rows.select("lang", "source", F.posexplode(F.array("terms", F.array_distinct("terms"))).alias("kind", "terms"))
    each = kinds.select("lang", "source", "kind", F.explode("terms").alias("term"))
    return each.groupBy("lang", "source", "term").agg(F.count_if(F.col("kind") == 0).alias("n"), F.count_if(F.col("kind") == 1).alias("df"))


def proportion(count: Column, total: Column, kept: Column) -> Column:
    """Exact: the product has up to 30 digits."""
    product = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", product, (total + 2 * kept).cast("decimal(20,0)")).cast("long") + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def proportions(counts: DataFrame) -> DataFrame:
    """For each group and each kept term of its language: count ``n``, the group's proportion ``p`` and the language's ``q``."""
    kept = counts.where(F.col("term") != "").groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n_lang")).where(F.col("df") >= LEAST_DOCUMENTS).select("lang", "term", "n_lang")
    vocabulary = checkpointed(kept)
    of_lang = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n_lang").alias("total_lang"))
    known = checkpointed(counts.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n"))
    groups = counts.select("lang", "source").distinct()
    totals = groups.join(known.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(of_lang, "lang")
    salted = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    crossed = vocabulary.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    dense = crossed.join(known, ["lang", "term", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return dense.select("lang", "source", "term", "n", proportion(F.col("n"), F.coalesce("total", F.lit(0)), F.col("kept")).alias("p"), proportion(F.col("n_lang"), F.col("total_lang"), F.col("kept")).alias("q"))


def source_pairs(counts: DataFrame, dense: DataFrame) -> DataFrame:
    """The divergence of each two sources of a language, summed over its kept terms; both ways."""
    a, b = (dense.select("lang", "term", F.col("source").alias(s), F.col("p").alias(p)) for s, p in (("source", "p"), ("item", "q")))
    summed = a.join(b, ["lang", "term"]).where(F.col("source") < F.col("item")).groupBy("lang", "source", "item").agg(F.sum(divergence(F.col("p"), F.col("q"))).alias("value"))
    groups = counts.select("lang", "source").distinct()
    pairs = groups.join(groups.withColumnRenamed("source", "item"), "lang").where(F.col("source") < F.col("item"))
    one_way = pairs.join(summed, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    ways = F.array(F.struct(F.col("source").alias("source"), F.col("item").alias("item")), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    return one_way.select("lang", "value", F.inline(ways)).select("lang", "source", F.lit("pair").alias("part"), "item", "value")


def distinctive_terms(dense: DataFrame) -> DataFrame:
    """The kept terms that a source has and uses more than its language does."""
    own = dense.where((F.col("n") > 0) & (F.col("p") > F.col("q")))
    return own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))


def divergence_audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank: all pairs of sources, and each source's TOP_TERMS terms."""
    counts = checkpointed(term_counts(docs))
    dense = checkpointed(proportions(counts))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = source_pairs(counts, dense).select("*", rank)
    terms = distinctive_terms(dense).select("*", rank).where(F.col("rank") <= TOP_TERMS)
    return pairs.unionByName(terms)
