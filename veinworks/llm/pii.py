"""Personal data by fixed rules and by bootstrapped contextual extraction, in DataFrame functions only.

Base spans are the leftmost non-overlapping matches of each kind's rule that
pass its test (``KINDS``). They seed the bootstrap: a seed's neighbouring words
make lexical patterns (the two words before it; the word before and the word
after), digits written as 0. Candidates are white-space separated chunks that
hold a digit, ``@``, ``_`` or an inner ``(`` and overlap no base span. Patterns and
instances (distinct seed and candidate strings) form a graph; in each round,
for each kind,

    confidence of a pattern   = mean of its instances' beliefs * (1 - 2 ** -sum of beliefs)
    belief in a candidate     = 1 - product over its patterns of (1 - confidence)

where a seed's belief is 1 for its kind and 0 for others, and a pattern without
``SUPPORT`` distinct seeds of the kind has none. After a round, candidates with
a belief of ``ACCEPT`` or more become seeds of their best kind, so that their
contexts make patterns that reach further candidates; the seeds of a round are
told anew by the next. After ``ROUNDS`` rounds, each written down, the seeds
that aren't base spans become spans.

The rules are written with look-behinds and possessive quantifiers, which find
the same matches as the plain ones but never scan a run of characters twice.
Offsets are code points, ends exclusive; they are sums over the parts between
matches, taken by a window over one document's matches.

Defined cases: a null text counts as empty; empty texts have no spans; a null
``doc_id`` is carried; rows that repeat each give a row; an empty table gives
none; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinworks.llm.storage import checkpointed

SUPPORT, ACCEPT, ROUNDS = 3, 0.9, 6

#: Kinds in the order in which they are listed, and their rules.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A chunk that holds a digit, ``@``, ``_``, or a bracket after other characters.
CANDIDATE = r"(?<!\S)(?:[^\s0-9@_(]++\(|[^\s0-9@_]*+[0-9@_])\S*+"
#: What a text must contain for a rule to be tried.
HINTS = {"email": "@", "phone": "+"}


def _luhn(digits: Column) -> Column:
    worth = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)).otherwise(d.cast("int")))
    return F.aggregate(worth, F.lit(0), lambda s, d: s + d) % 10 == 0


def _passes(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.char_length(digits)
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
        return found.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(digits)).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _tail(gap: Column) -> Column:
    """The last two words of a gap and the last one."""
    end = F.when(F.char_length(gap) > 200, F.right(gap, F.lit(200))).otherwise(gap)
    words = F.filter(F.split(F.regexp_replace(F.lower(end), "[0-9]", "0"), r"\s+"), lambda w: w != "")
    return F.struct(F.when(F.size(words) > 1, F.array_join(F.slice(words, F.size(words) - 1, 2), " ")).alias("two"), F.try_element_at(words, F.lit(-1)).alias("one"))


def _head(gap: Column) -> Column:
    return F.try_element_at(F.filter(F.split(F.regexp_replace(F.lower(F.left(gap, F.lit(200))), "[0-9]", "0"), r"\s+"), lambda w: w != ""), F.lit(1))


def _matches(text: Column, rule: str, hint: str | None) -> Column:
    """An array with a struct for each match: the string, the length of the gap before it, and the words around it; null without a match."""
    gaps, found = F.split(text, F.lit(rule), -1), F.regexp_extract_all(text, F.lit(rule), F.lit(0))
    both = F.transform(F.arrays_zip(found.alias("f"), gaps.alias("g"), F.slice(gaps, 2, F.size(gaps)).alias("h")), lambda x: F.when(x["f"].isNotNull(), F.struct(x["f"].alias("value"), F.char_length(x["g"]).alias("gap"), _tail(x["g"]).alias("before"), _head(x["h"]).alias("after"))))
    there = text.rlike(rule) if hint is None else F.contains(text, F.lit(hint)) & text.rlike(rule)
    return F.when(there, F.filter(both, lambda m: m.isNotNull()))


def found_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows (row, doc_id), and all matches (row, kind, start, end, value, two, one, after); the kind of chunks with a digit is null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rules = KINDS | {"chunk": CANDIDATE}
    raw = checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), *(_matches(text, rule, HINTS.get(kind)).alias(kind) for kind, rule in rules.items())))
    by_kind = [raw.where(F.col(kind).isNotNull()).select("row", F.lit(kind).alias("kind"), F.posexplode(kind).alias("n", "m")) for kind in rules]
    all_ = by_kind[0]
    for more in by_kind[1:]:
        all_ = all_.unionByName(more)
    upto = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.char_length("m.value")).over(upto)
    passes = F.lit(True)
    for kind in KINDS:
        passes = F.when(F.col("kind") == kind, _passes(kind, F.col("m.value"))).otherwise(passes)
    spans = all_.withColumn("end", end).where(passes).select(
        "row", F.when(F.col("kind") != "chunk", F.col("kind")).alias("kind"), (F.col("end") - F.char_length("m.value")).alias("start"), "end", F.col("m.value").alias("value"), F.col("m.before.two").alias("two"), F.col("m.before.one").alias("one"), F.col("m.after").alias("after")
    )
    return raw.select("row", "doc_id"), checkpointed(spans)


def unseen_spans(spans: DataFrame) -> DataFrame:
    """The candidates that high-confidence patterns discover: row, kind, start, end."""
    order = Window.partitionBy("row").orderBy("start")
    base_end = F.max(F.when(F.col("kind").isNotNull(), F.col("end"))).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    base_start = F.min(F.when(F.col("kind").isNotNull(), F.col("start"))).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    free = checkpointed(
        spans.withColumns({"_before": base_end, "_after": base_start})
        .where("kind is not null or ((_before is null or _before <= start) and (_after is null or _after >= end))")
        .select("row", "kind", "start", "end", F.xxhash64(F.coalesce("kind", F.lit("")), "value").alias("instance"), F.array_compact(F.array(F.when(F.col("two").isNotNull(), F.xxhash64(F.lit("two"), "two")), F.when(F.col("one").isNotNull() & F.col("after").isNotNull(), F.xxhash64(F.lit("around"), "one", "after")))).alias("patterns"))
    )
    graph = checkpointed(free.select("instance", "kind", F.explode("patterns").alias("pattern")).distinct())
    found = bootstrapped(graph)
    return free.where("kind is null").drop("kind").join(found.select("instance", "kind"), "instance").select("row", "kind", "start", "end")


def bootstrapped(graph: DataFrame) -> DataFrame:
    """The candidates that become seeds (instance, kind, belief), from edges (instance, kind, pattern) with a null kind for candidates."""
    size = checkpointed(graph.groupBy("pattern").agg(F.count("*").alias("size")))
    seeded = checkpointed(graph.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").cast("double").alias("seeds")))
    candidates = graph.where("kind is null").select("instance", "pattern")
    told, seeds = seeded.withColumn("sum", F.col("seeds")), None
    for _ in range(ROUNDS):
        sure = told.where(F.col("seeds") >= SUPPORT).join(size, "pattern").select("pattern", "kind", F.least(F.lit(1 - 1e-9), F.col("sum") / F.col("size") * (1 - F.pow(F.lit(2.0), -F.col("sum")))).alias("confidence"))
        beliefs = checkpointed(candidates.join(sure, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("belief")))
        best = beliefs.groupBy("instance").agg(F.max(F.struct("belief", "kind")).alias("best"))
        seeds = checkpointed(best.where(F.col("best.belief") >= ACCEPT).select("instance", "best.kind", "best.belief"))
        chosen = seeds.select("instance", "kind", F.lit(1.0).alias("seed"))
        more = candidates.join(beliefs, "instance").join(chosen, ["instance", "kind"], "left").groupBy("pattern", "kind").agg(F.sum("belief").alias("_sum"), F.sum(F.coalesce("seed", F.lit(0.0))).alias("_seeds"))
        told = seeded.join(more, ["pattern", "kind"], "full").select("pattern", "kind", (F.coalesce("seeds", F.lit(0.0)) + F.coalesce("_seeds", F.lit(0.0))).alias("seeds"), (F.coalesce("seeds", F.lit(0.0)) + F.coalesce("_sum", F.lit(0.0))).alias("sum"))
    return seeds


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base spans, the digest of their list, and the list of all spans with those discovered."""
    rows, spans = found_spans(docs)
    base = spans.where("kind is not null").select("row", "kind", "start", "end", F.lit(True).alias("base"))
    all_ = base.unionByName(unseen_spans(spans).withColumn("base", F.lit(False)))
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    named = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    listed = all_.groupBy("row").agg(
        *(F.count(F.when(F.col("base") & (F.col("kind") == k), True)).alias(f"n_{k}") for k in KINDS),
        F.array_sort(F.collect_list(F.struct("start", place.alias("place"), "end", named.alias("name"), "base"))).alias("all"),
    )
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: s["name"]), ",")
    none = F.array().cast("array<struct<start:bigint,place:bigint,end:bigint,name:string,base:boolean>>")
    found = rows.join(listed, "row", "left").withColumn("all", F.coalesce("all", none))
    return found.select(
        "doc_id",
        *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.filter("all", lambda s: s["base"])), 256).alias("base_sha256"),
        joined(F.col("all")).alias("spans"),
    )
