"""Ranking metrics, latency tables, paired comparisons, Pareto fronts and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinworks.functions.numbering import numbered
from veinworks.functions.storage import checkpointed
from veinworks.operators.quantiles import MOST, exact_quantiles
from veinworks.operators.skyline import skyline


#: Draws that one task makes, and how many clusters may be sent to every task whole.
DRAWS, SENT = 1_000_000, 100_000


def ranking_metrics(ranked: DataFrame, relevant: DataFrame | tuple[DataFrame, DataFrame], k: int) -> DataFrame:
    """Per query: recall, reciprocal rank and nDCG over the first ``k`` rows.

    ``ndcg`` has as ideal the rows that could be relevant among those returned; queries without relevant rows are left out.
    ``relevant`` holds the pairs, or the numbers of relevant rows and those that are ranked (see ``relevant_by_key``).
    """
    wanted, relevant = relevant if isinstance(relevant, tuple) else (relevant.groupBy("query_id").agg(F.count("*").alias("wanted")), relevant)
    top = ranked.where(F.col("rank") <= k)
    judged = top.join(relevant.select("query_id", "evidence_id", F.lit(1).alias("hit")), ["query_id", "evidence_id"], "left")
    gained = judged.groupBy("query_id").agg(F.count("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum(F.when(F.col("hit") == 1, 1 / F.log2(F.col("rank") + 1))).alias("dcg"), F.count("*").alias("returned"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("wanted", "returned")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    joined = wanted.join(gained, "query_id", "left").withColumns({"returned": F.coalesce("returned", F.lit(0)), "hits": F.coalesce("hits", F.lit(0)), "dcg": F.coalesce("dcg", F.lit(0.0))})
    return joined.select("query_id", F.round(F.col("hits") / F.col("wanted"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.when(F.col("returned") > 0, F.col("dcg") / ideal).otherwise(0.0), 6).alias("ndcg"))


def relevant_by_key(asked: DataFrame, rows: DataFrame, ranked: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(query_id, wanted) and (query_id, evidence_id): how many rows are relevant to each query, and those of them that are ranked.

    Relevant are all other rows (evidence_id, ``key``) with the query's key (query_id, ``key``), ids being unique. They are
    counted by key and never paired, as their pairs grow with the square of a key's rows.
    """
    held = rows.where(F.col(key).isNotNull())
    counts = held.groupBy(key).agg(F.count("*").alias("_n"))
    own = held.select(F.col("evidence_id").alias("query_id"), F.col(key).alias("_own"))
    wanted = asked.join(counts, key).join(own, "query_id", "left").withColumn("wanted", F.col("_n") - F.coalesce((F.col("_own") == F.col(key)).cast("int"), F.lit(0)))
    met = ranked.select("query_id", "evidence_id").distinct().join(asked, "query_id").join(held.select("evidence_id", F.col(key).alias("_own")), "evidence_id")
    hits = met.where((F.col("_own") == F.col(key)) & (F.col("query_id") != F.col("evidence_id")))
    return wanted.where("wanted > 0").select("query_id", "wanted"), hits.select("query_id", "evidence_id")


def query_records(runs: DataFrame, ranked: DataFrame, relevant: DataFrame | tuple[DataFrame, DataFrame], candidates: DataFrame) -> DataFrame:
    """Per method and query with relevant rows, over its first run: recall, mrr, ndcg, families, redundancy and pairwise overlap of ends.

    ``runs`` (method, query_id, run) and ``ranked`` (method, query_id, run, rank, evidence_id) hold all runs; the first is
    the one of least ``run``. A run without rows scores 0. ``candidates`` holds evidence_id, claim_id, family_id and the
    array ``ends``; rows it lacks count for recall and rank, but not for families, claims and overlaps. ``relevant`` holds
    the pairs, or the numbers of relevant rows and those that are ranked (see ``relevant_by_key``).
    """
    keys = ["method", "query_id"]
    first = runs.groupBy(*keys).agg(F.min("run").alias("run"))
    wanted, relevant = relevant if isinstance(relevant, tuple) else (relevant.groupBy("query_id").agg(F.countDistinct("evidence_id").alias("wanted")), relevant)
    rows = first.join(wanted, "query_id").join(ranked, [*keys, "run"], "left")
    judged = rows.join(relevant.select("query_id", "evidence_id", F.lit(1).alias("hit")).distinct(), ["query_id", "evidence_id"], "left").join(candidates, "evidence_id", "left")
    gain = F.when(F.col("hit") == 1, 1 / F.log2(F.col("rank") + 1))
    per = judged.groupBy(*keys, "wanted").agg(
        F.count("evidence_id").alias("returned"), F.count("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("dcg"), F.countDistinct("family_id").alias("families"), F.countDistinct("claim_id").alias("_claims"), F.count("claim_id").alias("_known")
    )
    side = judged.where("claim_id IS NOT NULL").select(*keys, "rank", F.array_remove(F.array_distinct("ends"), "").alias("ends"))
    other = side.select(*keys, F.col("rank").alias("_r"), F.col("ends").alias("_e"))
    share = F.size(F.array_intersect("ends", "_e")) / F.greatest(F.lit(1), F.size(F.array_union("ends", "_e")))
    overlap = side.join(other, keys).where("rank < _r").groupBy(*keys).agg(F.avg(share).alias("_overlap"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("wanted", "returned")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return per.join(overlap, keys, "left").select(
        *keys, "returned", F.round(F.col("hits") / F.col("wanted"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.when(F.col("returned") > 0, F.col("dcg") / ideal).otherwise(0.0), 6).alias("ndcg"),
        "families", F.round(F.when(F.col("_known") > 0, 1 - F.col("_claims") / F.col("_known")).otherwise(0.0), 6).alias("redundancy"), F.round(F.coalesce("_overlap", F.lit(0.0)), 6).alias("overlap"),
    )


def retrieval_report(runs: DataFrame, records: DataFrame, counters: tuple[str, ...] = ()) -> DataFrame:
    """Per method: macro means of ``query_records`` over its answerable queries, and latency, time-outs and counters over all runs (method, latency, timed_out, counters)."""
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    quality = records.groupBy("method").agg(F.count("*").alias("queries"), *(mean(c) for c in ("recall", "mrr", "ndcg", "families", "redundancy", "overlap")))
    counts = runs.groupBy("method").agg(F.count("*").alias("samples"), F.count_if("timed_out").alias("timeouts"), *(mean(c) for c in counters))
    times = exact_quantiles(runs, ("method",), "latency", (0.5, 0.95)).select("method", F.round("q0", 6).alias("p50"), F.round("q1", 6).alias("p95"))
    joined = counts.join(times, "method", "left").join(quality, "method", "left")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("recall", "mrr", "ndcg", "families", "redundancy", "overlap")}
    return joined.withColumns(zero | {"queries": F.coalesce("queries", F.lit(0))})


def latency_table(runs: DataFrame, *by: str, most: int = MOST) -> DataFrame:
    """Count, mean, and exact interpolated median and 95th percentile; groups of more than ``most`` runs are never in one task."""
    found = exact_quantiles(runs, by, "latency", (0.5, 0.95), most)
    means = runs.groupBy(*by).agg(F.count("*").alias("runs"), F.round(F.avg("latency"), 6).alias("mean"))
    on = F.lit(True)
    for k in by:
        on = on & F.col(f"m.{k}").eqNullSafe(F.col(f"q.{k}"))
    return means.alias("m").join(found.alias("q"), on, "left").select(*(F.col(f"m.{k}").alias(k) for k in by), "runs", "mean", F.round("q0", 6).alias("p50"), F.round("q1", 6).alias("p95"))


def grouped_in_sets(rows: DataFrame, first: str, second: str, measure: str) -> DataFrame:
    """Count and mean by each of two columns and over all, in one pass."""
    sets = rows.groupingSets([[F.col(first)], [F.col(second)], []], F.col(first), F.col(second))
    return sets.agg(F.count("*").alias("rows"), F.round(F.avg(measure), 6).alias("mean"))


def paired(runs: DataFrame, left: str, right: str) -> DataFrame:
    """Per query that both methods ran: the difference of their median latencies."""
    medians = exact_quantiles(runs.where(F.col("method").isin(left, right)), ("method", "query_id"), "latency", (0.5,))
    med = lambda m: medians.where(F.col("method") == m).select("query_id", F.col("q0").alias(m))
    return med(left).join(med(right), "query_id").select("query_id", F.round(F.col(right) - F.col(left), 6).alias("delta"))


def repeat_guard(runs: DataFrame, repeats: int) -> DataFrame:
    """Per method and query: the median latency, or null unless every repeat is there."""
    medians = exact_quantiles(runs, ("method", "query_id"), "latency", (0.5,)).select("method", "query_id", F.col("q0").alias("_m"))
    per = runs.groupBy("method", "query_id").agg(F.countDistinct("repeat").alias("repeats")).join(medians, ["method", "query_id"], "left")
    return per.select("method", "query_id", "repeats", F.round(F.when(F.col("repeats") == repeats, F.col("_m")), 6).alias("median"))


def pareto_front(rows: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """Rows that no other is at least as good as in both measures and better in one: ``low`` is best small, ``high`` large."""
    return skyline(rows.select(key, low, high), (low,), (high,))


def chosen_setting(measured: DataFrame, key: str, quality: str, slack: float, low: tuple[str, ...], high: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The settings that no other dominates, whether their quality is within ``slack`` of the best, and the first of those by ``order`` ("-" for descending).

    Settings are a grid, so the chosen one is found among rows as few as those.
    """
    measured = checkpointed(measured)  # read by the front and by the best; as few rows as settings
    best = measured.agg(F.max(quality).alias("_best"))  # one row
    held = checkpointed(skyline(measured, low, high).join(F.broadcast(best)).withColumn("allowed", F.col(quality) >= F.col("_best") - slack).drop("_best"))
    by = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
    first = held.orderBy(F.desc("allowed"), *by).limit(1).select(F.col(key).alias("_first"))
    return held.join(F.broadcast(first), F.col(key) == F.col("_first"), "left").withColumn("chosen", F.col("_first").isNotNull()).drop("_first")


def draw(seed: int, replicate: Column, slot: Column, n: Column) -> Column:
    """A reproducible index from 0 to n - 1: the first 60 bits of an MD5, modulo n."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), replicate, slot)), 1, 15), 16, 10).cast("long"), n)


def drawn(clusters: DataFrame, replicates: int, seed: int = 7) -> DataFrame:
    """The rows of ``clusters`` (one for each ``cluster``) drawn with replacement: their columns, ``replicate`` and ``times``.

    Clusters are numbered in their order by ranges and prefix sums. Each replicate draws as many as there are, by hashes
    of seed, replicate and slot. Draws are made in tasks of DRAWS at most. Up to SENT clusters are sent to them; more
    meet them in one shuffle, as they are: counting draws first would need another, and hardly two of a replicate are
    equal. Spark takes the draws for as few as the slots they are made from, so it must not choose the side to be sent.
    """
    table = numbered(clusters, "cluster", name="_i")
    n = table.count()
    parts = max(1, -(-n * replicates // DRAWS))
    slots = table.sparkSession.range(0, n, 1, parts).select(F.col("id").alias("slot")).select("slot", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    draws = slots.select("replicate", draw(seed, F.col("replicate"), F.col("slot"), F.lit(max(1, n))).alias("_i"))
    return draws.join(F.broadcast(table) if n <= SENT else table.hint("merge"), "_i").drop("_i").withColumn("times", F.lit(1).cast("long"))


def bootstrap(clusters: DataFrame, replicates: int, seed: int = 7) -> DataFrame:
    """(replicate, value): ratios of sums over clusters drawn with replacement. Clusters are (cluster, numerator, denominator)."""
    sums = drawn(clusters, replicates, seed).groupBy("replicate").agg(F.sum(F.col("numerator") * F.col("times")).alias("_a"), F.sum(F.col("denominator") * F.col("times")).alias("_b"))
    return sums.select("replicate", F.round(F.col("_a") / F.col("_b"), 6).alias("value"))


def bootstrap_ratio_gap(clusters: DataFrame, replicates: int, seed: int = 7) -> DataFrame:
    """(replicate, value): the difference of two ratios of sums over the same draws. Clusters are (cluster, left, left_of, right, right_of)."""
    total = lambda c: F.sum(F.col(c) * F.col("times"))
    gap = F.coalesce(F.try_divide(total("left").cast("double"), total("left_of")), F.lit(0.0)) - F.coalesce(F.try_divide(total("right").cast("double"), total("right_of")), F.lit(0.0))
    return drawn(clusters, replicates, seed).groupBy("replicate").agg(F.round(gap, 6).alias("value"))


def bootstrap_gap(pairs: DataFrame, replicates: int, statistic: Callable[[np.ndarray], float] | str = "mean", seed: int = 7) -> DataFrame:
    """(replicate, value): the difference of a statistic of ``left`` and of ``right`` over the same drawn pairs (cluster, left, right).

    ``statistic`` is "mean", "p50" or "p95", which Spark aggregates, or any function of an array, which runs in a
    grouped aggregate of Arrow batches; then a replicate's values are in one task.
    """
    rows = drawn(pairs, replicates, seed)
    if statistic == "mean":
        total = lambda c: F.sum(F.col(c) * F.col("times")) / F.sum("times")
        found = rows.groupBy("replicate").agg((total("left") - total("right")).alias("value"))
    elif isinstance(statistic, str):
        at = float(statistic.removeprefix("p")) / 100
        # percentile takes the times as frequencies, so no row is repeated
        of = lambda c: F.expr(f"percentile({c}, {at}D, times)")
        found = rows.groupBy("replicate").agg((of("left") - of("right")).alias("value"))
    else:

        @F.pandas_udf("double")
        def measure(values: pd.Series, times: pd.Series) -> float:
            return float(statistic(np.repeat(values.to_numpy(), times.to_numpy())))

        found = rows.groupBy("replicate").agg(measure("left", "times").alias("_l"), measure("right", "times").alias("_r")).select("replicate", (F.col("_l") - F.col("_r")).alias("value"))
    return found.select("replicate", F.round("value", 6).alias("value"))


def interval(replicates: DataFrame) -> DataFrame:
    """The 95 % interval of replicate values."""
    return replicates.agg(F.round(F.percentile("value", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("value", F.lit(0.975)), 6).alias("high"), F.round(F.avg("value"), 6).alias("mean"))


def effectiveness(runs: DataFrame, reference: str, proposed: list[str], replicates: int, margin: float = 0.05, gain: float = 0.0, seed: int = 7) -> DataFrame:
    """For each proposed method against the reference over the queries that both ran: differences, their 95 % intervals and the gates.

    Runs are one a query (method, query_id, utility, latency). Quality passes if the utility gained surely exceeds
    ``gain``; latency passes if its 95th percentile is surely no more than ``margin`` above the reference's. Both sides
    of a comparison use the same drawn queries.
    """
    of = lambda m, side: runs.where(F.col("method") == m).select(F.col("query_id").alias("cluster"), F.col("utility").alias(f"u_{side}"), F.col("latency").alias(f"l_{side}"))
    out = None
    for i, method in enumerate(proposed):
        pairs = checkpointed(of(method, "left").join(of(reference, "right"), "cluster"))
        side = lambda x: pairs.select("cluster", F.col(f"{x}_left").alias("left"), F.col(f"{x}_right").alias("right"))  # noqa: B023, E731
        told = pairs.agg(F.count("*").alias("paired"), (F.avg("u_left") - F.avg("u_right")).alias("utility_delta"))
        # tables of one row each
        for name, column in (("p95", "l_left"), ("p95_reference", "l_right")):
            told = told.join(F.broadcast(exact_quantiles(pairs, (), column, (0.95,)).select(F.col("q0").alias(name))))
        for name, values in (("utility", bootstrap_gap(side("u"), replicates, "mean", seed + i)), ("latency", bootstrap_gap(side("l"), replicates, "p95", seed + 1000 + i))):
            told = told.join(F.broadcast(interval(values).select(F.col("low").alias(f"{name}_low"), F.col("high").alias(f"{name}_high"))))
        one = told.select(F.lit(method).alias("method"), "*")
        out = one if out is None else out.unionByName(one)
    allowed, ratio = F.col("p95_reference") * margin, F.try_divide("p95", "p95_reference")
    gates = {
        "point_gate": (F.col("utility_delta") > gain) & (ratio <= 1 + margin),
        "quality_gate": F.col("utility_low") > gain,
        "latency_gate": F.col("latency_high") <= allowed,
    }
    rounded = {c: F.round(c, 6) for c in ("utility_delta", "p95", "p95_reference")} | {"allowed": F.round(allowed, 6)}
    return out.withColumns(gates).withColumn("joint_gate", F.col("quality_gate") & F.col("latency_gate")).withColumns(rounded)


def rotation(methods: int, queries: Column, repeats: Column, position: Column) -> Column:
    """The method at a position of the rotated order of (query, repeat)."""
    return F.pmod(position + queries + repeats, F.lit(methods))
