"""Graph operators over an edge table (a, b) that holds both directions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinworks.functions.storage import bucketed, checkpointed, discard

#: Links in a bucket of the table that is read every round.
BUCKET_LINKS = 1_000_000


def hops(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, hop): nodes within ``depth`` steps of ``seeds`` (node), with their least distance."""
    seen = frontier = seeds.select("node", F.lit(0).alias("hop")).distinct()
    for k in range(1, depth + 1):
        near = edges.join(frontier, edges["a"] == frontier["node"]).select(F.col("b").alias("node")).distinct()
        frontier = checkpointed(near.join(seen, "node", "left_anti").select("node", F.lit(k).alias("hop")))
        seen = seen.unionByName(frontier)
    return seen


def hop_scores(edges: DataFrame, seeds: DataFrame, depth: int, decay: float) -> DataFrame:
    """(node, score): the best product of decays over paths of up to ``depth`` steps from scored seeds (node, score).

    The frontier holds nodes not visited before; a node visited once keeps the score of its first visit or better.
    """
    best = frontier = seeds.groupBy("node").agg(F.max("score").alias("score"))
    for _ in range(depth):
        near = edges.join(frontier, edges["a"] == frontier["node"]).groupBy("b").agg((F.max("score") * decay).alias("score")).withColumnRenamed("b", "node")
        frontier = checkpointed(near.join(best.select("node"), "node", "left_anti"))
        best = checkpointed(best.unionByName(near).groupBy("node").agg(F.max("score").alias("score")))
    return best


def pagerank(edges: DataFrame, seeds: DataFrame, rounds: int, damping: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """(node, rank): personalised PageRank from equally weighted seeds (node); a node without links keeps its damped rank.

    ``edges`` is read twice; checkpoint it first where it is costly. Ends after ``rounds``, or where the ranks change by less than ``tolerance`` in all.

    The links are dealt out by their first end once, into a bucketed table that is dropped at the end, so a round
    shuffles ranks and their sums, but no links. Only nodes that rank has reached have a row; all others have 0, send
    nothing and get their row in the result.
    """
    buckets = max(edges.sparkSession.sparkContext.defaultParallelism, -(-edges.count() // BUCKET_LINKS))
    starts = seeds.select("node").distinct()
    # the number of seeds is one row
    ranks = checkpointed(starts.join(F.broadcast(starts.agg(F.count("*").alias("_n")))).select("node", (1 / F.col("_n")).alias("start"), (1 / F.col("_n")).alias("rank"), F.lit(None).cast("double").alias("old")))
    with bucketed(edges.select("a", "b"), "a", buckets) as links, bucketed(links.groupBy("a").agg(F.count("*").alias("degree")), "a", buckets) as degrees:
        of = degrees.withColumnRenamed("a", "_a")
        for _ in range(rounds):
            sending = ranks.select("node", "rank").join(of, F.col("node") == F.col("_a")).select("node", (F.col("rank") / F.col("degree")).alias("_each"))
            sent = links.join(sending.hint("shuffle_hash"), F.col("a") == F.col("node")).groupBy(F.col("b").alias("_to")).agg(F.sum("_each").alias("got"))
            met = ranks.drop("old").join(sent, F.col("node") == F.col("_to"), "full").select(F.coalesce("node", "_to").alias("node"), "start", "rank", "got")
            # what is neither a seed nor linked from has no rank
            known = met.join(of, F.col("node") == F.col("_a"), "left").where(F.col("degree").isNotNull() | F.col("start").isNotNull())
            start, old = F.coalesce("start", F.lit(0.0)), F.coalesce("rank", F.lit(0.0))
            kept = F.when(F.col("degree").isNull(), old).otherwise(F.coalesce("got", F.lit(0.0)))
            before, ranks = ranks, checkpointed(known.select("node", start.alias("start"), ((1 - damping) * start + damping * kept).alias("rank"), old.alias("old")))
            discard(before)
            if tolerance is not None and (ranks.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0) < tolerance:
                break
        every = degrees.select(F.col("a").alias("node")).union(starts).distinct()
        out = checkpointed(every.join(ranks.select(F.col("node").alias("_node"), "rank"), F.col("node") == F.col("_node"), "left").select("node", F.coalesce("rank", F.lit(0.0)).alias("rank")))
    discard(ranks)
    return out


def metapaths(claims: DataFrame, entities: DataFrame, paths: DataFrame) -> DataFrame:
    """Claims (claim_id, head, relation, tail) that follow a typed path (role, relation, head_type, tail_type)."""
    head = entities.select(F.col("entity").alias("head"), F.col("type").alias("head_type"))
    tail = entities.select(F.col("entity").alias("tail"), F.col("type").alias("tail_type"))
    return claims.join(head, "head").join(tail, "tail").join(paths, ["relation", "head_type", "tail_type"])


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
