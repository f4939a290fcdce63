"""Hybrid retrieval: vector hits, an evidence pool over the graph, gates, a weighted score, and a plain or budgeted choice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veinworks.functions.storage import checkpointed, discard
from veinworks.operators.lexical import bigrams, dice
from veinworks.operators.retrieval import select, top_k


@dataclass(frozen=True)
class Method:
    """What a method does.

    pool: ``hits`` (the vector hits), ``hops`` (evidence at nodes within ``hops`` steps of the anchors), ``spread`` (at nodes whose
    PageRank from the anchors stands out) or ``near`` (the hits and evidence within ``hops`` steps, scored by a decay per step).
    role_gate: only evidence of the query's role, unless the pool has none. greedy: the budgeted selector instead of the best scores;
    families and redundancy switch its cap and bonus per family and its penalty. affinity: likeness of the fault's name to an end's label
    adds to the score, and evidence below the floor goes.
    """

    pool: str = "hits"
    role_gate: bool = True
    greedy: bool = False
    families: bool = True
    redundancy: bool = True
    affinity: bool = False


METHODS = {
    "dense": Method(role_gate=False),
    "metapath": Method(),
    "fixed_hop": Method("hops"),
    "adaptive": Method("spread"),
    "full": Method("near", greedy=True),
    "full_without_graph": Method(greedy=True),
    "full_without_role": Method("near", role_gate=False, greedy=True),
    "full_without_families": Method("near", greedy=True, families=False),
    "full_without_redundancy": Method("near", greedy=True, redundancy=False),
    "full_with_affinity": Method("near", greedy=True, affinity=True),
}


def ends(evidence: DataFrame) -> DataFrame:
    """(node, evidence_id): evidence (evidence_id, head_id, tail_id) at each of its non-empty ends, once."""
    return evidence.select("evidence_id", F.explode(F.array_distinct(F.array("head_id", "tail_id"))).alias("node")).where("node <> ''")


def links(evidence: DataFrame) -> DataFrame:
    """(a, b): neighbouring nodes, once in either direction."""
    pairs = evidence.where("head_id <> '' and tail_id <> '' and head_id <> tail_id").select(F.col("head_id").alias("a"), F.col("tail_id").alias("b"))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def near_nodes(anchors: DataFrame, edges: DataFrame, hops: int, decay: float) -> DataFrame:
    """(query_id, node, score): nodes within ``hops`` steps of a query's anchors (query_id, node, score), with the best decayed score.

    A step goes on only from nodes that are new to the query; a node met again keeps the better score.
    """
    best = frontier = checkpointed(anchors.groupBy("query_id", "node").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score")))
    for _ in range(hops):
        near = frontier.join(edges, F.col("node") == F.col("a")).groupBy("query_id", F.col("b").alias("node")).agg((F.max("score") * decay).alias("score"))
        near = checkpointed(near)
        frontier = near.join(best.select("query_id", "node"), ["query_id", "node"], "left_anti")
        best = checkpointed(best.unionByName(near).groupBy("query_id", "node").agg(F.max("score").alias("score")))
    return best


def spread_nodes(anchors: DataFrame, edges: DataFrame, rounds: int = 30, damping: float = 0.85, tolerance: float | None = 1e-6) -> DataFrame:
    """(query_id, node, score): the anchors, and nodes whose PageRank lies half a standard deviation above the query's mean.

    Restarts are in proportion to the anchors' summed scores. Only nodes with energy are kept, so a query's rows grow with
    its surroundings. Ends after ``rounds``, or when no query changes by ``tolerance`` in all.
    """
    summed = anchors.groupBy("query_id", "node").agg(F.sum(F.greatest("score", F.lit(0.0))).alias("score"))
    start = checkpointed(summed.withColumn("start", F.coalesce(F.try_divide("score", F.sum("score").over(Window.partitionBy("query_id"))), F.lit(0.0))).select("query_id", "node", "start"))
    out = edges.join(edges.groupBy("a").agg(F.count("*").alias("degree")), "a")
    energy = start.withColumnRenamed("start", "energy")
    for _ in range(rounds):
        sent = energy.join(out, F.col("node") == F.col("a")).select("query_id", F.col("b").alias("node"), (damping * F.col("energy") / F.col("degree")).alias("energy"))
        again = start.select("query_id", "node", ((1 - damping) * F.col("start")).alias("energy"))
        moved = checkpointed(sent.unionByName(again).groupBy("query_id", "node").agg(F.sum("energy").alias("energy")))
        change = None
        if tolerance is not None:
            both = moved.join(energy.withColumnRenamed("energy", "old"), ["query_id", "node"], "full")
            change = both.groupBy("query_id").agg(F.sum(F.abs(F.coalesce("energy", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("d")).agg(F.max("d")).first()[0]
        if hasattr(energy, "_written_to"):
            discard(energy)
        energy = moved
        if tolerance is not None and (change is None or change < tolerance):
            break
    marks = energy.groupBy("query_id").agg((F.avg("energy") + 0.5 * F.stddev_pop("energy")).alias("least"))
    high = energy.join(marks, "query_id").where("energy >= least").select("query_id", "node", F.col("energy").alias("score"))
    return high.unionByName(start.select("query_id", "node", F.col("start").alias("score"))).groupBy("query_id", "node").agg(F.max("score").alias("score"))


def pool_of(method: Method, hits: DataFrame, evidence: DataFrame, anchor_count: int = 8, hops: int = 1, decay: float = 0.7, rounds: int = 30) -> DataFrame:
    """(query_id, evidence_id, dense, graph) of a method's pool; ``hits`` holds query_id, evidence_id, dense and rank. A score that is missing is 0."""
    scored = hits.select("query_id", "evidence_id", "dense")
    if method.pool == "hits":
        return scored.withColumn("graph", F.lit(0.0))
    at = ends(evidence)
    anchors = hits.where(F.col("rank") <= anchor_count).join(at, "evidence_id").select("query_id", "node", F.col("dense").alias("score"))
    nodes = spread_nodes(anchors, links(evidence), rounds) if method.pool == "spread" else near_nodes(anchors, links(evidence), hops, decay)
    met = nodes.join(at, "node").groupBy("query_id", "evidence_id").agg(F.max("score").alias("graph"))
    if method.pool == "near":
        return scored.join(met, ["query_id", "evidence_id"], "full").na.fill(0.0, ["dense", "graph"])
    return met.select("query_id", "evidence_id").join(scored, ["query_id", "evidence_id"], "left").na.fill(0.0, ["dense"]).withColumn("graph", F.lit(0.0))


def retrieved(queries: DataFrame, hits: DataFrame, evidence: DataFrame, method: Method, k: int, scored: int = 64, graph_weight: float = 0.12, affinity_weight: float = 0.2, affinity_floor: float = 0.0, **pool) -> DataFrame:
    """The ``k`` chosen rows of each query by a method: query_id, position, evidence_id, score.

    ``queries``: query_id, role, fault_name. ``evidence``: evidence_id, head_id, tail_id, head_label, tail_label, role, family_id,
    claim_id, confidence. The pool is cut to the ``scored`` best rows (greatest id first on a tie) before the choice.
    """
    asked = queries.select("query_id", F.col("role").alias("_role"), "fault_name")
    rows = pool_of(method, hits, evidence, **pool).join(evidence, "evidence_id").join(asked, "query_id")
    if method.role_gate:
        same = F.coalesce(F.col("role") == F.col("_role"), F.lit(False))
        rows = rows.withColumn("_any", F.bool_or(same).over(Window.partitionBy("query_id"))).where(same | ~F.col("_any"))
    like = F.lit(0.0)
    if method.affinity:
        like = F.greatest(*(dice(bigrams(F.col("fault_name")), bigrams(F.col(c))) for c in ("head_label", "tail_label")))
        rows = rows.where(like >= affinity_floor)
    total = F.col("dense") + graph_weight * F.col("graph") + 0.1 * F.col("confidence") + (affinity_weight if method.affinity else 0.0) * like
    # the offset moves exact fractions away from the middle between two roundings
    best = top_k(rows.withColumn("score", F.round(total + 1e-9, 6)), scored if method.greedy else k, tie=F.desc("evidence_id"))
    if not method.greedy:
        return best.select("query_id", F.col("rank").cast("long").alias("position"), "evidence_id", "score")
    family = F.coalesce(F.col("family_id").cast("string"), F.lit("UNKNOWN")).alias("family_id")
    nodes = F.filter(F.array_distinct(F.array("head_id", "tail_id")), lambda x: x != "").alias("ends")
    chosen = select(best.select("query_id", "rank", "evidence_id", family, "claim_id", nodes, "score"), k, family_cap=2 if method.families else None, penalty=0.2 if method.redundancy else 0.0)
    return chosen.withColumnRenamed("gain", "score")
