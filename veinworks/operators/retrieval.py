"""Dense and hybrid retrieval, and the budgeted, diversity-aware selector."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinworks.functions.storage import checkpointed
from veinworks.operators import matrix


def dot(a: Column, b: Column) -> Column:
    """The dot product of two float arrays, summed in double and in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str | Column = "evidence_id") -> DataFrame:
    """The ``k`` best rows of each query with their rank; ties go to the first by ``tie``, the least id by default."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))).where(F.col("rank") <= k)


def dense(queries: DataFrame, corpus: DataFrame, k: int, limit: int = 4_000_000) -> DataFrame:
    """The ``k`` nearest vectors of each query by dot product: query_id, evidence_id, score, rank; rows without a vector of the query's length are left out.

    Queries (query_id, query) are a stated set held against all rows, in blocks of ``limit`` components that are
    multiplied with each batch of rows; see ``matrix``.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    whole = queries.where(F.col("query").isNotNull()).select("query_id", F.col("query").cast("array<double>").alias("query"))
    widths = [r[0] for r in whole.select(F.size("query")).distinct().collect()]
    rows = corpus.select("evidence_id", F.col("vector").cast("array<double>").alias("vector"))

    def score_by(sides: np.ndarray, width: int):
        def score(batch):
            x = matrix.vectors_of(batch.column("vector"), width)
            return lambda some: x @ sides[:, some]

        return score

    def block(asked: list, width: int) -> DataFrame:
        sides = np.array([r["query"] for r in asked], float).reshape(len(asked), width).T
        return matrix.best_rows(rows, score_by(sides, width), [r["query_id"] for r in asked], kind, k, width=width)

    found = [block(asked, w) for w in widths for asked in matrix.blocks(whole.where(F.size("query") == w), "query_id", max(1, limit // max(1, w)))]
    return matrix.united(found) if found else rows.sparkSession.createDataFrame([], f"query_id {kind}, evidence_id {corpus.schema['evidence_id'].dataType.simpleString()}, score double, rank int")


def hybrid(pool: DataFrame, k: int, lexical: float = 0.65, role: float = 0.25, confidence: float = 0.10) -> DataFrame:
    """Rank pool rows (query_id, evidence_id, lexical, role_match, confidence) by the weighted score."""
    score = F.round(lexical * F.col("lexical") + role * F.col("role_match").cast("double") + confidence * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))), 6)
    return top_k(pool.withColumn("score", score), k)


def _overlap(a: dict, b: dict) -> float:
    """1 for rows of one claim, else the Jaccard similarity of their ends where the pool has them."""
    if a["claim_id"] == b["claim_id"]:
        return 1.0
    x, y = set(a.get("ends", ())), set(b.get("ends", ()))
    return len(x & y) / max(1, len(x | y))


def pair_overlap(ranked: DataFrame) -> DataFrame:
    """Per query the mean overlap of its pairs of ranked rows (query_id, rank, claim_id, ends): 1 for one claim, else the Jaccard similarity of their ends."""
    other = ranked.select("query_id", F.col("rank").alias("_r"), F.col("claim_id").alias("_c"), F.col("ends").alias("_e"))
    jaccard = F.size(F.array_intersect("ends", "_e")) / F.greatest(F.lit(1), F.size(F.array_union("ends", "_e")))
    overlap = F.when(F.col("claim_id") == F.col("_c"), 1.0).otherwise(jaccard)
    return ranked.join(other, "query_id").where("rank < _r").groupBy("query_id").agg(F.round(F.avg(overlap), 6).alias("overlap"), F.count("*").alias("pairs"))


def select(pool: DataFrame, k: int, family_cap: int | None = 2, bonus: float = 0.1, penalty: float = 0.2, minimum: float | None = None) -> DataFrame:
    """The budgeted greedy choice per query over ranked rows (query_id, rank, evidence_id, family_id, claim_id, score).

    In each step the row of largest gain is taken: score, plus ``bonus`` for a new family, less ``penalty`` times the
    largest overlap with a taken row (1 if they share the claim, else the Jaccard similarity of the arrays ``ends``, if
    the pool has them); families at the cap are skipped, and ties go to the earlier rank. Without a cap there is no bonus
    either. Pools are top-k lists, so a group's size is bounded by the k that made them.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        taken = _greedy(pdf.sort_values("rank").to_dict("records"), k, family_cap, bonus, penalty, minimum)
        return pd.DataFrame(taken, columns=[*pdf.columns, "position", "gain"])[["query_id", "position", "evidence_id", "gain"]]

    kinds = {f.name: f.dataType.simpleString() for f in pool.schema}
    return pool.groupBy("query_id").applyInPandas(choose, f"query_id {kinds['query_id']}, position long, evidence_id {kinds['evidence_id']}, gain double")


def _greedy(rows: list[dict], k: int, family_cap: int | None, bonus: float, penalty: float, minimum: float | None) -> list[dict]:
    taken: list[dict] = []
    while rows and len(taken) < k:
        families = [r["family_id"] for r in taken]
        best, best_gain = None, None
        for r in rows:
            if family_cap is not None and families.count(r["family_id"]) >= family_cap:
                continue
            new = family_cap is not None and r["family_id"] not in families
            gain = round(r["score"] + bonus * new - penalty * max((_overlap(r, t) for t in taken), default=0.0), 9)
            if best is None or gain > best_gain:
                best, best_gain = r, gain
        if best is None or minimum is not None and best_gain < minimum:
            break
        rows.remove(best)
        taken.append(best | {"position": len(taken) + 1, "gain": round(best_gain, 6)})
    return taken


def select_by_grid(pool: DataFrame, grid: list[tuple[int, float, float, int]], k: int) -> DataFrame:
    """``select`` for every setting (config_id, bonus, penalty, family cap) in one plan: config_id, query_id, position, evidence_id, gain.

    A group is one query, whose rows are read once for all settings.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("rank").to_dict("records")
        taken = [r | {"config_id": c} for c, b, p, cap in grid for r in _greedy(list(rows), k, cap, float(b), float(p), None)]
        return pd.DataFrame(taken, columns=["config_id", "query_id", "position", "evidence_id", "gain"])

    kinds = {f.name: f.dataType.simpleString() for f in pool.schema}
    return pool.groupBy("query_id").applyInPandas(choose, f"config_id int, query_id {kinds['query_id']}, position long, evidence_id {kinds['evidence_id']}, gain double")


def hard_negatives(queries: DataFrame, candidates: DataFrame, pool: int) -> DataFrame:
    """Per query (query_id, fault_id, role, family_id), the candidates of other families that come nearest: most matches of fault and role first, then same role, then confidence, then id.

    Candidates (evidence_id, fault_id, role, family_id, confidence) are ranked once for each distinct fault, role and family asked for.
    Each row is met in one tier: same fault and role, same role only, same fault only, neither. A tier may be cut to ``pool`` rows per key and family
    beforehand, since the rows ahead in the cut share the key and the family, so they are ahead of it for every query too.
    """
    nearest = (F.desc("confidence"), F.desc("evidence_id"))

    def cut(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "family_id").orderBy(*nearest))).where(F.col("_k") <= pool).drop("_k")

    cells = checkpointed(cut(candidates.select("evidence_id", "fault_id", "role", "family_id", "confidence"), "fault_id", "role"))
    asked = queries.select("query_id", F.col("fault_id").alias("_fault"), F.col("role").alias("_role"), F.col("family_id").alias("_family"))
    profiles = asked.select("_fault", "_role", "_family").distinct()
    same_fault, same_role, relevant = (F.coalesce(F.col(a) == F.col(b), F.lit(False)) for a, b in (("fault_id", "_fault"), ("role", "_role"), ("family_id", "_family")))
    both = profiles.join(cells, (F.col("fault_id") == F.col("_fault")) & (F.col("role") == F.col("_role")))
    by_role = profiles.join(cut(cells, "role"), F.col("role") == F.col("_role")).where(~same_fault)
    by_fault = profiles.join(cut(cells, "fault_id"), F.col("fault_id") == F.col("_fault")).where(~same_role)
    neither = profiles.crossJoin(cut(cells)).where(~same_fault & ~same_role)
    met = both.unionByName(by_role).unionByName(by_fault).unionByName(neither).where(~relevant)
    order = Window.partitionBy("_fault", "_role", "_family").orderBy(F.desc(same_fault.cast("int") + same_role.cast("int")), F.desc(same_role), *nearest)
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pool)
    keys = [F.col(f"a.{k}").eqNullSafe(F.col(f"r.{k}")) for k in ("_fault", "_role", "_family")]
    return asked.alias("a").join(ranked.alias("r"), keys).select("query_id", "evidence_id", "rank")


def within_budget(rows: DataFrame, tokens: int) -> DataFrame:
    """The best-ranked rows of each query whose tokens, summed in rank order, stay within the budget."""
    running = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", running).where(F.col("used") <= tokens)
