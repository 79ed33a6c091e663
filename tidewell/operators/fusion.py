"""Ranking and fusion of channels of candidates: (qid, channel, id, score)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The rank constant, the weights of the three channels and of full text in the hybrid, and the score of equal graph counts.
RRF_K = 60
WEIGHTS = {"fts": 0.3, "vector": 0.6, "graph": 0.1}
ALPHA = 0.3
EQUAL_GRAPH = 0.6
NARROW = 1e-9
DIGITS = 9


def ranked(candidates: DataFrame, keys: tuple[str, ...] = ("qid", "channel")) -> DataFrame:
    """Adds rank from 1 by falling score; ties by id."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id")))


def best(candidates: DataFrame, k: int, score: str = "score", keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The k best of each key; Spark limits each group before its shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), "id")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def min_max(score: str, keys: tuple[str, ...], equal: float = 1.0) -> Column:
    """Scores brought to 0..1 within a key; `equal` where they hardly differ."""
    w = Window.partitionBy(*keys)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high - low < NARROW, F.lit(equal)).otherwise((F.col(score) - low) / (high - low))


def graph_scores(counts: DataFrame, score: str = "score", keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    return counts.withColumn("normalised", min_max(score, keys, EQUAL_GRAPH))


def reciprocal_rank_fusion(candidates: DataFrame, k: int = RRF_K) -> DataFrame:
    """qid, id, rrf_score (sum of 1 / (k + rank)) and hybrid_score (its min-max)."""
    fused = ranked(candidates).groupBy("qid", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), DIGITS).alias("rrf_score"))
    return fused.withColumn("hybrid_score", min_max("rrf_score", ("qid",)))


def weighted_fusion(candidates: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """qid, id and the weighted sum of the channels' min-max scores; missing ones count 0. Weights that do not sum to 1 give way to the defaults."""
    if abs(sum(weights.values()) - 1) > 1e-6 or min(weights.values()) < 0:
        weights = WEIGHTS
    normal = candidates.withColumn("normalised", min_max("score", ("qid", "channel")))
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return normal.groupBy("qid", "id").agg(F.round(F.sum(F.coalesce(weight[F.col("channel")], F.lit(0.0)) * F.col("normalised")), DIGITS).alias("hybrid_score"))


def alpha_fusion(candidates: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """qid, id, hybrid_score = alpha x full text + (1 - alpha) x vector, and the raw cosine where the vector channel has the id."""
    normal = candidates.withColumn("normalised", min_max("score", ("qid", "channel")))
    part = lambda c: F.coalesce(F.max(F.when(F.col("channel") == c, F.col("normalised"))), F.lit(0.0))
    return normal.groupBy("qid", "id").agg(F.round(alpha * part("fts") + (1 - alpha) * part("vector"), DIGITS).alias("hybrid_score"), F.max(F.when(F.col("channel") == "vector", F.col("score"))).alias("abs_cosine"))


def first_of_sources(parts: list[DataFrame], key: str = "id") -> DataFrame:
    """Rows of several sources, each key once, from the first source that has it."""
    joined = None
    for k, part in enumerate(parts):
        part = part.withColumn("source_order", F.lit(k))
        joined = part if joined is None else joined.unionByName(part, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("source_order")
    return joined.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
