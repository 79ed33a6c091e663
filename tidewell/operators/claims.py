"""Claims: ordered pairs of sub-claims, claims against documents, verdicts by threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import aggregated_verdict, thresholded
from . import metrics

#: Claims and documents of a check at most, and the thresholds of support and inference.
CLAIMS, DOCUMENTS, HIGH, LOW = 8, 2, 0.7, 0.3


def ordered_pairs(claims: DataFrame) -> DataFrame:
    """id, i, j, first, second: every two different parts of a claim (id, parts), in both orders; parts are a handful."""
    one = claims.select("id", "parts", F.posexplode("parts").alias("i", "first"))
    return one.select("id", "i", "first", F.posexplode("parts").alias("j", "second")).where("i <> j").select("id", "i", "j", "first", "second")


def best_evidence(scores: DataFrame, high: float = HIGH, low: float = LOW) -> DataFrame:
    """id, claim, score, verdict, evidence of scores (id, claim, doc, score): a claim's best document (numbered from 1), the first on ties; of the first
    CLAIMS claims and DOCUMENTS documents of each id."""
    seen = scores.where((F.col("claim") < CLAIMS) & (F.col("doc") < DOCUMENTS))
    best = seen.groupBy("id", "claim").agg(F.max(F.struct("score", (-F.col("doc")).alias("minus"))).alias("b"))
    score = F.col("b.score")
    verdict = F.when(score >= high, "supported").when(score >= low, "inferred").otherwise("unsupported")
    evidence = F.when(score >= low, F.concat(F.lit("["), (1 - F.col("b.minus")).cast("string"), F.lit("]"))).otherwise("N/A")
    return best.select("id", "claim", score.alias("score"), verdict.alias("verdict"), evidence.alias("evidence"))


def verdicts_at(judged: DataFrame, threshold: float) -> DataFrame:
    """id, label, prediction of judgements (id, label, verdict, confidence): those below the threshold become neutral, then an id's are joined."""
    told = judged.select("id", "label", thresholded(F.col("verdict"), F.col("confidence"), threshold).alias("v"))
    return told.groupBy("id", "label").agg(aggregated_verdict(F.collect_set("v")).alias("prediction"))


def verdict_scan(judged: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """For each threshold: agreement over three classes and over two (contradiction or not), accuracies and the classes predicted."""
    out = None
    for t in thresholds:
        three = verdicts_at(judged, t)
        two = three.select(*[(F.col(c) == "contradiction").cast("int").alias(c) for c in ("label", "prediction")])
        counts = three.agg(*[F.count_if(F.col("prediction") == c).alias(f"pred_{c}") for c in ("contradiction", "neutral", "entailment")])
        a = metrics.kappa(three).select(F.round("kappa", 4).alias("kappa_3class"), F.round("observed", 4).alias("accuracy_3class"))
        b = metrics.kappa(two).select(F.round("kappa", 4).alias("kappa_binary"), F.round("observed", 4).alias("accuracy_binary"))
        row = a.crossJoin(b).crossJoin(counts).withColumn("threshold", F.lit(float(t)))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def best_agreement(scan: DataFrame, high: float = HIGH, low: float = LOW) -> DataFrame:
    """Rows (high, low, kappa3, kappa2) by the agreement over three classes, then two, then nearness to the usual thresholds."""
    away = F.abs(F.col("high") - high) + F.abs(F.col("low") - low)
    return scan.orderBy(F.desc("kappa3"), F.desc("kappa2"), away, "high", "low")


