"""Evaluation: confusion, precision and recall, agreement, thresholds, ranking metrics."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import safe_ratio


def confusion(rows: DataFrame) -> DataFrame:
    """label, prediction, n."""
    return rows.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def per_class(rows: DataFrame) -> DataFrame:
    """class, precision, recall, f1 and support over the union of labels and predictions."""
    sides = rows.select(F.explode(F.array(F.struct(F.col("label").alias("class"), F.lit(1).alias("a"), F.lit(0).alias("p"), (F.col("label") == F.col("prediction")).cast("int").alias("tp")), F.struct(F.col("prediction").alias("class"), F.lit(0).alias("a"), F.lit(1).alias("p"), F.lit(0).alias("tp")))).alias("s")).select("s.*")
    sums = sides.groupBy("class").agg(F.sum("a").alias("support"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp"))
    precision, recall = safe_ratio(F.col("tp"), F.col("predicted")), safe_ratio(F.col("tp"), F.col("support"))
    return sums.select("class", precision.alias("precision"), recall.alias("recall"), safe_ratio(2 * precision * recall, precision + recall).alias("f1"), "support")


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    return safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn), safe_ratio(2 * tp, 2 * tp + fp + fn)


def kappa(rows: DataFrame) -> DataFrame:
    """n, observed and expected agreement and Cohen's kappa; 0 for no rows and where chance agreement is complete."""
    joint = confusion(rows)
    total = joint.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("agreed"))
    side = lambda c, name: joint.groupBy(F.col(c).alias("class")).agg(F.sum("n").alias(name))
    chance = side("label", "a").join(side("prediction", "b"), "class", "full").agg(F.coalesce(F.sum(F.coalesce("a", F.lit(0)) * F.coalesce("b", F.lit(0))), F.lit(0)).alias("product"))
    po, pe = F.col("agreed") / F.col("total"), F.col("product") / (F.col("total") * F.col("total"))
    return total.crossJoin(chance).select(F.coalesce("total", F.lit(0)).alias("n"), po.alias("observed"), pe.alias("expected"), F.coalesce(F.when(pe < 1, (po - pe) / (1 - pe)), F.lit(0.0)).alias("kappa"))  # one row each


def threshold_scan(rows: DataFrame, thresholds: Sequence[float], above: bool = False, inclusive: bool = False) -> DataFrame:
    """For each threshold t the counts and metrics of `score < t` (or > with above, with = if inclusive) as prediction of `positive`; a null score
    predicts no. Each row is counted once, by the number of thresholds it passes; the scan sums those few counts."""
    grid = sorted(set(thresholds), reverse=not above)  # a row passes the first ones, or none
    hit = lambda t: {(True, True): F.col("score") >= t, (True, False): F.col("score") > t, (False, True): F.col("score") <= t, (False, False): F.col("score") < t}[above, inclusive]
    passed = sum((F.when(hit(F.lit(float(t))), 1).otherwise(0) for t in grid), F.lit(0))
    cells = rows.groupBy(passed.alias("passed"), F.col("positive").alias("yes")).agg(F.count("*").alias("n"))
    ts = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(t)).alias("t")) for k, t in enumerate(grid, 1)])).alias("x")
    by = cells.select("*", ts).select("passed", "yes", "n", "x.*")
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    predicted = F.col("passed") >= F.col("k")
    by = by.groupBy("t").agg(count(predicted & F.col("yes")).alias("tp"), count(predicted & ~F.col("yes")).alias("fp"), count(~predicted & F.col("yes")).alias("fn"))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return by.select("t", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def recommended(scan: DataFrame, least_recall: float) -> DataFrame:
    """The threshold of the best f1 among those of enough recall, else among all; the first on ties."""
    return scan.orderBy((F.col("recall") >= least_recall).desc(), F.desc(F.round("f1", 12)), "t").limit(1)


def first_hits(retrieved: DataFrame, golden: DataFrame, k: int) -> DataFrame:
    """qid, hit, recall and mrr within k of retrieved (qid, rank, item) against golden (qid, item)."""
    found = retrieved.where(F.col("rank") <= k).join(golden.withColumn("g", F.lit(1)), ["qid", "item"]).groupBy("qid").agg(F.min("rank").alias("first"), F.countDistinct("item").alias("found"))
    wanted = golden.groupBy("qid").agg(F.countDistinct("item").alias("wanted"))
    out = retrieved.select("qid").distinct().join(wanted, "qid", "left").join(found, "qid", "left")
    return out.select("qid", F.col("first").isNotNull().cast("int").alias("hit"), F.coalesce(F.col("found") / F.col("wanted"), F.lit(0.0)).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


def ndcg(graded: DataFrame, k: int) -> DataFrame:
    """qid and nDCG at k of graded (qid, rank, grade); the ideal order is that of the retrieved grades."""
    gain = lambda position: F.col("grade") / F.log2(position + 1)
    w = Window.partitionBy("qid").orderBy(F.desc("grade"), "rank")
    rows = graded.withColumn("ideal", F.row_number().over(w))
    sums = rows.groupBy("qid").agg(F.sum(F.when(F.col("rank") <= k, gain(F.col("rank"))).otherwise(0.0)).alias("dcg"), F.sum(F.when(F.col("ideal") <= k, gain(F.col("ideal"))).otherwise(0.0)).alias("idcg"))
    return sums.select("qid", safe_ratio(F.col("dcg"), F.col("idcg")).alias("ndcg"))


def greedy_matches(pairs: DataFrame) -> DataFrame:
    """Per sample, pairs (sample, expected, got, score) matched one to one: in order of expected, each takes its free match of the highest score, the first on ties."""

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for expected, own in pdf.sort_values(["expected", "got"]).groupby("expected", sort=True):
            free = [g for g in own.sort_values(["score", "got"], ascending=[False, True])["got"] if g not in taken]
            if free:
                taken.add(free[0])
                out.append((pdf["sample"].iloc[0], expected, free[0]))
        return pd.DataFrame(out, columns=["sample", "expected", "got"])

    return pairs.groupBy("sample").applyInPandas(match, "sample long, expected long, got long")


def evaluated_and_skipped(questions: DataFrame, golden: str = "golden") -> DataFrame:
    """How many questions have golden documents (an array), and how many are skipped."""
    has = F.size(F.coalesce(F.col(golden), F.array().cast("array<string>"))) > 0
    return questions.agg(F.count_if(has).alias("evaluated"), F.count_if(~has).alias("skipped"))


def ablation(scores: DataFrame, base: str, full: str, value: str = "value") -> DataFrame:
    """metric, the mean of either mode (metric, mode, value) and the gain of the second over the first."""
    wide = scores.groupBy("metric").pivot("mode", [base, full]).agg(F.avg(value))
    return wide.select("metric", F.round(base, 6).alias("base"), F.round(full, 6).alias("full"), F.round(F.col(full) - F.col(base), 6).alias("gain"))


def overridden(raw: Column, confidence: Column, confirmed: Column, threshold: float, target: str = "knowledge") -> Column:
    """The final intent: the target where another was given with less confidence than the threshold and the check confirmed it."""
    return F.when((raw != target) & F.coalesce(confidence < threshold, F.lit(False)) & F.coalesce(confirmed, F.lit(False)), target).otherwise(raw)


def override_scan(records: DataFrame, thresholds: Sequence[float], target: str = "knowledge") -> DataFrame:
    """The scan of the trigger and the final accuracy at each threshold, of records (label, raw, confidence, confirmed)."""
    samples = records.select(F.when(F.col("raw") != target, F.col("confidence")).alias("score"), ((F.col("label") == target) & (F.col("raw") != target)).alias("positive"))
    right = [F.round(F.avg((overridden(F.col("raw"), F.col("confidence"), F.col("confirmed"), t, target) == F.col("label")).cast("int")), 4).alias(f"a{k}") for k, t in enumerate(thresholds)]
    accuracy = records.agg(*right).select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("t"), F.col(f"a{k}").alias("final_accuracy")) for k, t in enumerate(thresholds)])).alias("x")).select("x.*")
    return threshold_scan(samples, thresholds).join(accuracy, "t")


def gate_scan(records: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """The scan of a gate that takes low scores (top_cosine) for insufficient (sufficient)."""
    return threshold_scan(records.select(F.col("top_cosine").alias("score"), (~F.col("sufficient")).alias("positive")), thresholds)


def variant_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """accuracy, recall of the false class and kappa of booleans (label, prediction); kappa is 0 for a single class or fewer than two rows."""
    both = lambda a, b: F.count_if((F.col("label") == a) & (F.col("prediction") == b))
    c = rows.groupBy(*by).agg(both(True, True).alias("tp"), both(False, False).alias("tn"), both(False, True).alias("fp"), both(True, False).alias("fn"))
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    po, pe = safe_ratio(tp + tn, n), safe_ratio((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn), n * n)
    kappa_ = F.when((n >= 2) & (tp + fn > 0) & (tn + fp > 0) & (pe < 1), (po - pe) / (1 - pe)).otherwise(0.0)
    return c.select(*by, F.round(po, 4).alias("accuracy"), F.round(safe_ratio(tn, tn + fp), 4).alias("negative_recall"), F.round(kappa_, 4).alias("kappa"))


def binary_metrics(rows: DataFrame, *by: str, threshold: float = 0.5) -> DataFrame:
    """accuracy, precision, recall and f1 of scores (score, positive) at a threshold."""
    hit, yes = F.col("score") >= threshold, F.col("positive")
    c = rows.groupBy(*by).agg(F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"), F.count_if(~hit & ~yes).alias("tn"))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    accuracy = safe_ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    return c.select(*by, *[F.round(x, 4).alias(name) for name, x in (("accuracy", accuracy), ("precision", p), ("recall", r), ("f1", f))])


def judge_means(scores: DataFrame, *by: str) -> DataFrame:
    """Mean faithfulness and relevancy of the answers that were judged, and how many were."""
    return scores.groupBy(*by).agg(*[F.round(F.avg(c), 4).alias(c) for c in ("faithfulness", "relevancy")], F.count("faithfulness").alias("n_judged"))


def subset_means(scores: DataFrame, groups: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """Mean and number of values by the group that a map (key, group) gives their key; keys without one are `unknown`."""
    joined = scores.join(groups.select(key, group), key, "left").withColumn(group, F.coalesce(F.col(group).cast("string"), F.lit("unknown")))
    return joined.groupBy(group).agg(F.round(F.avg(value), 6).alias("mean"), F.count(value).alias("n"))
