"""Evaluation queries. A text of the labels is predicted good if it has few symbols; vectors of one label are relevant to one another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vector import dot
from ..operators import metrics
from ..registry import query
from ..session import small, table

P_SQL = "p AS (SELECT l.doc_id, lang, quality AS label, CAST(length(text) - length(translate(text, '#*$%&|!', '')) < 20 AS INT) AS prediction, (length(text) - length(translate(text, '#*$%&|!', ''))) / length(text) AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("n"), (F.length("text") - F.length(F.translate("text", "#*$%&|!", ""))).alias("symbols"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", "lang", F.col("quality").alias("label"), (F.col("symbols") < 20).cast("int").alias("prediction"), (F.col("symbols") / F.col("n")).alias("score"), (F.col("quality") == 0).alias("positive"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in columns else c for c in df.columns])


@query(f"WITH {P_SQL} SELECT label, prediction, count(*) AS n FROM p GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(predicted(spark, sf_dir))


@query(f"""WITH {P_SQL}, c AS (SELECT DISTINCT label AS class FROM p UNION SELECT DISTINCT prediction FROM p), s AS (SELECT class, count(*) FILTER (label = class) AS support, count(*) FILTER (prediction = class) AS predicted, count(*) FILTER (label = class AND prediction = class) AS tp FROM c CROSS JOIN p GROUP BY class)
SELECT class, round(coalesce(tp / nullif(predicted, 0), 0), 6) AS precision, round(coalesce(tp / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(predicted + support, 0), 0), 6) AS f1, support FROM s""")
def prf_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.per_class(predicted(spark, sf_dir)), "precision", "recall", "f1")


@query(f"""WITH {P_SQL}, t AS (SELECT count(*) AS n, avg(CAST(label = prediction AS INT)) AS po FROM p), e AS (SELECT sum(a.n * b.n) AS prod FROM (SELECT label AS c, count(*) AS n FROM p GROUP BY 1) a JOIN (SELECT prediction AS c, count(*) AS n FROM p GROUP BY 1) b USING (c))
SELECT n, round(po, 6) AS observed, round(prod / (n * n), 6) AS expected, round((po - prod / (n * n)) / (1 - prod / (n * n)), 6) AS kappa FROM t, e""")
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.kappa(predicted(spark, sf_dir)), "observed", "expected", "kappa")


SCAN_SQL = """th AS (SELECT unnest(range(1, 20)) / 100.0 AS t), s AS (SELECT t, count(*) FILTER (score >= t AND label = 0) AS tp, count(*) FILTER (score >= t AND label = 1) AS fp, count(*) FILTER (score < t AND label = 0) AS fn FROM p CROSS JOIN th GROUP BY t),
m AS (SELECT CAST(t AS DOUBLE) AS t, tp, fp, fn, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM s)"""


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.threshold_scan(predicted(spark, sf_dir), [i / 100 for i in range(1, 20)], above=True, inclusive=True)


@query(f"WITH {P_SQL}, {SCAN_SQL} SELECT t, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m")
def threshold_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scan(spark, sf_dir), "precision", "recall", "f1")


@query(f"WITH {P_SQL}, {SCAN_SQL} SELECT t, round(f1, 6) AS f1 FROM m ORDER BY (recall >= 0.5) DESC, round(f1, 12) DESC, t LIMIT 1")
def threshold_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.recommended(scan(spark, sf_dir), 0.5).select("t", "f1"), "f1")


KNN_SQL = """q AS (SELECT label AS qid, arg_min(embedding, vec_id) AS q, min(vec_id) AS own FROM embeddings GROUP BY label),
s AS (SELECT qid, vec_id, CAST(label = qid AS INT) AS grade, round(list_dot_product(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) AS score FROM q CROSS JOIN embeddings WHERE vec_id <> own),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s)"""


def label_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """qid (a label, asked by its first vector), item, grade, rank."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.groupBy(F.col("label").alias("qid")).agg(F.min_by("embedding", "vec_id").alias("q"), F.min("vec_id").alias("own"))
    scored = e.crossJoin(small(asked)).where("vec_id <> own").select("qid", F.col("vec_id").alias("item"), (F.col("label") == F.col("qid")).cast("int").alias("grade"), F.round(dot(F.col("q"), F.col("embedding")), 9).alias("score"))  # a row a label
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "item"))).where(F.col("rank") <= k)


@query(f"""WITH {KNN_SQL} SELECT qid, max(grade) AS hit, round(sum(grade) / (SELECT count(*) - 1 FROM embeddings WHERE label = qid), 6) AS recall, round(coalesce(1.0 / min(CASE WHEN grade = 1 THEN rank END), 0), 6) AS mrr FROM r WHERE rank <= 10 GROUP BY qid""")
def hit_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("qid"), F.col("vec_id").alias("item"))
    own = e.groupBy("qid").agg(F.min("item").alias("item"))
    return rounded(metrics.first_hits(label_hits(spark, sf_dir, 10), e.join(own, ["qid", "item"], "left_anti"), 10), "recall", "mrr")


@query(f"""WITH {KNN_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, rank) AS ideal FROM r WHERE rank <= 20)
SELECT qid, round(coalesce(sum(CASE WHEN rank <= 10 THEN grade / log2(rank + 1) ELSE 0 END) / nullif(sum(CASE WHEN ideal <= 10 THEN grade / log2(ideal + 1) ELSE 0 END), 0), 0), 6) AS ndcg FROM t GROUP BY qid""")
def ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.ndcg(label_hits(spark, sf_dir, 20), 10), "ndcg")


@query(f"WITH {P_SQL} SELECT coalesce(lang, 'all') AS category, count(*) AS n, round(avg(CAST(label = prediction AS INT)), 4) AS accuracy FROM p GROUP BY GROUPING SETS ((lang), ())")
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predicted(spark, sf_dir)
    return p.rollup("lang").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("prediction")).cast("int")), 4).alias("accuracy")).select(F.coalesce("lang", F.lit("all")).alias("category"), "n", "accuracy")


@query("""WITH d AS (SELECT event_type AS eval_type, CAST(ts AS DATE) AS day, round(avg(value), 6) AS metric FROM events GROUP BY ALL), l AS (SELECT *, lag(metric) OVER (PARTITION BY eval_type ORDER BY day) AS before FROM d) SELECT eval_type, CAST(day AS VARCHAR) AS day, metric, round(metric - before, 6) AS delta FROM l""")
def run_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run against the one before of its kind."""
    d = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("eval_type"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg("value"), 6).alias("metric"))
    return d.withColumn("delta", F.round(F.col("metric") - F.lag("metric").over(Window.partitionBy("eval_type").orderBy("day")), 6))


@query(f"""WITH {P_SQL}, v AS (SELECT lang, CASE WHEN score >= 0.7 THEN 'supported' WHEN score >= 0.01 THEN 'inferred' ELSE 'unsupported' END AS verdict FROM p)
SELECT lang, count(*) AS n, count(*) FILTER (verdict = 'unsupported') AS unsupported, round(1 - count(*) FILTER (verdict = 'unsupported') / count(*), 4) AS overall_confidence FROM v GROUP BY lang""")
def verdict_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scores import three_state

    v = predicted(spark, sf_dir).withColumn("verdict", three_state(F.col("score"), 0.7, 0.01))
    bad = F.count_if(F.col("verdict") == "unsupported")
    return v.groupBy("lang").agg(F.count("*").alias("n"), bad.alias("unsupported"), F.round(1 - bad / F.count("*"), 4).alias("overall_confidence"))


@query("""SELECT count(*) AS n, count(*) FILTER (text IS NULL OR trim(text) = '') AS blanks, count(*) - count(DISTINCT text) AS duplicates, count(*) FILTER (lang NOT IN ('en', 'de', 'fr', 'es')) AS illegal,
(SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang)) AS least_class, (SELECT count(*) FROM (SELECT text FROM documents INTERSECT SELECT text FROM benchmark)) AS overlap FROM documents""")
def dataset_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of checks of a set: blanks, repeats, illegal labels, the smallest class, and what it shares with the evaluation set."""
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    one = d.agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("blanks"), (F.count("*") - F.countDistinct("text")).alias("duplicates"), F.count_if(~F.col("lang").isin("en", "de", "fr", "es")).alias("illegal"))
    least = d.groupBy("lang").agg(F.count("*").alias("c")).agg(F.min("c").alias("least_class"))
    shared = d.select("text").intersect(b.select("text")).agg(F.count("*").alias("overlap"))
    return one.crossJoin(least).crossJoin(shared)  # one row each
