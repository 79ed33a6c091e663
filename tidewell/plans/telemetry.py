"""Telemetry queries over events: percentiles, usage, JSON, rate limits and micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import jsons
from ..registry import query
from ..session import new_path, table
from ..streaming import stateful
from ..streaming.exactly_once import LedgerSink


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def percentiles_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, list_sort(list(value))[least(count(*), CAST(floor(0.95 * count(*)) AS BIGINT) + 1)] AS p95_floor FROM events GROUP BY event_type")
def percentiles_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest rank, rounded up and rounded down, from counts by value and their running sums: a task sorts values, not events."""
    counts = events(spark, sf_dir).where("value IS NOT NULL").groupBy("event_type", "value").agg(F.count("*").alias("c"))
    w = Window.partitionBy("event_type")
    upto = counts.withColumn("n", F.sum("c").over(w)).withColumn("upto", F.sum("c").over(w.orderBy("value")))
    first = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("value")))
    down = F.least(F.col("n"), F.floor(F.lit(0.95) * F.col("n")) + 1)
    return upto.groupBy("event_type").agg(first(F.lit(0.5) * F.col("n")).alias("p50"), first(F.lit(0.95) * F.col("n")).alias("p95"), first(down).alias("p95_floor"))


@query("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY date_trunc('hour', ts)")
def latency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"), F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY value)").alias("p99"))
    return e.select(F.date_format("h", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n", "low", "high", "mean", "p99")


@query("""WITH u AS (SELECT user_id, unnest(['prompt', 'completion']) AS provider, unnest([CAST(props->>'$.k' AS INT), CAST(props->>'$.k' AS INT) * 2]) AS tokens FROM events) SELECT provider, sum(tokens) AS tokens, count(*) AS n FROM u GROUP BY provider""")
def usage_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    m = F.create_map(F.lit("prompt"), k, F.lit("completion"), k * 2)
    return events(spark, sf_dir).select(F.explode(m).alias("provider", "tokens")).groupBy("provider").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS hits, count(*) FILTER (event_type = 'view') AS misses, round(coalesce(count(*) FILTER (event_type = 'click') / nullif(count(*) FILTER (event_type IN ('click', 'view')), 0), 0), 6) AS rate FROM events GROUP BY user_id""")
def cache_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scores import safe_ratio

    hits, misses = F.count_if(F.col("event_type") == "click"), F.count_if(F.col("event_type") == "view")
    return events(spark, sf_dir).groupBy("user_id").agg(hits.alias("hits"), misses.alias("misses"), F.round(safe_ratio(hits, hits + misses), 6).alias("rate"))


@query("SELECT event_id, CAST(props->>'$.k' AS INT) AS k, greatest(0, least(100, CAST(props->>'$.k' AS INT))) AS score FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), jsons.score_value(F.get_json_object("props", "$.k")).alias("score"))


@query("""SELECT event_id, CAST(regexp_extract('```json' || chr(10) || 'answer: ' || props || ' end' || chr(10) || '```', '\\{(.|\n)*\\}') AS JSON)->>'$.k' AS k FROM events""")
def json_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects found again within fences and words."""
    wrapped = F.concat(F.lit("```json\nanswer: "), F.col("props"), F.lit(" end\n```"))
    return events(spark, sf_dir).select("event_id", F.get_json_object(jsons.recovered(wrapped), "$.k").alias("k"))


@query("SELECT event_id, CAST(coalesce(props->>'$.score', props->>'$.total_score', props->>'$.k') AS INT) AS score FROM events")
def alias_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", jsons.first_key(F.col("props"), ["score", "total_score", "k"]).cast("int").alias("score"))


@query()
def rate_limit_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected calls of each user under a sliding window; a rejected call is not counted, so it is a fold, tested against a loop."""
    return stateful.rate_limited(events(spark, sf_dir).select(F.col("user_id").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts")), most=3, seconds=6 * 3600.0)


@query("""WITH c AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id)) <= 2 AS allowed FROM events) SELECT user_id, count(*) FILTER (allowed) AS allowed, count(*) FILTER (NOT allowed) AS rejected FROM c GROUP BY user_id""")
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two calls an hour from a bucket that fills anew each hour."""
    w = Window.partitionBy("user_id", F.date_trunc("hour", F.col("ts").cast("timestamp"))).orderBy("ts", "event_id")
    e = events(spark, sf_dir).withColumn("allowed", F.row_number().over(w) <= 2)
    return e.groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("rejected"))


@query()
def debounce_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that close after a pause or a longest wait, whichever is first."""
    e = events(spark, sf_dir).select(F.col("user_id").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.length("event_type").alias("priority"))
    return stateful.debounced(e, pause=3 * 3600.0, longest=10 * 3600.0)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, count(DISTINCT session) AS n_sessions, max(n) AS longest FROM (SELECT user_id, session, count(*) AS n FROM s GROUP BY ALL) GROUP BY user_id""")
def sessions_by_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return e.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


@query("SELECT user_id, event_type, CAST(props->>'$.k' AS INT) AS request, min(event_id) AS event_id FROM events GROUP BY ALL")
def idempotent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each request."""
    e = events(spark, sf_dir).withColumn("request", F.get_json_object("props", "$.k").cast("int"))
    return e.groupBy("user_id", "event_type", "request").agg(F.min("event_id").alias("event_id"))


@query("""WITH f AS (SELECT user_id, event_id, avg(CAST(event_type = 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS rate, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS n FROM events)
SELECT user_id, count(*) AS n_open FROM f WHERE n = 10 AND rate >= 0.5 GROUP BY user_id""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the failure rate of the last ten calls reaches one half."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-9, 0)
    e = events(spark, sf_dir).select("user_id", F.avg((F.col("event_type") == "error").cast("int")).over(w).alias("rate"), F.count("*").over(w).alias("n"))
    return e.where("n = 10 AND rate >= 0.5").groupBy("user_id").agg(F.count("*").alias("n_open"))


@query()
def token_bucket_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of three tokens that fill again with one in six hours."""
    return stateful.token_bucket(events(spark, sf_dir).select(F.col("user_id").alias("key"), "event_id", "ts"), 3.0, 1 / (6 * 3600.0))


@query()
def breaker_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakers over the last five calls, open for a day, half open for two calls."""
    e = events(spark, sf_dir).select(F.col("user_id").alias("key"), "event_id", "ts", (F.col("event_type") == "error").alias("failed"))
    return stateful.circuit_breaker(e, window=5, rate=40, wait=86_400.0, probes=2)


@query("""SELECT event_type, count(*) AS n, sum(event_id) AS id_sum, count(DISTINCT event_id % 4) AS n_batches FROM events WHERE event_id % 8 <> 7 GROUP BY event_type""")
def replayed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type, from a sink that got four batches, two of them twice, after one that was cut short."""
    e = events(spark, sf_dir).where("event_id % 8 <> 7").select("event_id", "event_type")
    sink = LedgerSink(spark, new_path(spark, "sink"), "event_id long, event_type string")
    batch = lambda k: e.where(F.col("event_id") % 4 == k)
    batch(2).where("event_id % 8 = 2").write.parquet(f"{sink.path}/rows/sink_batch=2")  # lost before its line in the ledger
    for k in (0, 1, 0, 2, 3, 1):
        sink.write(batch(k), k)
    return sink.rows().groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("id_sum"), F.countDistinct("sink_batch").alias("n_batches"))


@query()
def label_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A balanced logistic regression of the embeddings' labels, fitted on four fifths and asked for the rest."""
    from ..operators.classify import fitted_and_held_out

    return fitted_and_held_out(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
