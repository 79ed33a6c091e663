"""Memory queries. Events are memory items: the user is the source, the event type gives the kind, the value the score; now is a fixed time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import memory
from ..registry import query
from ..session import small, table

NOW = "2024-02-05 00:00:00"
KIND_SQL = "CASE event_type WHEN 'purchase' THEN 'preference' WHEN 'click' THEN 'event' ELSE 'fact' END"
AGE_SQL = f"((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400e6)"


def now() -> F.Column:
    return F.to_timestamp(F.lit(NOW))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "preference").when(F.col("event_type") == "click", "event").otherwise("fact")
    return e.withColumn("kind", kind).withColumn("age", memory.age_days(F.col("ts"), now())).withColumn("mentions", F.get_json_object("props", "$.k").cast("int") % 5)


@query(f"""SELECT event_id, {KIND_SQL} AS kind,
round(value * pow(0.5, {AGE_SQL} / CASE {KIND_SQL} WHEN 'preference' THEN 30.0 WHEN 'event' THEN 1.0 ELSE 3.0 END) * (1 + 0.2 * (CAST(props->>'$.k' AS INT) % 5)), 4) AS score
FROM events WHERE {AGE_SQL} <= 30""")
def memory_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = items(spark, sf_dir).withColumn("score", memory.decayed(F.col("value"), F.col("age"), F.col("kind"), F.col("mentions")))
    return fresh.where(F.col("score").isNotNull()).select("event_id", "kind", "score")


@query(f"""SELECT user_id, count(*) AS n, round(sum(value * CASE WHEN {AGE_SQL} >= 30 THEN greatest(0.3, 1 - ({AGE_SQL} - 30) / 100.0) ELSE 1.0 END), 4) AS score
FROM events GROUP BY user_id""")
def cold_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value") * memory.cold_factor(F.col("age"))), 4).alias("score"))


@query("""WITH e AS (SELECT *, round(value / 400, 9) AS score FROM events), m AS (SELECT *, avg(score) OVER (PARTITION BY user_id) AS mean, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rank FROM e WHERE score >= 0.4)
SELECT user_id, event_id, score, rank FROM m WHERE rank <= CASE WHEN mean > 0.85 THEN 5 WHEN mean >= 0.75 THEN 3 ELSE 1 END""")
def dynamic_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall floor, then as many items as the mean score allows."""
    e = table(spark, sf_dir, "events").withColumn("score", F.round(F.col("value") / 400, 9)).where("score >= 0.4")
    w = Window.partitionBy("user_id")
    e = e.withColumn("mean", F.avg("score").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "event_id")))
    return e.where(F.col("rank") <= memory.dynamic_k(F.col("mean"))).select("user_id", "event_id", "score", "rank")


@query(f"""WITH s AS (SELECT user_id, event_type, sha256(CAST(user_id AS VARCHAR) || '|' || event_type) AS hash, count(*) AS mentions, max(ts) AS last_at FROM events GROUP BY user_id, event_type),
l AS (SELECT DISTINCT sha256(CAST(user_id AS VARCHAR) || '|' || event_type) AS hash FROM events WHERE value > 150)
SELECT user_id, event_type, mentions FROM s WHERE mentions >= 2 AND (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_at)) / 86400e6 <= 7 AND hash NOT IN (SELECT hash FROM l)""")
def promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("hash", F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type"), 256))
    short = e.groupBy("user_id", "event_type", "hash").agg(F.count("*").alias("mentions"), F.max("ts").alias("last_at"))
    return memory.promoted(short, e.where("value > 150").select("hash").distinct(), now()).select("user_id", "event_type", "mentions")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def session_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.last_n(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], 3).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n > 4")
def session_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.trimmed(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], 4).select("conv_id", "turn")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, sha256(text) ORDER BY turn) AS n FROM conversations) WHERE n = 1")
def session_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.first_of_hash(table(spark, sf_dir, "conversations"), "conv_id", "text", "turn").select("conv_id", "turn", "role")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' AND trim(text) <> '' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_turn FROM conversations""")
def prev_user_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.when((F.col("role") == "user") & (F.trim("text") != ""), F.col("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(asked, ignorenulls=True).over(w).alias("prev_turn"))


@query("""WITH a AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
b AS (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY conv_id, turn) AS n FROM a WHERE role = 'user' AND next_role = 'assistant')
SELECT conv_id, turn, length(text) AS question_chars, length(answer) AS answer_chars FROM b WHERE n = 1""")
def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions right before an answer, each text once."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    a = table(spark, sf_dir, "conversations").withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    once = Window.partitionBy(F.sha2("text", 256)).orderBy("conv_id", "turn")
    b = a.where("role = 'user' AND next_role = 'assistant'").withColumn("n", F.row_number().over(once)).where("n = 1")
    return b.select("conv_id", "turn", F.length("text").alias("question_chars"), F.length("answer").alias("answer_chars"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d') || '-' || lpad(CAST(n AS VARCHAR), CAST(greatest(2, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS title
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events)""")
def daily_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w))
    return e.select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("-"), F.format_string("%02d", "n")).alias("title"))


@query("""WITH f AS (SELECT user_id, event_type, CAST(value AS INT) % 7 AS topic, min(event_id) AS first_at, max(event_id) AS last_at FROM events GROUP BY ALL)
SELECT user_id, event_type, string_agg(CAST(topic AS VARCHAR), chr(10) ORDER BY first_at) AS content, count(*) AS n_contexts, max(last_at) AS last_at FROM f GROUP BY user_id, event_type""")
def weak_topic_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    # whole numbers as SQL casts them: to the nearest even
    e = table(spark, sf_dir, "events").withColumn("topic", (F.rint("value").cast("int") % 7).cast("string"))
    return memory.merged_notes(e, ["user_id", "event_type"], "topic", "event_id")


@query("""WITH base AS (SELECT user_id, max(ts) AS ts, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY user_id), patch AS (SELECT user_id, max(ts) AS ts, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT coalesce(b.user_id, p.user_id) AS user_id, coalesce(p.n, b.n) AS n, (b.user_id IS NULL) AS inserted FROM base b FULL JOIN patch p ON b.user_id = p.user_id""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New values over old ones, by a full join."""
    from ..sources.tables import upserted

    e = table(spark, sf_dir, "events")
    count = lambda kind: e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias("n"))
    return upserted(count("view"), count("click"), ["user_id"], flag="inserted")


@query("""SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60) GROUP BY ALL""")
def priority_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New queue entries: keys without a pending row."""
    e = table(spark, sf_dir, "events")
    pending = e.where("event_type = 'purchase' AND value > 60").select("user_id").distinct()
    return e.where(F.col("event_type").isin("error", "signup")).join(small(pending), "user_id", "left_anti").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT *, CASE WHEN value > 60 THEN 'preference' WHEN value > 30 THEN 'task' END AS predicted, CASE event_id % 4 WHEN 0 THEN ' Event ' WHEN 1 THEN 'unknown' WHEN 2 THEN 'fact' END AS said FROM events)
SELECT event_id, CASE WHEN predicted = 'preference' THEN predicted WHEN event_id % 4 = 0 THEN 'event' ELSE 'fact' END AS by_classifier,
CASE WHEN event_id % 4 = 0 THEN 'event' ELSE 'fact' END AS by_model, 'fact' AS by_none FROM e""")
def memory_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of each memory in the three modes; classes and answers that are no types count as none."""
    e = table(spark, sf_dir, "events")
    predicted = F.when(F.col("value") > 60, "preference").when(F.col("value") > 30, "task")
    said = F.when(F.col("event_id") % 4 == 0, " Event ").when(F.col("event_id") % 4 == 1, "unknown").when(F.col("event_id") % 4 == 2, "fact")
    return e.select("event_id", *[memory.memory_type(predicted, said, m).alias(f"by_{n}") for m, n in (("clf", "classifier"), ("llm", "model"), ("none", "none"))])
