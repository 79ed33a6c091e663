"""Session queries. A user's turn is an answer; its score comes from the length of its text, every third turn is a follow-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import interview
from ..registry import query
from ..session import table

TURNS_SQL = """t AS (SELECT conv_id AS session, turn AS seq, CASE WHEN length(text) % 11 = 0 THEN NULL ELSE length(text) % 120 - 5 END AS score, turn % 3 = 2 AS is_follow_up, text AS feedback, role FROM conversations),
m AS (SELECT *, CASE WHEN score IS NOT NULL AND NOT is_follow_up THEN greatest(0, least(100, score)) END AS main FROM t)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.when(n % 11 != 0, n % 120 - 5).alias("score"), (F.col("turn") % 3 == 2).alias("is_follow_up"), F.col("text").alias("feedback"), "role")


@query(f"WITH {TURNS_SQL} SELECT session, CAST(floor(avg(main) + 0.5) AS BIGINT) AS score, count(main) AS n_scored FROM m GROUP BY session")
def session_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interview.session_scores(turns(spark, sf_dir))


@query(f"WITH {TURNS_SQL}, w AS (SELECT session, seq, sum(CASE WHEN NOT is_follow_up THEN greatest(0, least(100, coalesce(score, 0))) END) OVER x AS s, count(CASE WHEN NOT is_follow_up THEN 1 END) OVER x AS n FROM t WINDOW x AS (PARTITION BY session ORDER BY seq)) SELECT session, seq, CAST(floor(s / n + 0.5) AS BIGINT) AS running FROM w")
def running_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interview.running_scores(turns(spark, sf_dir))


@query(f"""WITH {TURNS_SQL}, r AS (SELECT user_id AS session, max(ts) AS end_time FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT session, seq, score FROM t JOIN r USING (session) WHERE end_time >= TIMESTAMP '2024-01-10' AND score < 60 AND NOT is_follow_up ORDER BY end_time DESC, session, seq LIMIT 25""")
def weak_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    records = e.groupBy(F.col("user_id").alias("session")).agg(F.max("ts").alias("end_time")).withColumn("status", F.lit("FINISHED"))
    return interview.weak_points(records, turns(spark, sf_dir), 60, F.lit("2024-01-10").cast("timestamp_ntz"), 25).select("session", "seq", "score")


@query("""WITH s AS (SELECT user_id, max(CASE WHEN event_type = 'view' THEN CAST(round_even(value, 0) AS INT) END) AS resume, max(CASE WHEN event_type = 'click' THEN CAST(round_even(value, 0) AS INT) END) AS interview, max(CASE WHEN event_type = 'error' AND value > 100 THEN CAST(round_even(value, 0) AS INT) % 100 END) AS demeanor FROM events GROUP BY user_id)
SELECT user_id, coalesce(r, 0) AS resume, coalesce(i, 0) AS interview, coalesce(d, 0) AS demeanor,
coalesce(CAST(floor((2 * (25 * coalesce(r, 0) + 55 * coalesce(i, 0) + 20 * coalesce(d, 0)) + w) / nullif(2 * w, 0)) AS BIGINT), 0) AS potential,
coalesce(CAST(floor((2 * (30 * coalesce(r, 0) + 70 * coalesce(i, 0)) + v) / nullif(2 * v, 0)) AS BIGINT), 0) AS skills
FROM (SELECT *, CASE WHEN r IS NULL THEN 0 ELSE 25 END + CASE WHEN i IS NULL THEN 0 ELSE 55 END + CASE WHEN d IS NULL THEN 0 ELSE 20 END AS w, CASE WHEN r IS NULL THEN 0 ELSE 30 END + CASE WHEN i IS NULL THEN 0 ELSE 70 END AS v
      FROM (SELECT user_id, CASE WHEN resume IS NOT NULL THEN greatest(0, least(100, resume)) END AS r, CASE WHEN interview IS NOT NULL THEN greatest(0, least(100, interview)) END AS i, CASE WHEN demeanor IS NOT NULL THEN greatest(0, least(100, demeanor)) END AS d FROM s))""")
def radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.rint("value").cast("int")
    kind = F.col("event_type")
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(kind == "view", whole)).alias("r"), F.max(F.when(kind == "click", whole)).alias("i"), F.max(F.when((kind == "error") & (F.col("value") > 100), whole % 100)).alias("d"))
    return s.select("user_id", *[c.alias(n) for n, c in scores.radar(F.col("r"), F.col("i"), F.col("d")).items()])


@query(f"WITH {TURNS_SQL}, s AS (SELECT session, CAST(floor(avg(main) + 0.5) AS BIGINT) AS score FROM m GROUP BY session) SELECT CASE WHEN score >= 85 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'weak' END AS band, count(*) AS n FROM s GROUP BY 1")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interview.session_scores(turns(spark, sf_dir)).groupBy(scores.band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))


@query("""SELECT session, dimension, value FROM (SELECT conv_id AS session, count(*) AS turns, count(DISTINCT role) AS roles, sum(length(text)) AS chars FROM conversations GROUP BY conv_id) UNPIVOT (value FOR dimension IN (turns, roles, chars))""")
def radar_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns turned into rows."""
    s = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("session")).agg(F.count("*").alias("turns"), F.countDistinct("role").alias("roles"), F.sum(F.length("text")).alias("chars"))
    return s.unpivot(["session"], ["turns", "roles", "chars"], "dimension", "value")


@query(f"""WITH {TURNS_SQL} SELECT session, seq, CASE WHEN seq >= 6 THEN 'INTERVIEW_COMPLETED' WHEN seq // 3 >= 2 THEN 'FOLLOW_UP_LIMIT_REACHED' WHEN coalesce(score > 90, false) THEN 'AI_SUGGESTED' WHEN score < 60 THEN 'LOW_SCORE' WHEN length(feedback) % 5 > 3 THEN 'MISSING_POINTS' ELSE 'NO_TRIGGER' END AS reason FROM t""")
def followup_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    missing = F.when(F.length("feedback") % 5 > 3, 1).otherwise(0)
    return t.select("session", "seq", interview.follow_up(F.col("score") > 90, F.col("seq") >= 6, F.floor(F.col("seq") / 3), F.col("score"), missing).alias("reason"))


STATE_SQL = "CASE event_type WHEN 'signup' THEN 'INIT' WHEN 'view' THEN 'ASKING' WHEN 'click' THEN 'EVALUATING' WHEN 'error' THEN 'FOLLOW_UP' ELSE 'COMPLETED' END"


@query(f"""WITH s AS (SELECT user_id, event_id, {STATE_SQL} AS state FROM events), p AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM s)
SELECT user_id, event_id, previous, state FROM p WHERE previous IS NOT NULL AND NOT ((previous = 'INIT' AND state IN ('ASKING', 'COMPLETED')) OR (previous = 'ASKING' AND state IN ('EVALUATING', 'FOLLOW_UP', 'COMPLETED'))
OR (previous = 'EVALUATING' AND state IN ('ASKING', 'FOLLOW_UP', 'COMPLETED')) OR (previous = 'FOLLOW_UP' AND state IN ('EVALUATING', 'ASKING', 'COMPLETED')))""")
def flow_legality(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.lit("COMPLETED")
    for kind, name in (("error", "FOLLOW_UP"), ("click", "EVALUATING"), ("view", "ASKING"), ("signup", "INIT")):
        state = F.when(F.col("event_type") == kind, name).otherwise(state)
    e = table(spark, sf_dir, "events").withColumn("state", state)
    return interview.illegal_moves(e, "user_id", "event_id", "state").select("user_id", "event_id", "previous", "state")


@query("""WITH e AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM events) SELECT user_id, count(*) AS n FROM e WHERE value < highest GROUP BY user_id""")
def monotonic_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interview.regressions(table(spark, sf_dir, "events"), "user_id", "event_id", "value").groupBy("user_id").agg(F.count("*").alias("n"))


@query(rf"""WITH {TURNS_SQL}, f AS (SELECT session, seq, list_filter(list_transform(regexp_split_to_array(feedback, '[;.!?\r\n；。！？]'), lambda x: trim(x)), lambda x: length(x) >= 6) AS l FROM t WHERE score BETWEEN 80 AND 200),
s AS (SELECT session, seq, unnest(l) || '.' AS sentence, generate_subscripts(l, 1) AS pos FROM f WHERE len(l) > 0), o AS (SELECT session, sentence, min(seq * 100000 + pos) AS place FROM s GROUP BY ALL), r AS (SELECT session, sentence, row_number() OVER (PARTITION BY session ORDER BY place) AS n FROM o)
SELECT * FROM r WHERE n <= 3""")
def feedback_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interview.highlights(turns(spark, sf_dir), 80, 200)


@query("""WITH p AS (SELECT conv_id, turn, string_split(replace(text, ',', ';'), ';') AS l FROM conversations) SELECT conv_id, turn, len(list_filter(l, lambda x: trim(x) <> '')) AS n_items,
array_to_string(list_filter(list_transform(l, lambda x: trim(x)), lambda x: x <> ''), '; ') AS joined FROM p""")
def suggestion_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = text.suggestion_map(F.replace(F.col("text"), F.lit(","), F.lit(";")))
    c = table(spark, sf_dir, "conversations").withColumn("m", m)
    return c.select("conv_id", "turn", F.size("m").alias("n_items"), text.joined_by_number(F.col("m")).alias("joined"))


@query("""SELECT conv_id, count(*) AS message_count, sum(length(text)) AS total_tokens, max(turn) AS last_turn, count(*) FILTER (role = 'user') AS n_user FROM conversations GROUP BY conv_id""")
def conversation_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("message_count"), F.sum(F.length("text")).alias("total_tokens"), F.max("turn").alias("last_turn"), F.count_if(F.col("role") == "user").alias("n_user"))


@query("""WITH o AS (SELECT o_custkey AS session, o_orderpriority AS request, min(o_orderkey) AS first_at FROM orders GROUP BY ALL) SELECT session, request, 1 + row_number() OVER (PARTITION BY session ORDER BY first_at, request) AS seq FROM o""")
def turn_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request once, numbered after the turn already stored."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderpriority").alias("request"), F.col("o_orderkey").alias("at"))
    return interview.next_sequence(o, o.select("session").distinct().withColumn("last_seq", F.lit(1)))


@query("""WITH r AS (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 END AS prio, event_type FROM events WHERE event_type IN ('view', 'click', 'error') AND value > 20), m AS (SELECT *, min(prio) OVER (PARTITION BY user_id) AS best FROM r)
SELECT user_id, event_id, event_type FROM m WHERE prio = best""")
def source_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value > 20").select(F.col("user_id").alias("session"), F.col("event_type").alias("source"), "event_id")
    return interview.preferred_source(e, ["view", "click", "error"]).select(F.col("session").alias("user_id"), "event_id", F.col("source").alias("event_type"))


@query("""WITH e AS (SELECT user_id AS session, event_id AS pos, CASE WHEN event_type = 'error' THEN 'rpl' ELSE 'apd' END AS kind, CAST(props->>'$.k' AS INT) % 10 AS id, event_type AS text FROM events),
p AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e c WHERE c.kind = 'rpl' AND c.session = e.session AND c.pos > e.pos AND e.id BETWEEN c.id - 1 AND c.id)),
l AS (SELECT session, id, arg_max(text, pos) AS text FROM p GROUP BY ALL) SELECT session, string_agg(text, '' ORDER BY id) AS text FROM l GROUP BY session""")
def transcript_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.get_json_object("props", "$.k").cast("int") % 10
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("at"), F.when(F.col("event_type") == "error", "rpl").otherwise("apd").alias("kind"), part.alias("id"), F.col("event_type").alias("text"))
    return interview.transcript(e.withColumn("low", F.col("id") - 1).withColumn("high", F.col("id")))


@query("""WITH w AS (SELECT conv_id, turn, role, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS words FROM conversations), p AS (SELECT *, lag(words) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM w)
SELECT role, count(*) AS n, round(avg(len(list_intersect(words, before)) / least(len(words), len(before))), 6) AS overlap FROM p WHERE before IS NOT NULL AND least(len(words), len(before)) > 0 GROUP BY role""")
def turn_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean overlap of a turn's words with those of the turn before."""
    w = table(spark, sf_dir, "conversations").withColumn("words", F.array_distinct(text.tokens(F.col("text"))))
    p = w.withColumn("before", F.lag("words").over(Window.partitionBy("conv_id").orderBy("turn"))).withColumn("o", text.overlap_coefficient(F.col("words"), F.col("before")))
    return p.where(F.col("o").isNotNull()).groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg("o"), 6).alias("overlap"))
