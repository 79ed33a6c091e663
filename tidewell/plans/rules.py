"""Queries of single rules: text, vector, score and JSON functions, memory, reports and evaluation, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsons, scores, vector
from ..functions import text as T
from ..operators import claims, fusion, interview, memory, metrics, search
from ..registry import query
from ..session import table

NL = "chr(10)"


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, substr(coalesce(text, ''), 1, 300) AS head, '# ' || lang || {NL} || coalesce(text, '') AS h FROM documents)
SELECT doc_id, CASE WHEN regexp_replace(trim(t), '\\s+', ' ', 'g') = '' THEN '未知主题' ELSE substr(regexp_replace(trim(t), '\\s+', ' ', 'g'), 1, 30) END AS topic,
md5(CASE WHEN length(t) <= 300 THEN t WHEN regexp_extract(head, '(?s)^(.*)\\n\\n', 1) <> '' THEN regexp_extract(head, '(?s)^(.*)\\n\\n', 1)
    WHEN regexp_extract(head, '(?s)^(.*)\\n', 1) <> '' THEN regexp_extract(head, '(?s)^(.*)\\n', 1) ELSE head END) AS cut,
md5(regexp_replace(regexp_replace(t, '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', {NL} || {NL}, 'g')) AS squeezed,
md5(regexp_replace(h, '(?m)^(\\s*)#(\\s+\\S.*)$', '\\1##\\2', 'g')) AS headed FROM d""")
def text_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics, cuts at boundaries, squeezed spaces, headings one level down."""
    t = F.coalesce("text", F.lit(""))
    d = table(spark, sf_dir, "documents")
    headed = T.normalise_headings(F.concat(F.lit("# "), F.col("lang"), F.lit("\n"), t))
    return d.select("doc_id", T.topic(F.col("text")).alias("topic"), F.md5(T.truncated_at_boundary(t, 300)).alias("cut"), F.md5(T.squeeze_spaces(t)).alias("squeezed"), F.md5(headed).alias("headed"))


@query("""WITH d AS (SELECT doc_id, source || ' > ' || lang || ' > part ' || doc_id AS title, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN source || '%' ELSE ' ' || source || ' ' END AS name,
source || '_%\\' || lang AS pattern, CASE WHEN doc_id % 3 > 0 THEN '10.0.0.' || doc_id || ' , 8.8.8.8' END AS forwarded FROM documents)
SELECT doc_id, split_part(title, ' > ', 1) AS root, CASE WHEN name IS NULL OR trim(name) = '' OR regexp_matches(trim(name), '[%_\\\\]') THEN 'unknown' ELSE trim(name) END AS identity,
replace(replace(replace(pattern, '\\', '\\\\'), '%', '\\%'), '_', '\\_') AS escaped, trim(split_part(forwarded, ',', 1)) AS address FROM d""")
def names_and_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root titles, identities, escaped patterns, addresses of clients."""
    d = table(spark, sf_dir, "documents")
    i, source, lang = F.col("doc_id"), F.col("source"), F.col("lang")
    title = F.concat(source, F.lit(" > "), lang, F.lit(" > part "), i)
    name = F.when(i % 5 == 1, "  ").when(i % 5 == 2, F.concat(source, F.lit("%"))).when(i % 5 > 2, F.concat(F.lit(" "), source, F.lit(" ")))
    forwarded = F.when(i % 3 > 0, F.concat(F.lit("10.0.0."), i, F.lit(" , 8.8.8.8")))
    pattern = F.concat(source, F.lit("_%\\"), lang)
    return d.select("doc_id", T.root_title(title).alias("root"), T.identity(name).alias("identity"), T.escaped_like(pattern).alias("escaped"), T.client_address(forwarded).alias("address"))


STOPS_SQL = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, t, list_filter(list_transform(regexp_split_to_array(t, '[。！？；!?;]'), lambda x: trim(x)), lambda x: x <> '') AS parts,
list_slice(list_filter(regexp_split_to_array(t, '[\\s，。、；：？！,.:;?!]+'), lambda w: length(w) > 1 AND NOT list_contains({STOPS_SQL}, lower(w))), 1, 5) AS names FROM d)
SELECT doc_id, md5(array_to_string(CASE WHEN len(parts) >= 2 THEN parts ELSE [trim(t)] END, '|')) AS claims, array_to_string(names, '|') AS candidates,
trim(replace(replace(trim('请问 ' || substr(t, 1, 40) || ' 呢'), '呢', ''), '请问', '')) AS bare FROM c""")
def claims_and_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of claims, candidate entities of a query, a query without particles."""
    t = F.coalesce("text", F.lit(""))
    bare = T.without_particles(F.concat(F.lit("请问 "), F.substring(t, 1, 40), F.lit(" 呢")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(T.split_claims(t), "|")).alias("claims"), F.array_join(T.candidate_entities(t), "|").alias("candidates"), bare.alias("bare"))


@query("""WITH c AS (SELECT conv_id, turn, text, string_split(coalesce(text, ''), '.') AS items FROM conversations),
k AS (SELECT *, list_filter(list_transform(items, lambda x: trim(x)), lambda x: x <> '') AS kept FROM c)
SELECT conv_id, turn, md5(array_to_string(list_transform(kept, lambda x, i: i || '. ' || x), chr(10))) AS numbered, sha256(CAST(turn AS VARCHAR) || '|' || substr(coalesce(text, ''), 1, 1000)) AS digest,
'https://x.test/?q=' || replace(url_encode(substr(coalesce(text, ''), 1, 20)), '+', '%20') || '&p=1' AS address FROM k""")
def turn_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines, digests of turns, search addresses."""
    c, t = table(spark, sf_dir, "conversations"), F.coalesce("text", F.lit(""))
    address = T.search_address(F.substring(t, 1, 20), "https://x.test/?q={query}&p=1")
    return c.select("conv_id", "turn", F.md5(T.numbered_lines(F.split(t, r"\."))).alias("numbered"), T.turn_digest(F.col("turn").cast("string"), F.col("text")).alias("digest"), address.alias("address"))


@query("""WITH q AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' ' || user_id || '-f' || event_id % 3 WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN 'x' || user_id WHEN 3 THEN user_id || '-F' ELSE NULL END AS raw FROM events)
SELECT event_id, TRY_CAST(nullif(regexp_extract(upper(trim(raw)), '^(\\d+)(?:-F(\\d+))?$', 1), '') AS INT) AS main,
CASE WHEN regexp_matches(upper(trim(raw)), '^(\\d+)(?:-F(\\d+))?$') THEN coalesce(TRY_CAST(nullif(regexp_extract(upper(trim(raw)), '^(\\d+)(?:-F(\\d+))?$', 2), '') AS INT), 0) END AS follow FROM q""")
def question_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of main questions and follow-ups."""
    i, u = F.col("event_id"), F.col("user_id").cast("string")
    raw = F.when(i % 5 == 0, F.concat(F.lit(" "), u, F.lit("-f"), i % 3)).when(i % 5 == 1, u).when(i % 5 == 2, F.concat(F.lit("x"), u)).when(i % 5 == 3, F.concat(u, F.lit("-F")))
    main, follow = T.question_number(raw)
    return table(spark, sf_dir, "events").select("event_id", main.alias("main"), follow.alias("follow"))


@query("""WITH e AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS a, CAST(b.embedding AS DOUBLE[]) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 2),
n AS (SELECT *, sqrt(list_sum(list_transform(a, lambda x: 9 * x * x))) AS norm, list_transform(a, lambda x, i: x - b[i]) AS minus FROM e)
SELECT vec_id, round(list_sum(list_transform(a, lambda x: 3 * x / norm)), 6) AS sum_unit, len(a) * 4 AS n_features, round(list_sum(minus), 6) AS sum_minus, round(list_sum(list_transform(minus, lambda x: abs(x))), 6) AS sum_away FROM n""")
def vector_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors brought to unit length, features of pairs."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    both = e.join(e.select((F.col("vec_id")).alias("base"), F.col("a").alias("b")), F.col("base") == F.col("vec_id") - F.col("vec_id") % 2)
    total = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6)
    n, f = F.size("a"), vector.pair_features(F.col("a"), F.col("b"))
    unit = vector.l2_normalised(F.transform("a", lambda x: x * 3))
    return both.select("vec_id", total(unit).alias("sum_unit"), F.size(f).alias("n_features"), total(F.slice(f, 2 * n + 1, n)).alias("sum_minus"), total(F.slice(f, 3 * n + 1, n)).alias("sum_away"))


@query("""WITH e AS (SELECT event_id, CAST(event_id % 13 AS INT) - 1 AS a, CASE WHEN event_id % 7 > 0 THEN CAST(event_id % 11 AS INT) END AS b, CAST(props->>'$.k' AS INT) AS k, value FROM events),
s AS (SELECT *, coalesce(a >= 0 AND a <= 10, false) AND coalesce(b >= 0 AND b <= 10, false) AS small FROM e)
SELECT event_id, greatest(0, least(100, coalesce(CASE WHEN small THEN a * 10 ELSE a END, 0))) AS a, greatest(0, least(100, coalesce(CASE WHEN small THEN b * 10 ELSE b END, 0))) AS b,
CASE WHEN k % 3 = 0 OR k % 4 = 0 THEN 'contradiction' WHEN k % 5 < 3 THEN 'entailment' ELSE 'neutral' END AS joined, CASE WHEN value < 40 THEN 'neutral' ELSE 'entailment' END AS kept,
CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(greatest(0, least(100, floor(CAST(k - 20 AS DOUBLE) + 0.5))) AS INT) END AS score, k % 6 < 3 AS truth FROM s""")
def score_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scales of ten, joined verdicts, thresholds, coerced numbers and booleans."""
    i, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    a, b = scores.ten_scale([(i % 13).cast("int") - 1, F.when(i % 7 > 0, (i % 11).cast("int"))])
    verdicts = F.array(F.when(k % 3 == 0, "contradiction").otherwise("neutral"), F.when(k % 5 < 3, "entailment").otherwise("neutral"), F.when(k % 4 == 0, "contradiction").otherwise("neutral"))
    number = jsons.score_value(F.when(k % 4 == 0, " none ").otherwise(F.concat(F.lit(" "), (k - 20).cast("string"))))
    truth = jsons.boolean_value(F.when(k % 6 == 0, " TRUE").when(k % 6 == 1, "1").when(k % 6 == 2, "Yes").when(k % 6 == 3, "no"))
    kept = scores.thresholded(F.lit("entailment"), F.col("value"), 40)
    return table(spark, sf_dir, "events").select("event_id", a.alias("a"), b.alias("b"), scores.aggregated_verdict(verdicts).alias("joined"), kept.alias("kept"), number.alias("score"), truth.alias("truth"))


@query("""SELECT event_id, array_to_string(CASE event_id % 3 WHEN 0 THEN ['a', event_type] WHEN 1 THEN [event_type, 'b', 'c'] ELSE [event_type] END, '|') AS listed,
CASE WHEN event_id % 2 = 0 THEN '1=' || event_type || ';3=z' ELSE 'x=' || event_type END AS mapped, CAST(props->>'$.k' AS VARCHAR) AS nested,
sha256(event_type || '|' || '{"a":"1","b":"' || user_id || '"}') AS fingerprint FROM events""")
def json_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists and maps of strings, a key within objects, hashes of calls whatever the order of their arguments."""
    i, kind = F.col("event_id"), F.col("event_type")
    raw = F.when(i % 3 == 0, F.concat(F.lit('["a", " ", "'), kind, F.lit('"]'))).when(i % 3 == 1, F.concat(kind, F.lit(" , b;;c"))).otherwise(kind)
    pairs = F.when(i % 2 == 0, F.concat(F.lit('["'), kind, F.lit('", " ", "z"]'))).otherwise(F.concat(F.lit('{"x": "'), kind, F.lit('", "y": ""}')))
    told = F.array_join(F.transform(F.array_sort(F.map_entries(jsons.ordered_map(pairs))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    nested = jsons.nested_value(F.concat(F.lit('{"outer": [{"no": 1}, {"inner": '), F.col("props"), F.lit("}]}")), "k")
    args = F.create_map(F.lit("b"), F.col("user_id").cast("string"), F.lit("a"), F.lit("1"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(jsons.string_list(raw), "|").alias("listed"), told.alias("mapped"), nested.alias("nested"), T.fingerprint(kind, args).alias("fingerprint"))


@query("""WITH e AS (SELECT event_id AS id, CAST(user_id AS BIGINT) AS qid, 'm' || event_id AS content, value / 100 AS score, ts FROM events WHERE value <= 100),
f AS (SELECT *, epoch_us(TIMESTAMP '2024-03-10') - epoch_us(ts) AS us FROM e WHERE score >= 0.4),
m AS (SELECT qid, avg(score) AS mean FROM f GROUP BY qid),
c AS (SELECT f.qid, content, mean, round(score * CASE WHEN us / 86400e6 <= 30 THEN 1.0 ELSE greatest(0.3, 1 - (us / 86400e6 - 30) / 100.0) END, 4) AS final FROM f JOIN m USING (qid)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final DESC, content) AS rank FROM c)
SELECT qid, content, final AS score, rank FROM r WHERE rank <= least(5, CASE WHEN mean > 0.85 THEN 5 WHEN mean >= 0.75 THEN 3 ELSE 1 END)""")
def memory_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-term memories that answer a user's query, weakened the longer ago they were recalled, as many as the mean score allows."""
    e = table(spark, sf_dir, "events").where("value <= 100")
    items = e.select(F.col("user_id").cast("long").alias("qid"), F.concat(F.lit("m"), F.col("event_id")).alias("content"), (F.col("value") / 100).alias("score"), F.col("ts").alias("recalled_at"))
    return memory.recalled(items, F.to_timestamp(F.lit("2024-03-10 00:00:00")))


@query("""WITH e AS (SELECT event_id AS id, event_type AS kind, CASE WHEN event_id % 4 > 0 THEN event_id % 7 END AS mentions, ts FROM events),
h AS (SELECT DISTINCT event_id AS id FROM events WHERE event_id % 3 = 0)
SELECT e.id, kind, CASE WHEN h.id IS NULL THEN mentions ELSE coalesce(mentions, 0) + 1 END AS mentions, CASE WHEN h.id IS NULL THEN epoch_us(ts) ELSE epoch_us(TIMESTAMP '2024-06-01') END AS at FROM e LEFT JOIN h USING (id)""")
def mention_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One more mention, and the time, for the memories that were recalled."""
    e = table(spark, sf_dir, "events")
    items = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 7).alias("mentions"), F.col("ts").cast("timestamp").alias("last_at"))
    out = memory.refreshed(items, items.where("id % 3 = 0").select("id").union(items.where("id % 9 = 0").select("id")), F.to_timestamp(F.lit("2024-06-01 00:00:00")))
    return out.select("id", "kind", "mentions", F.unix_micros("last_at").alias("at"))


@query("""WITH p AS (SELECT a.vec_id AS id, b.vec_id AS stored_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) >= 0.4),
f AS (SELECT * FROM p WHERE score >= 0.45 AND stored_id % 5 > 0)
SELECT id, first(stored_id ORDER BY score DESC, stored_id) AS stored_id, round(max(score), 6) AS score FROM f GROUP BY id""")
def short_duplicate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best stored match of each new memory that is not superseded."""
    from .retrieval import rounded_pairs

    pairs = rounded_pairs(spark, sf_dir, 0.4).select("id", F.col("other_id").alias("stored_id"), "score")
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("stored_id"), F.when(F.col("vec_id") % 3 > 0, F.col("vec_id") % 5 == 0).otherwise(F.when(F.col("vec_id") % 5 == 0, True)).alias("superseded"))
    return memory.short_duplicates(pairs, stored, 0.45)


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN '  ' ELSE ' ' || event_type || ' ' END AS content, CASE WHEN event_id % 5 = 0 THEN 'high' ELSE CAST(value / 50 AS VARCHAR) END AS importance,
CASE event_id % 4 WHEN 0 THEN ' Event' WHEN 1 THEN NULL WHEN 2 THEN 'other' ELSE 'preference' END AS kind FROM events)
SELECT event_id, trim(content) AS content, round(TRY_CAST(importance AS DOUBLE), 3) AS importance, CASE event_id % 4 WHEN 0 THEN 'event' WHEN 3 THEN 'preference' ELSE 'fact' END AS kind
FROM e WHERE trim(content) <> '' AND coalesce(TRY_CAST(importance AS DOUBLE), 0) >= 0.6""")
def kept_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with content and enough importance, of known types."""
    i = F.col("event_id")
    content = F.when(i % 6 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("event_type"), F.lit(" ")))
    kind = F.when(i % 4 == 0, " Event").when(i % 4 == 2, "other").when(i % 4 == 3, "preference")
    rows = table(spark, sf_dir, "events").select("event_id", content.alias("content"), F.when(i % 5 == 0, "high").otherwise((F.col("value") / 50).cast("string")).alias("importance"), kind.alias("kind"))
    return memory.kept_facts(rows)


@query("""WITH c AS (SELECT conv_id, max(turn) AS n, sum(length(coalesce(text, ''))) AS chars, min(turn) AS first FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, n, CAST(conv_id * 7 % 101 AS INT) AS a, CASE WHEN conv_id % 4 > 0 THEN CAST(conv_id * 13 % 101 AS INT) END AS b, CAST(chars % 101 AS INT) AS c FROM c),
x AS (SELECT *, greatest(a, coalesce(b, 0), c) AS hi, least(a, coalesce(b, 0), c) AS lo FROM s),
d AS (SELECT *, CASE WHEN a = hi THEN 'resume' WHEN coalesce(b, 0) = hi THEN 'interview' ELSE 'demeanor' END AS strongest, CASE WHEN a = lo THEN 'resume' WHEN coalesce(b, 0) = lo THEN 'interview' ELSE 'demeanor' END AS weakest FROM x),
t AS (SELECT *, CASE WHEN hi >= 85 THEN 'Overall performance is strong and already competitive for interviews.' WHEN hi >= 70 THEN 'Overall performance is solid, with clear strengths and room for further polishing.'
  WHEN hi >= 60 THEN 'Overall performance meets the baseline, but answer structure and role-fit still need improvement.'
  ELSE 'Overall performance is below expectation; prioritize role-fit, depth of answers, and communication stability.' END AS base FROM d)
SELECT conv_id, strongest, weakest, CASE WHEN strongest <> weakest THEN base || ' Current strength is ' || strongest || ', and prioritize improving ' || weakest || '.' ELSE base END AS comment,
array_to_string(CASE WHEN n % 3 = 0 THEN ['tip', strongest] ELSE CASE WHEN strongest = weakest THEN [weakest, 'tip'] ELSE [weakest, 'tip', strongest] END END, '|') AS actions,
CASE WHEN n % 4 = 0 THEN true WHEN n % 4 = 1 THEN false ELSE NOT (a > 50) OR n % 5 = 0 END AS follow_up FROM t""")
def report_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest and weakest dimension, the comment, next actions, and whether a follow-up is needed."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    i, n = F.col("conv_id"), F.col("n")
    rows = c.select("conv_id", "n", (i * 7 % 101).cast("int").alias("a"), F.when(i % 4 > 0, (i * 13 % 101).cast("int")).alias("b"), (F.col("chars") % 101).cast("int").alias("c"))
    named = {"resume": F.col("a"), "interview": F.col("b"), "demeanor": F.col("c")}
    rows = rows.withColumn("strongest", interview.extreme_dimension(named)).withColumn("weakest", interview.extreme_dimension(named, False)).withColumn("hi", F.greatest("a", F.coalesce("b", F.lit(0)), "c"))
    none = F.array().cast("array<string>")
    suggested = F.when(n % 3 == 0, none).otherwise(F.array("weakest"))
    actions = F.array_join(interview.next_actions(suggested, F.array(F.lit("tip"), F.col("strongest"))), "|")
    needed = interview.follow_up_needed(F.when(n % 4 == 0, True).when(n % 4 == 1, False), F.col("a") > 50, F.when(n % 5 == 0, F.array(F.lit("point"))), F.lit("  "))
    return rows.select("conv_id", "strongest", "weakest", interview.overall_comment(F.col("hi"), F.col("strongest"), F.col("weakest")).alias("comment"), actions.alias("actions"), needed.alias("follow_up"))


@query("""WITH c AS (SELECT conv_id, max(turn) AS n FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, n, conv_id % 6 AS total, CASE WHEN n % 3 = 0 THEN 'Q' || n WHEN n % 3 = 1 THEN n || '-F1' ELSE NULL END AS question, CASE WHEN n % 5 = 0 THEN ' 9 ' ELSE '' END AS next, n % 7 = 0 AS finished FROM c),
x AS (SELECT *, trim(next) <> '' AS told, TRY_CAST(nullif(regexp_extract(question, '^\\s*(\\d+)', 1), '') AS INT) AS number FROM s),
y AS (SELECT *, finished OR (NOT told AND coalesce(total > 0 AND number >= total, false)) AS done, CASE WHEN told THEN trim(next) WHEN number IS NOT NULL THEN CAST(number + 1 AS VARCHAR) WHEN total > 0 THEN '1' END AS following FROM x)
SELECT conv_id, CASE WHEN done THEN 'COMPLETED' ELSE 'ASKING' END AS state, CASE WHEN NOT done THEN following END AS question,
CASE WHEN done THEN 'TERMINAL' WHEN total > 0 AND n % 2 = 0 THEN 'EXACT' WHEN total > 0 THEN 'DERIVED' ELSE 'READ_ONLY' END AS confidence FROM y WHERE done OR following IS NOT NULL""")
def flow_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an interview stands by its last turn, and how sure that is."""
    n = F.col("turn")
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session"), n.alias("seq"), F.when(n % 3 == 0, F.concat(F.lit("Q"), n)).when(n % 3 == 1, F.concat(n, F.lit("-F1"))).alias("question"),
        F.when(n % 5 == 0, " 9 ").otherwise("").alias("next_question"), (n % 7 == 0).alias("finished"),
    )
    totals = turns.groupBy("session").agg(F.max("seq").alias("n")).withColumn("total", F.col("session") % 6)
    flow = interview.flow_of_last_turn(turns, totals.select("session", "total")).join(totals, "session")
    sure = interview.runtime_confidence(F.col("state") == "COMPLETED", F.col("total"), F.col("n") % 2 == 0)
    return flow.select(F.col("session").alias("conv_id"), "state", "question", sure.alias("confidence"))


@query("""WITH e AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, CASE WHEN before IS NOT NULL THEN greatest(0, (epoch_us(ts) // 1000 - epoch_us(before) // 1000) // 1000) END AS seconds, CASE WHEN before IS NOT NULL THEN 0 END AS backwards,
CASE event_id % 3 WHEN 0 THEN 'named' WHEN 1 THEN 'kept' ELSE NULL END AS told FROM e""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds between a user's events, none backwards; the first value that is told."""
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e, i = table(spark, sf_dir, "events").withColumn("before", before), F.col("event_id")
    told = interview.first_told(F.when(i % 3 == 0, " named ").otherwise("  "), F.lit(None).cast("string"), F.when(i % 3 == 1, "kept"))
    backwards = F.when(F.col("before") < F.col("ts"), interview.duration_seconds(F.col("ts"), F.col("before"))).when(F.col("before").isNotNull(), 0)
    return e.select("event_id", interview.duration_seconds(F.col("before"), F.col("ts")).alias("seconds"), backwards.alias("backwards"), told.alias("told"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, value, CASE WHEN event_id % 2 = 0 THEN 'base' ELSE 'full' END AS mode, CASE WHEN event_id % 9 > 0 THEN value / 10 END AS f, CASE WHEN event_id % 4 > 0 THEN value / 20 END AS r FROM events)
SELECT 'ablation' AS part, event_type AS name, round(avg(value) FILTER (mode = 'base'), 6) AS a, round(avg(value) FILTER (mode = 'full'), 6) AS b, round(avg(value) FILTER (mode = 'full') - avg(value) FILTER (mode = 'base'), 6) AS c FROM e GROUP BY event_type
UNION ALL SELECT 'judged', event_type, round(avg(f), 4), round(avg(r), 4), CAST(count(f) AS DOUBLE) FROM e GROUP BY event_type
UNION ALL SELECT 'subset', CASE WHEN user_id % 4 < 3 THEN CAST(user_id % 3 AS VARCHAR) ELSE 'unknown' END, round(avg(value), 6), CAST(count(value) AS DOUBLE), NULL FROM e GROUP BY 2
UNION ALL SELECT 'golden', 'all', count(*) FILTER (event_id % 3 > 0), count(*) FILTER (event_id % 3 = 0), NULL FROM e""")
def evaluation_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ablation, judged means, means by subset, questions evaluated and skipped."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    double = lambda c: F.col(c).cast("double")
    modes = e.select(F.col("event_type").alias("metric"), F.when(i % 2 == 0, "base").otherwise("full").alias("mode"), "value")
    part = lambda name, df, label, a, b, c: df.select(F.lit(name).alias("part"), F.col(label).cast("string").alias("name"), a.alias("a"), b.alias("b"), c.alias("c"))
    none = F.lit(None).cast("double")
    first = part("ablation", metrics.ablation(modes, "base", "full"), "metric", double("base"), double("full"), double("gain"))
    judged = e.select("event_type", F.when(i % 9 > 0, F.col("value") / 10).alias("faithfulness"), F.when(i % 4 > 0, F.col("value") / 20).alias("relevancy"))
    second = part("judged", metrics.judge_means(judged, "event_type"), "event_type", double("faithfulness"), double("relevancy"), double("n_judged"))
    groups = e.select("user_id").distinct().where("user_id % 4 < 3").withColumn("group", F.col("user_id") % 3)
    third = part("subset", metrics.subset_means(e, groups, "user_id", "group", "value"), "group", double("mean"), double("n"), none)
    golden = e.select(F.when(i % 3 == 1, F.array(F.lit("x"))).when(i % 3 == 2, F.array(F.lit("y"), F.lit("z"))).when(i % 2 == 0, F.array().cast("array<string>")).alias("golden"))
    counts = metrics.evaluated_and_skipped(golden).withColumn("all", F.lit("all"))
    return first.unionByName(second).unionByName(third).unionByName(part("golden", counts, "all", double("evaluated"), double("skipped"), none))


@query("""WITH j AS (SELECT doc_id AS id, CASE WHEN l.toxic = 1 THEN 'contradiction' WHEN l.quality = 1 THEN 'entailment' ELSE 'neutral' END AS label, unnest(range(3)) AS n FROM labels l),
v AS (SELECT id, label, CASE (id + n * 5) % 4 WHEN 0 THEN 'contradiction' WHEN 1 THEN 'neutral' ELSE 'entailment' END AS verdict, ((id * 7 + n * 13) % 20) / 20 AS confidence FROM j),
t AS (SELECT unnest([0.0, 0.5, 0.9]) AS threshold),
p AS (SELECT threshold, id, label, CASE WHEN bool_or(verdict = 'contradiction' AND confidence >= threshold) THEN 'contradiction' WHEN bool_or(verdict = 'entailment' AND confidence >= threshold) THEN 'entailment' ELSE 'neutral' END AS prediction FROM v, t GROUP BY ALL)
SELECT CAST(threshold AS DOUBLE) AS threshold, round(avg(CAST(label = prediction AS INT)), 4) AS accuracy_3class, round(avg(CAST((label = 'contradiction') = (prediction = 'contradiction') AS INT)), 4) AS accuracy_binary,
count(*) FILTER (prediction = 'contradiction') AS pred_contradiction, count(*) FILTER (prediction = 'neutral') AS pred_neutral, count(*) FILTER (prediction = 'entailment') AS pred_entailment FROM p GROUP BY threshold""")
def verdict_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of joined verdicts with labels at three thresholds."""
    l = table(spark, sf_dir, "labels")  # noqa: E741
    label = F.when(F.col("toxic") == 1, "contradiction").when(F.col("quality") == 1, "entailment").otherwise("neutral")
    j = l.select(F.col("doc_id").alias("id"), label.alias("label"), F.explode(F.array(*[F.lit(n) for n in range(3)])).alias("n"))
    k = (F.col("id") + F.col("n") * 5) % 4
    verdict = F.when(k == 0, "contradiction").when(k == 1, "neutral").otherwise("entailment")
    judged = j.select("id", "label", verdict.alias("verdict"), (((F.col("id") * 7 + F.col("n") * 13) % 20) / 20).alias("confidence"))
    return claims.verdict_scan(judged, [0.0, 0.5, 0.9]).drop("kappa_3class", "kappa_binary")


@query("""WITH a AS (SELECT user_id AS qid, event_id AS id, value / 100 AS score, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events WHERE event_type = 'click'),
b AS (SELECT user_id AS qid, event_id - event_id % 2 AS id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events WHERE event_type IN ('view', 'click')),
u AS (SELECT qid, id, 0 AS part, rank FROM a WHERE rank <= 3 UNION ALL SELECT qid, id, 1, rank FROM b WHERE rank <= 6),
o AS (SELECT qid, id, min(part * 1000 + rank) AS place FROM u GROUP BY qid, id), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place, id) AS rank FROM o)
SELECT r.qid, r.id, r.rank, round(CASE WHEN a.score IS NOT NULL THEN least(a.score * 1.2, 1.0) END, 6) AS boosted, coalesce(a.score >= 0.6, false) AS good FROM r LEFT JOIN (SELECT * FROM a WHERE rank <= 3) a USING (qid, id) WHERE r.rank <= 5""")
def united_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a first source and then of a second, graph hits raised, those of enough score marked."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("id"), "event_type", "value")
    first = fusion.best(e.where("event_type = 'click'"), 3, "value").withColumn("score", F.col("value") / 100)
    second = fusion.best(e.where("event_type IN ('view', 'click')"), 6, "value").withColumn("id", F.col("id") - F.col("id") % 2)
    joined = search.first_then_second(first, second.groupBy("qid", "id").agg(F.min("rank").alias("rank")), 5)
    good = search.scored_at_least(first).select("qid", "id", F.lit(True).alias("good"))
    out = joined.join(first.select("qid", "id", F.round(search.boosted(F.col("score")), 6).alias("boosted")), ["qid", "id"], "left").join(good, ["qid", "id"], "left")
    return out.select("qid", "id", "rank", "boosted", F.coalesce("good", F.lit(False)).alias("good"))


@query("""WITH e AS (SELECT user_id % 20 AS qid, event_id AS id, CAST(props->>'$.k' AS DOUBLE) AS score FROM events WHERE event_id % 3 = 0),
n AS (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN 0.6 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS normalised,
row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM e WINDOW w AS (PARTITION BY qid))
SELECT qid, id, round(normalised, 6) AS normalised, rank <= 3 AND score >= 60 AS conflict FROM n""")
def graph_and_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of graph hits by query, and candidates of conflicts: of the three best those of enough score."""
    e = table(spark, sf_dir, "events").where("event_id % 3 = 0").select((F.col("user_id") % 20).alias("qid"), F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("double").alias("score"))
    near = search.near_roots(e, 3, 60).select("id", F.lit(True).alias("near"))
    return fusion.graph_scores(e).join(near, "id", "left").select("qid", "id", F.round("normalised", 6).alias("normalised"), F.coalesce("near", F.lit(False)).alias("conflict"))
