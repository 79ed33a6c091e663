"""Queries of the search request, agent scorecards, claims, crawling and reports. Tables stand in for those of a service: the comments say how."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import agents, claims, crawl, fusion, interview, memory, metrics, request, retrieval, search
from ..registry import query
from ..session import table
from .retrieval import CHANNELS_SQL, benchmark_queries, channels, fts_hits, graph_hits, named_hits, vector_hits

#: Documents with a parent (every third is one), a flag of the canonical and of the superseded.
DOCS_SQL = "d AS (SELECT *, CASE WHEN doc_id % 3 > 0 THEN doc_id - doc_id % 3 END AS parent_id, CASE WHEN doc_id % 5 < 4 THEN doc_id % 2 = 0 END AS is_canonical, CASE WHEN doc_id % 7 < 6 THEN doc_id % 11 = 0 END AS superseded, doc_id % 13 // 12 AS del_flag FROM documents)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "*", F.when(i % 3 > 0, i - i % 3).alias("parent_id"), F.when(i % 5 < 4, i % 2 == 0).alias("is_canonical"), F.when(i % 7 < 6, i % 11 == 0).alias("superseded"), F.floor(i % 13 / 12).alias("del_flag")
    )


@query(f"WITH {DOCS_SQL} SELECT doc_id FROM d WHERE parent_id IS NULL AND is_canonical AND NOT coalesce(superseded, false) AND del_flag = 0")
def visible_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.not_deleted(search.not_superseded(search.canonical_only(search.parents_only(documents(spark, sf_dir))))).select("doc_id")


@query(f"WITH {DOCS_SQL} SELECT parent_id, count(*) AS n FROM d WHERE parent_id IS NOT NULL GROUP BY parent_id")
def children_by_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.children_only(documents(spark, sf_dir)).groupBy("parent_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE contains(coalesce(lang, ''), 'de') OR contains(coalesce(source, ''), 'de') OR contains(coalesce(text, ''), 'de')")
def keyword_any_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(search.any_column_contains(["lang", "source", "text"], "de")).select("doc_id")


@query("SELECT item_id FROM benchmark WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT lower(n_name) AS name FROM nation UNION SELECT 'the ' UNION SELECT 'über') WHERE contains(text, name))")
def entity_in_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("name")).union(spark.createDataFrame([("the ",), ("über",)], "name string"))
    return search.entity_hits(benchmark_queries(spark, sf_dir), names).select(F.col("qid").alias("item_id"))


@query("""WITH n AS (SELECT doc_id, source || ':' || n_chars AS title, sha256(text) AS content_hash FROM documents WHERE doc_id % 2 = 1), s AS (SELECT source || ':' || n_chars AS title, sha256(text) AS content_hash FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id FROM n WHERE title IN (SELECT title FROM s WHERE title IS NOT NULL) OR content_hash IN (SELECT content_hash FROM s WHERE content_hash IS NOT NULL)""")
def known_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd documents whose title or text stands among the even ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("source"), F.lit(":"), F.col("n_chars").cast("string")).alias("title"), F.sha2("text", 256).alias("content_hash"))
    return search.known_titles_or_hashes(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0")).select("doc_id")


HYBRID_SQL = """f AS (SELECT qid, id, round(0.3 * coalesce(max(CASE WHEN channel = 'fts' THEN normalised END), 0) + 0.7 * coalesce(max(CASE WHEN channel = 'vector' THEN normalised END), 0), 9) AS score FROM s WHERE channel <> 'graph' GROUP BY qid, id)"""


def by_channel(spark: SparkSession, sf_dir: str) -> dict:
    return {"fts": lambda k: fts_hits(spark, sf_dir, k=k), "vector": lambda k: vector_hits(spark, sf_dir, k), "graph": lambda k: graph_hits(spark, sf_dir, k)}


@query(f"WITH {CHANNELS_SQL}, {HYBRID_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f) SELECT qid, id, score, rank FROM r WHERE rank <= 25")
def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request of 25 results in mode hybrid; the channels give twice as many."""
    return search.searched(by_channel(spark, sf_dir), 25, "hybrid").select("qid", "id", "score", "rank")


@query(f"""WITH {CHANNELS_SQL}, f AS (SELECT qid, id, round(sum(1.0 / (60 + rnk)), 9) AS score FROM s GROUP BY qid, id), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f)
SELECT qid, id, score, rank FROM r WHERE rank <= 25""")
def search_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.searched(by_channel(spark, sf_dir), 25).select("qid", "id", "score", "rank")


@query(f"""WITH {CHANNELS_SQL}, v AS (SELECT qid, id, rnk AS rank, score FROM s WHERE channel = 'vector'), a AS (SELECT qid, id, rank, score AS abs_cosine FROM v WHERE qid % 2 = 0 OR rank > 1), b AS (SELECT qid, id, rank, CASE WHEN qid % 3 > 0 THEN score END AS abs_cosine FROM v),
t AS (SELECT b.qid FROM (SELECT qid, coalesce(first(abs_cosine ORDER BY rank), 0) AS x FROM b GROUP BY qid) b LEFT JOIN (SELECT qid, coalesce(first(abs_cosine ORDER BY rank), 0) AS x FROM a GROUP BY qid) a USING (qid) WHERE b.x > coalesce(a.x, 0))
SELECT qid, id, rank, abs_cosine, false AS used_rewrite FROM a WHERE qid NOT IN (SELECT qid FROM t) UNION ALL SELECT qid, id, rank, abs_cosine, true FROM b WHERE qid IN (SELECT qid FROM t)""")
def better_of_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector hits, of which odd queries lack the first, against those of a rewrite, for which every third query has no cosine."""
    v = fusion.ranked(channels(spark, sf_dir).where("channel = 'vector'")).select("qid", "id", "rank", "score")
    a = v.where("qid % 2 = 0 OR rank > 1").withColumnRenamed("score", "abs_cosine")
    b = v.select("qid", "id", "rank", F.when(F.col("qid") % 3 > 0, F.col("score")).alias("abs_cosine"))
    return search.better_hits(a, b)


@query(f"WITH {CHANNELS_SQL} SELECT qid, count(*) FILTER (normalised >= 0.5) AS qualified, count(*) AS total, round(min(normalised), 4) AS min_score FROM s WHERE channel = 'vector' GROUP BY qid")
def relevance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = channels(spark, sf_dir).where("channel = 'vector'")
    return search.relevance_summary(v.withColumn("score", fusion.min_max("score", ("qid", "channel"))))


#: Agent tasks: an event is one; its type decides the tools, its number which were called.
TASKS_SQL = """k AS (SELECT event_id, user_id, value, CAST(props->>'$.k' AS INT) AS n, CASE event_type WHEN 'view' THEN ['search'] WHEN 'click' THEN ['search', 're_search'] WHEN 'error' THEN ['recall_memory'] WHEN 'signup' THEN CAST([] AS VARCHAR[]) ELSE ['search', 'answer'] END AS expected FROM events),
c AS (SELECT *, CASE n % 5 WHEN 0 THEN expected WHEN 1 THEN list_concat(expected, ['re_search']) WHEN 2 THEN list_concat(expected, ['other']) WHEN 3 THEN CAST([] AS VARCHAR[]) ELSE ['search', 'answer', 'search', 'answer'] END AS actual FROM k),
t AS (SELECT *, CASE WHEN list_contains(expected, 're_search') THEN 'reselect' WHEN list_contains(expected, 'recall_memory') THEN 'memory' WHEN n % 4 = 3 THEN 'knowledge_multi' WHEN len(expected) = 0 THEN CASE WHEN n % 2 = 0 THEN 'realtime' ELSE 'casual' END ELSE 'knowledge_single' END AS path,
list_has_all(actual, expected) AS tool_correct, list_has_all(list_concat(expected, ['re_search']), actual) AS no_extra, n % 9 > 0 AS args_ok, len(actual) AS tool_count FROM c), p AS (SELECT *, tool_correct AND n % 3 > 0 AS passed FROM t)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, words = F.col("event_type"), lambda *w: F.array(*[F.lit(x) for x in w]).cast("array<string>")
    n = F.get_json_object("props", "$.k").cast("int")
    expected = F.when(kind == "view", words("search")).when(kind == "click", words("search", "re_search")).when(kind == "error", words("recall_memory")).when(kind == "signup", words()).otherwise(words("search", "answer"))
    k = table(spark, sf_dir, "events").select("event_id", "user_id", "value", n.alias("n"), expected.alias("expected"))
    called = F.when(F.col("n") % 5 == 0, F.col("expected")).when(F.col("n") % 5 == 1, F.concat("expected", words("re_search"))).when(F.col("n") % 5 == 2, F.concat("expected", words("other"))).when(F.col("n") % 5 == 3, words()).otherwise(words("search", "answer", "search", "answer"))
    c = k.withColumn("actual", called)
    said = F.when(F.col("n") % 2 == 0, F.lit("现在几点")).otherwise("hello")
    path = agents.path_of(F.col("expected"), F.when(F.col("n") % 4 == 3, 2).otherwise(1), said)
    points = F.when(F.col("n") % 3 > 0, words("x")).otherwise(words("y"))
    return c.select(
        "*", path.alias("path"), agents.covered(F.col("actual"), F.col("expected")).alias("tool_correct"), agents.no_extra(F.col("actual"), F.col("expected")).alias("no_extra"), (F.col("n") % 9 > 0).alias("args_ok"),
        F.size("actual").alias("tool_count"), agents.outcome(F.lit("x"), F.col("actual"), F.col("expected"), points).alias("passed"),
    )


@query(f"WITH {TASKS_SQL} SELECT path, count(*) AS n FROM p GROUP BY path")
def path_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agents.path_coverage(tasks(spark, sf_dir))


@query(f"""WITH {TASKS_SQL}, x AS (SELECT CASE WHEN NOT args_ok THEN 'arguments' WHEN NOT no_extra THEN 'wrong tool' WHEN NOT tool_correct THEN 'missing tool' WHEN tool_count > len(expected) + 1 THEN 'detour' ELSE 'missing points' END AS failure FROM p WHERE NOT passed)
SELECT failure, count(*) AS n FROM x GROUP BY failure""")
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = tasks(spark, sf_dir).where("NOT passed")
    kind = agents.failure_of(F.col("args_ok"), F.col("no_extra"), F.col("tool_correct"), F.col("tool_count"), F.size("expected"))
    return failed.groupBy(kind.alias("failure")).agg(F.count("*").alias("n"))


@query(f"""WITH {TASKS_SQL}, x AS (SELECT *, CASE WHEN n % 6 > 0 THEN tool_correct END AS tc FROM p)
SELECT count(*) AS n, round(avg(CAST(passed AS INT)), 4) AS pass_rate, round(avg(CAST(tc AS INT)), 4) AS tool_correct_rate, round(avg(CASE WHEN tc IS NOT NULL THEN CAST(no_extra AS INT) END), 4) AS no_extra_rate,
round(avg(CASE WHEN tc IS NOT NULL THEN CAST(args_ok AS INT) END), 4) AS args_rate, round(avg(CASE WHEN n % 4 > 0 THEN n % 2 END), 4) AS grounding, round(avg(tool_count), 2) AS avg_tool_count, round(avg(CASE WHEN n % 3 > 0 THEN n END), 1) AS avg_tokens,
round(quantile_cont(value, 0.5), 1) AS p50_ms, round(quantile_cont(value, 0.95), 1) AS p95_ms FROM x""")
def agent_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    t = tasks(spark, sf_dir).withColumn("tool_correct", F.when(n % 6 > 0, F.col("tool_correct"))).withColumn("grounding", F.when(n % 4 > 0, n % 2).cast("double")).withColumn("tokens", F.when(n % 3 > 0, n)).withColumn("duration_ms", F.col("value"))
    return agents.scorecard(t)


@query(f"WITH {TASKS_SQL} SELECT path, count(*) AS n, round(avg(CAST(passed AS INT)), 4) AS pass_rate FROM p GROUP BY path")
def pass_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agents.pass_by_path(tasks(spark, sf_dir))


@query(f"""WITH {TASKS_SQL}, l AS (SELECT user_id AS session, arg_max(trace_id, ts * 1000000 + trace_id) AS trace_id FROM (SELECT user_id, event_id // 3 AS trace_id, max(event_id) AS ts FROM events GROUP BY ALL) GROUP BY user_id)
SELECT trace_id, round(avg(CAST(n % 2 = 0 AS INT)), 6) AS grounding FROM (SELECT DISTINCT trace_id FROM l) JOIN k ON k.event_id // 3 = trace_id GROUP BY trace_id""")
def latest_trace_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three events are a trace; of each user's latest trace the share of successful calls."""
    k = tasks(spark, sf_dir).select("user_id", "event_id", F.floor(F.col("event_id") / 3).alias("trace_id"), (F.col("n") % 2 == 0).alias("result_ok"))
    traces = k.groupBy(F.col("user_id").alias("session"), "trace_id").agg(F.max("event_id").alias("created_at"))
    calls = agents.calls_of_latest_trace(traces, k.drop("user_id")).drop("session").distinct()
    return agents.grounding(calls).select("trace_id", F.round("grounding", 6).alias("grounding"))


@query(f"WITH {TASKS_SQL}, x AS (SELECT path, args_ok AS l, no_extra AS q FROM p), g AS (SELECT path, count(*) AS n, count(*) FILTER (l AND q) AS tp, count(*) FILTER (NOT l AND NOT q) AS tn, count(*) FILTER (NOT l AND q) AS fp, count(*) FILTER (l AND NOT q) AS fn FROM x GROUP BY path)," + """
e AS (SELECT *, (tp + tn) / n AS po, ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (n * n) AS pe FROM g)
SELECT path, round(po, 4) AS accuracy, round(coalesce(tn / nullif(tn + fp, 0), 0), 4) AS negative_recall, round(CASE WHEN n >= 2 AND tp + fn > 0 AND tn + fp > 0 AND pe < 1 THEN (po - pe) / (1 - pe) ELSE 0 END, 4) AS kappa FROM e""")
def variant_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks(spark, sf_dir).select("path", F.col("args_ok").alias("label"), F.col("no_extra").alias("prediction"))
    return metrics.variant_metrics(t, "path")


@query(f"WITH {TASKS_SQL}, x AS (SELECT path, value >= 50 AS hit, passed AS yes FROM p), g AS (SELECT path, count(*) AS n, count(*) FILTER (hit AND yes) AS tp, count(*) FILTER (hit AND NOT yes) AS fp, count(*) FILTER (NOT hit AND yes) AS fn FROM x GROUP BY path)" + """
SELECT path, round((n - fp - fn) / n, 4) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM g""")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks(spark, sf_dir).select("path", F.col("value").alias("score"), F.col("passed").alias("positive"))
    return metrics.binary_metrics(t, "path", threshold=50.0)


OVERRIDE_SQL = """r AS (SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'knowledge' ELSE 'other' END AS label, CASE WHEN event_id % 3 = 0 THEN 'knowledge' ELSE 'other' END AS raw, CASE WHEN event_id % 7 > 0 THEN value / 100 END AS confidence, event_id % 2 = 0 AS confirmed FROM events),
th AS (SELECT unnest([0.2, 0.5, 0.8]) AS t), z AS (SELECT *, coalesce(raw <> 'knowledge' AND confidence < t, false) AS hit, label = 'knowledge' AND raw <> 'knowledge' AS pos FROM r CROSS JOIN th)"""


@query(f"""WITH {OVERRIDE_SQL}, g AS (SELECT t, count(*) FILTER (hit AND pos) AS tp, count(*) FILTER (hit AND NOT pos) AS fp, count(*) FILTER (NOT hit AND pos) AS fn, round(avg(CAST((CASE WHEN hit AND confirmed THEN 'knowledge' ELSE raw END) = label AS INT)), 4) AS final_accuracy FROM z GROUP BY t)
SELECT CAST(t AS DOUBLE) AS t, tp, fp, fn, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, final_accuracy FROM g""")
def override_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    records = e.select(F.when(F.col("event_type").isin("view", "click"), "knowledge").otherwise("other").alias("label"), F.when(i % 3 == 0, "knowledge").otherwise("other").alias("raw"), F.when(i % 7 > 0, F.col("value") / 100).alias("confidence"), (i % 2 == 0).alias("confirmed"))
    return metrics.override_scan(records, [0.2, 0.5, 0.8]).select("t", "tp", "fp", "fn", F.round("f1", 6).alias("f1"), "final_accuracy")


@query("""WITH p AS (SELECT conv_id, turn, list_filter(string_split(text, ','), lambda x: x <> '') AS parts FROM conversations), x AS (SELECT conv_id, turn, unnest(parts) AS w, generate_subscripts(parts, 1) - 1 AS i FROM p WHERE len(parts) BETWEEN 2 AND 6)
SELECT a.conv_id, a.turn, count(*) AS n, sum(length(a.w) * (b.i + 1)) AS mark FROM x a JOIN x b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.i <> b.i GROUP BY ALL""")
def claim_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered pairs of the parts between commas of a turn."""
    parts = F.filter(F.split("text", ","), lambda x: x != "")
    c = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), parts.alias("parts")).where(F.size("parts").between(2, 6))
    pairs = claims.ordered_pairs(c)
    return pairs.groupBy("id.conv_id", "id.turn").agg(F.count("*").alias("n"), F.sum(F.length("first") * (F.col("j") + 1)).alias("mark"))


@query("""WITH s AS (SELECT user_id AS id, event_id // 2 % 10 AS claim, event_id % 2 AS doc, max(value) / 100 AS score FROM events GROUP BY ALL), b AS (SELECT id, claim, max(score) AS score, arg_min(doc, (-score, doc)) AS doc FROM s WHERE claim < 8 GROUP BY ALL)
SELECT id, claim, score, CASE WHEN score >= 0.7 THEN 'supported' WHEN score >= 0.3 THEN 'inferred' ELSE 'unsupported' END AS verdict, CASE WHEN score >= 0.3 THEN '[' || (doc + 1) || ']' ELSE 'N/A' END AS evidence FROM b""")
def claim_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    s = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id"), (F.floor(i / 2) % 10).alias("claim"), (i % 2).alias("doc")).agg((F.max("value") / 100).alias("score"))
    return claims.best_evidence(s)


@query("""SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'pending' ELSE 'done' END AS status FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 5""")
def queue_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "pending").otherwise("done").alias("status"))
    return crawl.drained(o).withColumnRenamed("id", "o_orderkey")


@query("""SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS side, count(*) FILTER (s_acctbal > 0) AS crawled, count(*) FILTER (s_acctbal > 5000) AS approved, count(*) FILTER (s_acctbal > 0 AND s_acctbal <= 5000) AS rejected,
count(*) FILTER (s_acctbal > 0 AND s_suppkey % 4 = 0) AS conflicts, count(*) FILTER (s_acctbal <= 0 AND s_acctbal > -500) AS skipped, count(*) FILTER (s_acctbal <= -500) AS errors FROM supplier GROUP BY 1""")
def crawl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("s_acctbal")
    s = table(spark, sf_dir, "supplier").select(F.when(F.col("s_nationkey") % 2 == 0, "even").otherwise("odd").alias("side"), F.when(a > 0, "ok").when(a > -500, "skipped").otherwise("ingest_error").alias("status"), F.when(a > 5000, "approved").otherwise("pending").alias("review"), (F.col("s_suppkey") % 4 == 0).alias("conflict"))
    return crawl.crawl_summary(s, "side")


@query("""SELECT p_partkey AS id, matched, p_size + matched * 10 AS rank_priority FROM (SELECT *, CAST(contains(lower(p_name), 'green') OR contains(lower(p_brand), 'green') AS INT) + CAST(contains(lower(p_name), 'brand#1') OR contains(lower(p_brand), 'brand#1') AS INT) AS matched FROM part)""")
def crawl_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("url_pattern"), F.col("p_size").alias("priority"))
    return crawl.prioritised(p, ["green", "brand#1"]).select("id", "matched", "rank_priority")


@query("SELECT page_id FROM pages WHERE (lower(url) LIKE 'http://%' OR lower(url) LIKE 'https://%') AND NOT lower(url) LIKE 'https://www.%'")
def crawl_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(crawl.allowed(F.col("url"), deny=["https://WWW."])).select("page_id")


@query("SELECT page_id, 'crawl_' || substr(CASE WHEN regexp_extract(regexp_replace(string_split(url, '?')[1], '/+$', ''), '([^/]*)$', 1) = '' THEN 'page' ELSE regexp_extract(regexp_replace(string_split(url, '?')[1], '/+$', ''), '([^/]*)$', 1) END, 1, 50) || '.txt' AS name FROM pages")
def crawl_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.crawl_filename(F.col("url")).alias("name"))


@query("""WITH t AS (SELECT conv_id AS session, CAST(sum(CASE WHEN length(text) % 11 > 0 AND turn % 3 < 2 THEN greatest(0, least(100, length(text) % 120 - 5)) END) AS BIGINT) AS s, count(CASE WHEN length(text) % 11 > 0 AND turn % 3 < 2 THEN 1 END) AS c FROM conversations GROUP BY conv_id)
SELECT session, coalesce(s, 0) AS score_sum, c AS score_count, CASE WHEN c > 0 THEN CAST(floor((2 * s + c) / (2 * c)) AS BIGINT) ELSE 0 END AS total_score FROM t""")
def score_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return interview.rebuilt_aggregate(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.when(n % 11 > 0, n % 120 - 5).alias("score"), (F.col("turn") % 3 == 2).alias("is_follow_up")))


@query("""WITH t AS (SELECT conv_id AS session, list(CASE WHEN turn % 4 < 3 THEN role END ORDER BY turn) AS l FROM conversations GROUP BY conv_id), x AS (SELECT session, unnest(l) AS turn, generate_subscripts(l, 1) AS seq FROM t) SELECT session, CAST(seq AS INT) AS seq, turn FROM x WHERE turn IS NOT NULL""")
def playback_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.when(x["turn"] % 4 < 3, x["role"]))
    return interview.playback(table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("session")).agg(kept.alias("turns")))


@query("""WITH w AS (SELECT conv_id AS session, turn AS seq, turn % 3 = 2 AS f, sum(CASE WHEN turn % 3 < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS main FROM conversations)
SELECT session, seq, CAST(main AS BIGINT) AS main, CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY session, main ORDER BY seq) AS BIGINT) AS follow_ups FROM w""")
def question_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interview.question_progress(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), (F.col("turn") % 3 == 2).alias("is_follow_up")))


@query("SELECT user_id AS session, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS at FROM events GROUP BY user_id")
def sessions_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = interview.sessions_by_time(table(spark, sf_dir, "events"), "user_id", "ts")
    return e.select(F.col("user_id").alias("session"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""WITH m AS (SELECT event_id AS id, props AS content, event_id % 13 = 0 AS superseded, CASE WHEN event_id % 3 > 0 THEN event_id % 4 END AS mentions, event_type AS new_content, CASE event_id % 4 WHEN 0 THEN 'contradiction' WHEN 1 THEN 'neutral' END AS verdict, CASE WHEN event_id % 2 = 0 THEN 'short' ELSE '' END AS layer FROM events),
u AS (SELECT *, NOT superseded AND NOT coalesce(verdict = 'contradiction', false) AS up FROM m)
SELECT id, CASE WHEN up THEN 'updated' ELSE 'added' END AS status, superseded OR coalesce(verdict = 'contradiction', false) AS superseded, CASE WHEN up AND NOT contains(content, new_content) THEN content || chr(10) || new_content ELSE content END AS content, CASE WHEN up AND layer = 'short' THEN coalesce(mentions, 0) + 1 ELSE mentions END AS mentions FROM u""")
def memory_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    m = table(spark, sf_dir, "events").select(
        i.alias("id"), F.col("props").alias("content"), (i % 13 == 0).alias("superseded"), F.when(i % 3 > 0, i % 4).alias("mentions"), F.col("event_type").alias("new_content"),
        F.when(i % 4 == 0, "contradiction").when(i % 4 == 1, "neutral").alias("verdict"), F.when(i % 2 == 0, "short").otherwise("").alias("layer"),
    )
    return memory.merged_duplicates(m)


@query("""WITH p AS (SELECT doc_id AS id, substr(text, 1, 40) AS content, source AS title, n_chars AS created_at, doc_id % 7 = 0 AS superseded FROM documents WHERE doc_id % 3 = 0),
c AS (SELECT d.doc_id % 10 AS qid, CASE WHEN p.id IS NOT NULL THEN p.content ELSE substr(text, 1, 30) END AS content, round((d.doc_id % 97) / 97, 4) AS score FROM documents d LEFT JOIN p ON p.id = d.doc_id - d.doc_id % 3 + CASE WHEN d.doc_id % 11 = 0 THEN 1 ELSE 0 END WHERE NOT coalesce(p.superseded, false))
SELECT qid, content, max(score) AS score FROM c WHERE coalesce(content, '') <> '' GROUP BY ALL""")
def memory_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    parents = d.where("doc_id % 3 = 0").select(i.alias("id"), F.substring("text", 1, 40).alias("content"), F.col("source").alias("title"), F.col("n_chars").alias("created_at"), (i % 7 == 0).alias("superseded"))
    children = d.select((i % 10).alias("qid"), F.substring("text", 1, 30).alias("content"), (i - i % 3 + F.when(i % 11 == 0, 1).otherwise(0)).alias("parent_id"), F.col("source").alias("title"), ((i % 97) / 97).alias("abs_cosine"), F.lit(None).cast("double").alias("hybrid_score"), F.col("n_chars").alias("created_at"))
    return memory.expanded(children, parents).select("qid", "content", "score")


@query(f"""WITH {CHANNELS_SQL}, f AS (SELECT qid, id, round(sum(1.0 / (60 + rnk)), 9) AS score FROM s GROUP BY qid, id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f),
v AS (SELECT qid, id, score AS abs_cosine FROM s WHERE channel = 'vector'),
par AS (SELECT qid, id - id % 3 AS id, max(score) AS score, max(abs_cosine) AS abs_cosine FROM r LEFT JOIN v USING (qid, id) WHERE rank <= 25 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM par)
SELECT qid, rank, id, score, abs_cosine, 0 AS round, false AS used_rewrite, substr(text, 1, 500) AS content FROM o JOIN documents ON doc_id = id WHERE rank <= 25""")
def request_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole request of 25 results: channels, fusion, parents, contents; a channel that fails is an error, not an empty one."""
    texts = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "parent_id", "text")
    e = table(spark, sf_dir, "embeddings")
    asked = benchmark_queries(spark, sf_dir).join(e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), "qid", "left")

    parts = {
        "fts": lambda queries, k: retrieval.bm25_of_texts(queries, texts.select("id", "text"), k),
        "vector": lambda queries, k: retrieval.nearest(queries.select("qid", "q"), e.select(F.col("vec_id").alias("id"), "embedding"), k),
        "graph": lambda queries, k: named_hits(queries, texts.select("id", "text"), k),
    }
    return request.answered(asked, parts, texts, request.Request(k=25, all_channels=True))
