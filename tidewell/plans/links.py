"""Page and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import crawl, entities, graph
from ..registry import query
from ..session import spread, table

URL_SQL = r"""lower(regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_replace(regexp_extract(regexp_replace(regexp_replace({0}, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', ''), '^([^/?]*)', 1), '^.*@', ''))
|| regexp_replace(regexp_extract(regexp_replace(regexp_replace({0}, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', ''), '^[^/?]*(/[^?]*)?', 1), '/+$', '') || regexp_extract(regexp_replace(regexp_replace({0}, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', ''), '(\?.*)$', 1)"""
LINKS_SQL = rf"""h AS (SELECT url, regexp_extract_all(html, 'href=["'']([^"'']+)', 1) AS l FROM pages), x AS (SELECT url, unnest(l) AS href, generate_subscripts(l, 1) - 1 AS pos FROM h WHERE len(l) > 0),
r AS (SELECT url, pos, CASE WHEN regexp_matches(href, '^(?i:https?)://') THEN href WHEN href LIKE '//%' THEN regexp_extract(url, '^([A-Za-z]+:)', 1) || href WHEN href LIKE '/%' THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || href
 WHEN href LIKE '#%' OR regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '([^/:])/[^/]*$', '\1') || '/' || href END AS target FROM x),
n AS (SELECT url, {URL_SQL.format("target")} AS target, pos FROM r WHERE target IS NOT NULL), o AS (SELECT url, target, min(pos) AS pos FROM n GROUP BY ALL),
links AS (SELECT url, target, pos FROM o QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) <= 20)"""


@query(f"SELECT page_id, {URL_SQL.format('url')} AS normal FROM pages")
def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.normalised_url(F.col("url")).alias("normal"))


@query("SELECT page_id, substr(trim(regexp_extract(html, '<(?i:title)>((?s:.*?))</(?i:title)>', 1)), 1, 200) AS title FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


@query(f"WITH {LINKS_SQL} SELECT * FROM links")
def page_title_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.links(spread(table(spark, sf_dir, "pages").select("url", "html")))


@query(f"WITH RECURSIVE {LINKS_SQL}, seeds AS (SELECT DISTINCT url FROM pages), w AS (SELECT url, 0 AS depth FROM seeds UNION SELECT l.target, w.depth + 1 FROM w JOIN links l ON l.url = w.url WHERE w.depth < 2) SELECT url, min(depth) AS depth FROM w GROUP BY url")
def link_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a crawl of depth 2 reaches from the pages."""
    pages = table(spark, sf_dir, "pages")
    return graph.crawled(graph.links(spread(pages.select("url", "html"))), pages.select("url"), 2)


@query("SELECT page_id, regexp_replace(url, '[^0-9A-Za-z.\\-_]', '_', 'g') AS name, substr(sha256(html), 1, 16) AS stored FROM pages")
def stored_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.safe_filename(F.col("url")).alias("name"), F.substring(F.sha2("html", 256), 1, 16).alias("stored"))


NAMES_SQL = T.PROPER_NAMES_SQL


def names(column: str = "text") -> F.Column:
    return F.array_sort(F.array_distinct(T.proper_names(F.col(column))))


@query(f"""WITH m AS (SELECT conv_id, turn, list_sort(list_distinct({NAMES_SQL.format("text")})) AS l FROM conversations), x AS (SELECT conv_id, turn, unnest(l) AS name FROM m)
SELECT x.name AS a, y.name AS b, count(*) AS n FROM x JOIN x y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.name < y.name GROUP BY ALL""")
def co_mention_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.co_mentions(table(spark, sf_dir, "conversations").select(names().alias("names")))


REL_SQL = "rel AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS source, l_suppkey AS target FROM lineitem)"


@query(f"WITH {REL_SQL}, ent AS (SELECT s_suppkey AS name FROM supplier WHERE s_acctbal > 9000) SELECT DISTINCT id, source, target, name FROM rel JOIN ent ON source = name OR target = name")
def or_join_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"))
    return graph.either_end(rel, table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_suppkey").alias("name")))


@query(f"""WITH e AS (SELECT DISTINCT doc_id AS id, unnest({NAMES_SQL.format("text")}) AS name FROM documents), q AS (SELECT DISTINCT item_id AS qid, unnest({NAMES_SQL.format("text")}) AS name FROM benchmark),
c AS (SELECT DISTINCT conv_id, unnest({NAMES_SQL.format("text")}) AS name FROM conversations), ed AS (SELECT DISTINCT x.name AS source, y.name AS target FROM c x JOIN c y ON x.conv_id = y.conv_id AND x.name <> y.name),
reach AS (SELECT qid, name FROM q UNION SELECT qid, target FROM q JOIN ed ON source = name), h AS (SELECT qid, id, CAST(count(DISTINCT name) AS DOUBLE) AS score FROM e JOIN reach USING (name) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM h) SELECT qid, id, score, rank FROM r WHERE rank <= 10""")
def entity_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the number of entities of the query, or next to one, that they name."""
    per = lambda t, key, new: table(spark, sf_dir, t).select(F.col(key).alias(new), F.explode(names()).alias("name")).distinct()
    talk = per("conversations", "conv_id", "conv_id")
    pairs = talk.groupBy("conv_id").agg(F.collect_set("name").alias("all"))
    edges = talk.join(pairs, "conv_id").select(F.col("name").alias("source"), F.explode("all").alias("target")).where("source <> target").distinct()
    return graph.graph_hits(graph.one_hop(per("benchmark", "item_id", "qid"), edges), per("documents", "doc_id", "id"), 10)


ALL_TYPES = [*entities.TYPES, "place", "other"]


@query(f"""WITH named AS (SELECT doc_id, unnest(list_distinct({NAMES_SQL.format("text")})) AS n FROM documents),
e AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lower(n) WHEN 1 THEN n || '.' ELSE n END AS name, ({ALL_TYPES})[length(n) % 13 + 1] AS type,
      CASE WHEN lower(n) LIKE 'th%' THEN substr(lower(n), 2) ELSE lower(n) END AS key FROM named),
k AS (SELECT substr(sha256(key || '|' || type), 1, 16) AS entity_id, * FROM e WHERE list_contains({list(entities.TYPES)}, type)),
s AS (SELECT entity_id, name, count(*) AS n FROM k GROUP BY ALL)
SELECT entity_id, first(s.name ORDER BY n DESC, s.name) AS name, any_value(type) AS type, any_value(n_docs) AS n_docs, count(*) AS n_names
FROM s JOIN (SELECT entity_id, any_value(type) AS type, count(DISTINCT doc_id) AS n_docs FROM k GROUP BY entity_id) USING (entity_id) GROUP BY entity_id""")
def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities from answers in JSON, one for each document: spellings and aliases of one key and type united, types that are not allowed left out."""
    docs = table(spark, sf_dir, "documents")
    n = lambda x: F.when(F.col("doc_id") % 3 == 0, F.lower(x)).when(F.col("doc_id") % 3 == 1, F.concat(x, F.lit("."))).otherwise(x)
    kinds = F.array(*[F.lit(k) for k in ALL_TYPES])
    told = F.transform(F.array_distinct(T.proper_names(F.col("text"))), lambda x: F.struct(n(x).alias("name"), F.get(kinds, F.length(x) % 13).alias("type")))
    found, _ = entities.answered(docs.select("doc_id", F.to_json(F.struct(told.alias("entities"))).alias("json")))
    aliases = found.where("lower(name) LIKE 'th%'").select(F.col("name").alias("alias"), F.expr("substr(name, 2)").alias("name")).distinct()
    return entities.merged(entities.normalised(found, aliases))


@query("""WITH host AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/]+/') AS h FROM pages),
r AS (SELECT h AS prefix, 'host' AS rule, bool_or(page_id % 40 = 0) AS skip FROM host WHERE page_id % 2 = 0 GROUP BY h
      UNION ALL SELECT url, 'page', page_id % 3 = 0 FROM host WHERE page_id % 5 = 0 UNION ALL SELECT '  ', 'blank', true UNION ALL SELECT 'http', 'any', false),
d AS (SELECT prefix, min(rule) AS rule, bool_or(skip) AS skip FROM r WHERE trim(prefix) <> '' GROUP BY prefix),
m AS (SELECT page_id, arg_max(prefix, length(prefix)) AS prefix, arg_max(rule, length(prefix)) AS rule, bool_or(skip) AS skipped FROM pages JOIN d ON starts_with(url, prefix) GROUP BY page_id)
SELECT page_id AS id, prefix, rule, coalesce(skipped, false) AS skipped FROM pages LEFT JOIN m USING (page_id)""")
def prefix_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule of each page's address: of the page itself, of its host, or of all; a skipped host skips its pages."""
    pages = table(spark, sf_dir, "pages")
    host = pages.withColumn("h", F.regexp_extract("url", "^[a-z]+://[^/]+/", 0))
    rules = host.where("page_id % 2 = 0").groupBy(F.col("h").alias("prefix")).agg(F.lit("host").alias("rule"), F.bool_or(F.col("page_id") % 40 == 0).alias("skip"))
    rules = rules.unionByName(pages.where("page_id % 5 = 0").select(F.col("url").alias("prefix"), F.lit("page").alias("rule"), (F.col("page_id") % 3 == 0).alias("skip")))
    rules = rules.unionByName(spark.sql("SELECT prefix, rule, skip FROM VALUES ('  ', 'blank', true), ('http', 'any', false) AS t(prefix, rule, skip)"))
    return crawl.ruled(pages.select(F.col("page_id").alias("id"), F.col("url").alias("uri")), rules).drop("uri")


@query()
def crawl_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What four sources crawl, each from its share of the pages, with depths of one to three and budgets of pages."""
    pages = table(spark, sf_dir, "pages")
    sources = spark.range(4).select(F.col("id").alias("source"), (F.col("id") % 3 + 1).cast("int").alias("max_depth"), (F.col("id") * 40 + 30).alias("max_pages"))
    seeds = pages.where("page_id % 10 = 0").select((F.col("page_id") / 10 % 4).cast("long").alias("source"), "url", F.col("page_id").alias("pos"))
    return graph.crawled_within(graph.links(pages), seeds, sources)
