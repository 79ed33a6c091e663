"""Document queries over documents and the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as D
from ..registry import query
from ..sources import layout, tables
from ..session import small, spread, table


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("SELECT source, min(doc_id) AS id, count(doc_id) AS chunk_count FROM documents GROUP BY source ORDER BY id LIMIT 10 OFFSET 5")
def doc_listing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = docs(spark, sf_dir).groupBy("source").agg(F.min("doc_id").alias("id"), F.count("doc_id").alias("chunk_count"))
    return w.orderBy("id").offset(5).limit(10)


@query("SELECT lang, count(DISTINCT source) AS n_titles, count(*) AS n_rows, sum(n_chars) AS n_chars FROM documents GROUP BY lang")
def listing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy("lang").agg(F.countDistinct("source").alias("n_titles"), F.count("*").alias("n_rows"), F.sum("n_chars").alias("n_chars"))


@query("""SELECT d.doc_id, d.source, count(c.line) AS child_count FROM documents d LEFT JOIN (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) c ON c.doc_id = d.doc_id AND length(c.line) >= 50
GROUP BY d.doc_id, d.source""")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of each parent; parents without one count 0."""
    d = docs(spark, sf_dir)
    lines = d.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") >= 50).groupBy("doc_id").agg(F.count("*").alias("n"))
    return d.select("doc_id", "source").join(lines, "doc_id", "left").select("doc_id", "source", F.coalesce("n", F.lit(0)).alias("child_count"))


@query("SELECT doc_id AS id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id FROM documents) WHERE first_id < doc_id")
def exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.exact_duplicates(docs(spark, sf_dir), "doc_id", "text")


@query("SELECT doc_id, sha256(text) AS content_hash, substr(sha256(concat_ws('|', source, lang)), 1, 16) AS cache_key FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.sha256(F.col("text")).alias("content_hash"), T.cache_key(F.col("source"), F.col("lang")).alias("cache_key"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT (trim(x) <> '' AND regexp_matches(trim(x),
'^(?i:第\s*\d+\s*页|page\s*\d+(\s*(of|/)\s*\d+)?|(版权所有|copyright|©|all rights reserved)[^。；]*|免责声明[^。；]*)\s*[。；]?\s*$'))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS clean FROM documents""")
def boilerplate_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(T.strip_boilerplate(F.col("text"))).alias("clean"))


@query(r"""SELECT doc_id, len(list_filter(l, lambda x: regexp_matches(trim(x), '^(?i:page\s*\d+(\s*(of|/)\s*\d+)?|\d{1,4})\s*$'))) AS n_furniture,
len(list_filter(l, lambda x: NOT regexp_matches(x, '[一-鿿A-Za-z0-9]'))) AS n_noise FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def page_furniture_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    return docs(spark, sf_dir).select("doc_id", F.size(F.filter(lines, T.is_page_furniture)).alias("n_furniture"), F.size(F.filter(lines, T.is_noise)).alias("n_noise"))


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents and children of every document; the splitter is no SQL, so tests hold it against examples and properties."""
    return D.chunk_rows(spread(docs(spark, sf_dir).select("doc_id", "text"))).select("doc_id", "parent", "title", "parent_chars", "child", F.length("content").alias("child_chars"))


@query()
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.md5(D.cleaned(F.col("text"))).alias("clean"), F.length(D.normalised(F.col("text"))).alias("normal_chars"))


@query("""WITH stored AS (SELECT source, list_sort(list_distinct(list(lang))) AS langs FROM documents WHERE doc_id % 4 < 2 GROUP BY source),
new AS (SELECT source, [lang] AS langs FROM documents WHERE doc_id % 4 >= 2)
SELECT source, list_sort(list_distinct(flatten(list(langs)))) AS langs FROM (SELECT * FROM stored UNION ALL SELECT * FROM new) GROUP BY source""")
def array_merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored arrays by key, merged with those of new rows."""
    d = docs(spark, sf_dir)
    stored = tables.merged_ids(d.where("doc_id % 4 < 2").select("source", F.array("lang").alias("langs")), ["source"], "langs")
    return tables.merged_ids(stored.unionByName(d.where("doc_id % 4 >= 2").select("source", F.array("lang").alias("langs"))), ["source"], "langs")


@query("""SELECT doc_id // 5 AS root, string_agg(text, chr(10) ORDER BY doc_id) AS content, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def reassemble_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a document, here five rows, joined in order of their id."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"])
    d = docs(spark, sf_dir).where("text IS NOT NULL")
    return d.groupBy(F.floor(F.col("doc_id") / 5).alias("root")).agg(F.array_join(parts, "\n").alias("content"), F.min("doc_id").alias("first_id"))


@query("SELECT doc_id FROM documents WHERE (source IS NULL OR source NOT LIKE 'src1%') AND lower(text) LIKE '% the %' AND lang IN ('en', 'de')")
def source_guard_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null-safe guard on the source, a substring in any case and a list."""
    return docs(spark, sf_dir).where((F.col("source").isNull() | ~F.col("source").like("src1%")) & F.lower("text").contains(" the ") & F.col("lang").isin("en", "de")).select("doc_id")


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which passage word for word: passages meet only documents that have the rarest of their inner words, which stand between spaces; the few
    passages without one meet all."""
    d, b = docs(spark, sf_dir), table(spark, sf_dir, "benchmark")
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    parts = F.split(F.col("text"), " ")
    inner = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: x.rlike(r"^\p{L}+$"))
    asked = b.select("item_id", F.explode(F.array_distinct(inner)).alias("word"))
    bare = b.where(F.size(inner) == 0).select("item_id", F.col("text").alias("passage"))
    index = d.select("doc_id", F.explode(words(F.col("text"))).alias("word"))
    frequency = index.join(small(asked.select("word").distinct()), "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    rarest = asked.join(frequency, "word").groupBy("item_id").agg(F.min_by("word", F.struct("df", "word")).alias("word"))
    found = index.join(small(rarest), "word").join(small(b.withColumnRenamed("text", "passage")), "item_id").join(d.select("doc_id", "text"), "doc_id")
    held = found.where(F.contains("text", "passage")).select("item_id", "doc_id")
    return held.union(d.join(small(bare), F.contains("text", "passage")).select("item_id", "doc_id"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[a-z]+'), 1) AS pos FROM documents WHERE length(text) > 0),
g AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first_pos FROM w WHERE length(word) >= 2 AND word NOT IN ('the', 'and', 'of', 'to', 'in', 'is', 'that') GROUP BY doc_id, word),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS rank FROM g)
SELECT doc_id, word, n, rank FROM r WHERE rank <= 8""")
def keyword_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight most frequent words of each text; ties to the first seen."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))
    kept = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin("the", "and", "of", "to", "in", "is", "that"))
    return D.frequent_words(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), kept.alias("words")).where(F.size("words") > 0), 8).withColumnRenamed("id", "doc_id")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("o")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(best).select("o_custkey", "o.o_orderkey", "o.o_totalprice")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def orphan_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""SELECT n_name, c_mktsegment, count(*) AS n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_returnflag IN ('A', 'N') GROUP BY ALL""")
def report_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters reach the scans, the small nation table is broadcast by its size, the rest joins on keys."""
    li = table(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")) & F.col("l_returnflag").isin("A", "N"))
    joined = li.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n_orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND lower(o_orderpriority) LIKE '%high%' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 20")
def dynamic_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional predicates, order and a page: page 2 of 20."""
    from ..operators.interview import page_of

    return page_of(table(spark, sf_dir, "orders"), {"o_orderstatus": "F"}, {"o_orderpriority": "high"}, [("o_totalprice", False), ("o_orderkey", True)], 2, 20).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST((place * 7919) % 1000003 AS BIGINT) AS block, CAST(place AS BIGINT) AS place FROM l""")
def page_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines set as a heading and three columns, their blocks numbered at random, in order again."""
    lines = docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"), F.size(F.split("text", "\n")).alias("n"))
    high = F.greatest(F.lit(1), F.ceil((F.col("n") - 1) / 3))
    column, row, first = F.floor((F.col("k") - 1) / high), (F.col("k") - 1) % high, F.col("k") == 0
    x0, y0 = F.when(first, 0).otherwise(column * 100 + 5), F.when(first, 0).otherwise(row * 12 + 30)
    x1, y1 = F.when(first, 300).otherwise(x0 + 85), F.when(first, 20).otherwise(y0 + 10 - column)
    blocks = lines.select("doc_id", ((F.col("k") + 1) * 7919 % 1_000_003).cast("long").alias("block"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    return layout.reading_order(blocks, "doc_id")
