"""Retrieval queries. A document's embedding is the vector of its number; each benchmark passage is a query, whose vector is that of its item number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import PROPER_NAMES_SQL, proper_names, tokens
from ..operators import documents, fusion, inverted_index, near_vectors, retrieval, segmentation, vector_index
from ..registry import query
from ..session import small, spread, table

TOKENS_SQL = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
BM25_SQL = f"""
p AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({TOKENS_SQL.format("text")}) AS term FROM documents) GROUP BY ALL),
len AS (SELECT id, sum(tf) AS length FROM p GROUP BY id),
tot AS (SELECT count(*) AS n, avg(length) AS mean FROM len),
asked AS (SELECT item_id AS qid, unnest(list_distinct({TOKENS_SQL.format("text")})) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
hit AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)))), 9) AS score, count(*) AS matched
        FROM p JOIN asked USING (term) JOIN df USING (term) JOIN len USING (id) CROSS JOIN tot GROUP BY qid, id)"""
KNN_SQL = """
knn AS (SELECT b.item_id AS qid, e.vec_id AS id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS score
        FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id CROSS JOIN embeddings e)"""
TOP = "row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)"
GRAPH_SQL = f"""
ent AS (SELECT doc_id AS id, unnest(list_distinct({PROPER_NAMES_SQL.format("text")})) AS name FROM documents),
qent AS (SELECT item_id AS qid, unnest(list_distinct({PROPER_NAMES_SQL.format("text")})) AS name FROM benchmark),
graph AS (SELECT qid, id, CAST(count(DISTINCT name) AS DOUBLE) AS score FROM ent JOIN qent USING (name) GROUP BY qid, id)"""
CHANNELS_SQL = f"""{BM25_SQL}, {KNN_SQL}, {GRAPH_SQL},
c AS (SELECT 'fts' AS channel, qid, id, score FROM hit QUALIFY {TOP} <= 50 UNION ALL SELECT 'vector', qid, id, score FROM knn QUALIFY {TOP} <= 50
      UNION ALL SELECT 'graph', qid, id, score FROM graph QUALIFY {TOP} <= 50),
nrm AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi, row_number() OVER (PARTITION BY qid, channel ORDER BY score DESC, id) AS rnk FROM c WINDOW w AS (PARTITION BY qid, channel)),
s AS (SELECT *, CASE WHEN hi - lo < 1e-9 THEN 1.0 ELSE (score - lo) / (hi - lo) END AS normalised FROM nrm)"""


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def fts_hits(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return retrieval.bm25_of_texts(benchmark_queries(spark, sf_dir), spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")), **options)


def vector_hits(spark: SparkSession, sf_dir: str, k: int | None) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = e.join(small(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))), "vec_id").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return retrieval.nearest(asked, e.select(F.col("vec_id").alias("id"), "embedding"), k)


def entities(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col(name), F.explode(F.array_distinct(proper_names(F.col("text")))).alias("name"))


def named_hits(queries: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The k texts (id, text) with the most names of each query (qid, text)."""
    return retrieval.shared_terms(entities(queries, "qid").withColumnRenamed("name", "term"), texts.select("id", F.array_distinct(proper_names(F.col("text"))).alias("words")), k)


def graph_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return named_hits(benchmark_queries(spark, sf_dir), spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")), k)


def channels(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    """The candidates of the three channels."""
    parts = {"fts": fts_hits(spark, sf_dir, k=k), "vector": vector_hits(spark, sf_dir, k), "graph": graph_hits(spark, sf_dir, k)}
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("channel"), "qid", "id", "score")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {CHANNELS_SQL},
f AS (SELECT qid, id, round(sum(1.0 / (60 + rnk)), 9) AS rrf_score FROM s GROUP BY qid, id),
h AS (SELECT *, min(rrf_score) OVER (PARTITION BY qid) AS l, max(rrf_score) OVER (PARTITION BY qid) AS u FROM f),
r AS (SELECT qid, id, rrf_score, round(CASE WHEN u - l < 1e-9 THEN 1.0 ELSE (rrf_score - l) / (u - l) END, 6) AS hybrid_score,
      row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, id) AS rank FROM h)
SELECT * FROM r WHERE rank <= 5""")
def fuse_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: three channels, reciprocal rank fusion, the five best of each query."""
    fused = fusion.reciprocal_rank_fusion(channels(spark, sf_dir))
    return fusion.best(fused, 5, "rrf_score").select("qid", "id", "rrf_score", F.round("hybrid_score", 6).alias("hybrid_score"), "rank")


@query(f"""WITH {CHANNELS_SQL},
f AS (SELECT qid, id, round(sum(CASE channel WHEN 'fts' THEN 0.3 WHEN 'vector' THEN 0.6 ELSE 0.1 END * normalised), 9) AS score FROM s GROUP BY qid, id),
r AS (SELECT qid, id, score AS hybrid_score, {TOP} AS rank FROM f)
SELECT * FROM r WHERE rank <= 10""")
def fuse_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.best(fusion.weighted_fusion(channels(spark, sf_dir)), 10, "hybrid_score")


@query(f"""WITH {CHANNELS_SQL},
f AS (SELECT qid, id, round(0.3 * coalesce(max(CASE WHEN channel = 'fts' THEN normalised END), 0) + 0.7 * coalesce(max(CASE WHEN channel = 'vector' THEN normalised END), 0), 9) AS score,
      max(CASE WHEN channel = 'vector' THEN score END) AS abs_cosine FROM s WHERE channel <> 'graph' GROUP BY qid, id),
r AS (SELECT qid, id, score AS hybrid_score, abs_cosine, {TOP} AS rank FROM f)
SELECT * FROM r WHERE rank <= 10""")
def fuse_hybrid_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.best(fusion.alpha_fusion(channels(spark, sf_dir).where("channel <> 'graph'")), 10, "hybrid_score")


@query(f"""WITH {CHANNELS_SQL}, ks AS (SELECT unnest(range(20, 101, 10)) AS k),
f AS (SELECT k, qid, id, round(sum(1.0 / (k + rnk)), 9) AS score FROM s CROSS JOIN ks GROUP BY k, qid, id),
r AS (SELECT *, row_number() OVER (PARTITION BY k, qid ORDER BY score DESC, id) AS rank FROM f)
SELECT k, count(*) AS n_hits, sum(id) AS id_sum, round(avg(score), 6) AS mean_score FROM r WHERE rank <= 5 GROUP BY k""")
def rrf_k_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the five best change with the rank constant: ranks are taken once, constants joined after."""
    ranks = fusion.ranked(channels(spark, sf_dir))
    by = ranks.crossJoin(F.broadcast(spark.range(20, 101, 10).withColumnRenamed("id", "k")))  # nine constants
    fused = by.groupBy("k", "qid", "id").agg(F.round(F.sum(1.0 / (F.col("k") + F.col("rank"))), 9).alias("score"))
    return fusion.best(fused, 5, keys=("k", "qid")).groupBy("k").agg(F.count("*").alias("n_hits"), F.sum("id").alias("id_sum"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(f"WITH {KNN_SQL}, r AS (SELECT *, {TOP} AS rank FROM knn) SELECT * FROM r WHERE rank <= 10")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_hits(spark, sf_dir, 10)


@query(f"WITH {KNN_SQL}, r AS (SELECT *, {TOP} AS rank FROM knn) SELECT * FROM r WHERE rank <= 10")
def index_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stored index of inverted lists, exactly."""
    e = table(spark, sf_dir, "embeddings")
    index = vector_index.scratch_index(spark).build(e.select(F.col("vec_id").alias("id"), "embedding"), lists=16)
    asked = e.join(small(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))), "vec_id")
    return index.search(asked.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), 10)


@query(f"WITH {BM25_SQL}, r AS (SELECT qid, id, score, {TOP} AS rank FROM hit) SELECT * FROM r WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fts_hits(spark, sf_dir, k=10)


UPDATED_SQL = BM25_SQL.replace("FROM documents", """FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 2 THEN replace(text, ' a ', ' the benchmark ') ELSE text END AS text
        FROM documents WHERE doc_id % 7 <> 5)""")


@query(f"WITH {UPDATED_SQL}, r AS (SELECT qid, id, score, {TOP} AS rank FROM hit) SELECT * FROM r WHERE rank <= 10")
def index_search_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents by a stored index, after a first load, an append, a deletion and an update."""
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    index = inverted_index.scratch_index(spark, buckets=64)
    index.appended(docs.where("id % 3 <> 0"))
    index.appended(docs.where("id % 3 = 0"))
    changed = docs.where("id % 7 = 2").withColumn("text", F.replace("text", F.lit(" a "), F.lit(" the benchmark ")))
    index.updated(changed, docs.where("id % 7 = 5").select("id"))
    return index.search(benchmark_queries(spark, sf_dir), 10)


@query(f"WITH {BM25_SQL}, want AS (SELECT qid, count(*) AS w FROM asked GROUP BY qid), r AS (SELECT qid, id, score, {TOP} AS rank FROM hit JOIN want USING (qid) WHERE matched = w) SELECT * FROM r WHERE rank <= 10")
def fts_and_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with every term of the query."""
    return fts_hits(spark, sf_dir, k=10, match_all=True)


@query(f"WITH {BM25_SQL} SELECT item_id AS qid, item_id IN (SELECT qid FROM asked JOIN p USING (term) WHERE length(term) >= 2) AS term_hit FROM benchmark")
def term_hit_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any term of two characters or more of a query is indexed."""
    asked = benchmark_queries(spark, sf_dir)
    terms = asked.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).where(F.length("term") >= 2)
    index = table(spark, sf_dir, "documents").select(F.explode(tokens(F.col("text"))).alias("term"))
    found = index.join(small(terms), "term").select("qid").distinct().withColumn("hit", F.lit(True))
    return asked.select("qid").join(found, "qid", "left").select("qid", F.coalesce("hit", F.lit(False)).alias("term_hit"))


EXPAND_SQL = f"""WITH {CHANNELS_SQL},
f AS (SELECT qid, id, round(0.3 * coalesce(max(CASE WHEN channel = 'fts' THEN normalised END), 0) + 0.7 * coalesce(max(CASE WHEN channel = 'vector' THEN normalised END), 0), 9) AS score,
      max(CASE WHEN channel = 'vector' THEN score END) AS abs_cosine FROM s WHERE channel <> 'graph' GROUP BY qid, id),
e AS (SELECT qid, coalesce(p.parent_id, f.id) AS id, max(score) AS hybrid_score, max(abs_cosine) AS abs_cosine, count(*) AS n_children
      FROM f LEFT JOIN (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY sha256(text)) AS parent_id FROM documents) p ON p.id = f.id GROUP BY 1, 2)"""


def hybrid_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.alpha_fusion(channels(spark, sf_dir).where("channel <> 'graph'"))
    docs = table(spark, sf_dir, "documents")
    parents = docs.select(F.col("doc_id").alias("id"), F.min("doc_id").over(Window.partitionBy(F.sha2("text", 256))).alias("parent_id"))
    return retrieval.expanded_to_parents(fused, parents)


@query(EXPAND_SQL + " SELECT * FROM e")
def expand_to_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits handed to their parents, here the first document of equal text."""
    return hybrid_hits(spark, sf_dir)


@query(EXPAND_SQL + """, t AS (SELECT qid, count(*) AS n, arg_max(abs_cosine, hybrid_score * 1e7 - id * 1e-3) AS x, first(abs_cosine ORDER BY hybrid_score DESC, id) AS top_cosine FROM e GROUP BY qid)
SELECT qid, n, round(top_cosine, 6) AS top_cosine, NOT (n < 2 OR coalesce(top_cosine < 0.55, false)) AS sufficient, coalesce(top_cosine < 0.3, false) AS suspect FROM t""")
def sufficiency_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = hybrid_hits(spark, sf_dir).withColumn("abs_cosine", F.coalesce("abs_cosine", F.lit(float("nan"))))
    told = retrieval.sufficient(hits.withColumn("abs_cosine", F.nanvl("abs_cosine", F.lit(None).cast("double"))))
    return told.withColumn("top_cosine", F.round("top_cosine", 6))


PAIRS_SQL = """SELECT a.vec_id AS id, b.vec_id AS other_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) >= {0}"""


@query(PAIRS_SQL.format(0.95))
def knn_threshold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic duplicates: vectors with an inner product of 0.95 or more."""
    return rounded_pairs(spark, sf_dir, 0.95)


@query(PAIRS_SQL.format(0.4))
def knn_related_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related vectors: an inner product of 0.4 or more."""
    return rounded_pairs(spark, sf_dir, 0.4)


def rounded_pairs(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.similar_pairs(e, least).select("id", "other_id", F.round("score", 6).alias("score"))


#: The embeddings, and a near copy of each fourth one, its components moved a little and brought to length 1; copies are also repeated under a third id.
PLANTED_SQL = """
m AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x + 0.01 * ((i * 7 + vec_id) % 5 - 2)) AS v FROM embeddings WHERE vec_id % 4 = 0),
u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM m),
p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings UNION ALL SELECT vec_id + 1000000, v FROM u UNION ALL SELECT vec_id + 2000000, v FROM u WHERE vec_id % 8 = 0),
h AS (SELECT min(id) AS id, v FROM p GROUP BY v)"""


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    moved = F.transform("v", lambda x, i: x + 0.01 * (((i + 1) * 7 + F.col("vec_id")) % 5 - 2))
    unit = e.where("vec_id % 4 = 0").withColumn("v", moved).withColumn("v", F.expr("transform(v, x -> x / sqrt(aggregate(v, 0D, (a, y) -> a + y * y)))"))
    copies = unit.select((F.col("vec_id") + 1_000_000).alias("id"), "v").unionByName(unit.where("vec_id % 8 = 0").select((F.col("vec_id") + 2_000_000).alias("id"), "v"))
    return e.select(F.col("vec_id").alias("id"), "v").unionByName(copies).withColumnRenamed("v", "embedding")


@query(f"""WITH {PLANTED_SQL} SELECT a.id, b.id AS other_id, round(list_dot_product(a.v, b.v), 6) AS score
FROM h a JOIN h b ON a.id < b.id WHERE round(list_dot_product(a.v, b.v), 9) >= 0.95""")
def near_vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted near copies found by bands of signs; equal copies stand as one."""
    return near_vectors.near_pairs(planted(spark, sf_dir), 0.95).select("id", "other_id", F.round("score", 6).alias("score"))


@query(f"WITH {PLANTED_SQL} SELECT p.id, h.id AS head FROM p JOIN h ON h.v = p.v")
def equal_vector_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For whom a vector of the pairs stands."""
    return near_vectors.members(planted(spark, sf_dir))


@query()
def canonical_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical row of each vector that is related to another: rows in order, each joins its best earlier canonical one."""
    pairs = rounded_pairs(spark, sf_dir, 0.4).select(F.col("other_id").alias("id"), F.col("id").alias("earlier_id"), "score")
    return documents.greedy_canonical(pairs)


@query()
def segmented_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words found again in texts without spaces: letters a to z turned into ideographs, spaces left out, the lexicon being all words of the documents."""
    letters, ideographs = "abcdefghijklmnopqrstuvwxyz", "".join(chr(0x4E00 + k) for k in range(26))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "").alias("words"))
    turned = F.transform("words", lambda w: F.translate(w, letters, ideographs))
    docs = docs.where("words IS NOT NULL").select("doc_id", turned.alias("words"))
    lexicon = docs.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    found = segmentation.with_words(docs.withColumn("text", F.array_join("words", "")), "text", "found", lexicon)
    return found.select("doc_id", F.size("words").alias("n_words"), F.size("found").alias("n_found"), F.size(F.array_intersect("words", "found")).alias("n_same"))
