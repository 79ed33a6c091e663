"""Entities, relations and link graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hrefs, normalised_url, resolved
from ..session import new_path, small, written


def links(pages: DataFrame, most: int = 20) -> DataFrame:
    """url, target, pos: the first `most` distinct http(s) links of each page, resolved and normalised."""
    found = pages.select("url", F.posexplode(hrefs(F.col("html"))).alias("pos", "href"))
    found = found.select("url", "pos", normalised_url(resolved(F.col("href"), F.col("url"))).alias("target")).where(F.col("target").isNotNull())
    once = found.groupBy("url", "target").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("url").orderBy("pos")
    return once.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("url", "target", "pos")


def either_end(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations (id, source, target) that touch an entity (name) at either end: two equi joins and a union in place of an OR."""
    at = lambda end: relations.join(small(entities), F.col(end) == F.col("name")).select("id", "source", "target", "name")
    return at("source").union(at("target")).distinct()


def co_mentions(mentions: DataFrame) -> DataFrame:
    """Pairs (a, b, n) of entities of one event (event, names): each unordered pair within the event's own short list."""
    pairs = F.flatten(F.transform("names", lambda a, i: F.transform(F.slice("names", i + 2, F.greatest(F.size("names") - i - 1, F.lit(0))), lambda b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))))
    return mentions.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def one_hop(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, name): the seeds and their outgoing neighbours."""
    return seeds.select("qid", "name").union(edges.join(small(seeds), F.col("source") == F.col("name")).select("qid", F.col("target").alias("name"))).distinct()


def graph_hits(reached: DataFrame, mentions: DataFrame, k: int) -> DataFrame:
    """qid, id, score: documents (id, name) by the number of distinct reached names they hold."""
    counted = mentions.join(small(reached), "name").groupBy("qid", "id").agg(F.countDistinct("name").cast("double").alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def crawled(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(url, depth): pages reached from seeds (url) by at most `depth` links, each at its least depth. Edges and each level are written, so a level reads tables and plans no other."""
    edges = written(edges.select("url", "target"), "edges")
    levels = [written(seeds.select("url").distinct(), "level")]
    seen = levels[0]
    for _ in range(depth):
        reached = edges.join(levels[-1], "url").select(F.col("target").alias("url")).distinct()
        levels.append(written(reached.join(seen, "url", "left_anti"), "level"))
        seen = seen.unionByName(levels[-1])
    out = levels[0].withColumn("depth", F.lit(0))
    for d, level in enumerate(levels[1:]):
        out = out.unionByName(level.withColumn("depth", F.lit(d + 1)))
    return out


def crawled_within(edges: DataFrame, seeds: DataFrame, sources: DataFrame) -> DataFrame:
    """source, url, depth, rank of what each source of `sources` (source, max_depth, max_pages) crawls, breadth first, from its seeds (source, url, pos) over edges (url, target, pos).

    A source visits a page once; pages of a level come in the order of the pages that link to them and of the links there, and the source ends at its number of pages or its depth.
    A level is one join of the frontier with the edges and one window; it reads the levels before as one folder of tables, so its plan does not grow with them."""
    spark = edges.sparkSession
    edges = written(edges.select("url", "target", "pos").where("target IS NOT NULL"), "edges")
    folder = new_path(spark, "crawl")
    limits = sources.groupBy("source").agg(F.min("max_depth").alias("max_depth"), F.min("max_pages").alias("max_pages"))
    bounds = limits.agg(F.max("max_depth"), F.max("max_pages")).first()
    schema = f"source {dict(sources.dtypes)['source']}, url string, depth int, rank long"
    if bounds[0] is None:
        return spark.createDataFrame([], schema)

    def stored(candidates: DataFrame, depth: int) -> DataFrame:
        """The pages of a level within their sources' limits; candidates have source, url, place (their order) and n, the pages that the source has."""
        first = candidates.groupBy("source", "url").agg(F.min("place").alias("place"), F.max("n").alias("n"))
        order = Window.partitionBy("source").orderBy("place", "url")
        ranked = first.withColumn("own", F.row_number().over(order)).where(F.col("own") <= bounds[1])  # a bound for all sources, so that tasks keep no more
        within = ranked.join(small(limits, sources), "source").where((F.col("n") + F.col("own") <= F.col("max_pages")) & (F.lit(depth) <= F.col("max_depth")))
        level = within.select("source", "url", F.lit(depth).alias("depth"), (F.col("n") + F.col("own")).cast("long").alias("rank"))
        level.write.parquet(f"{folder}/{depth}")
        return spark.read.schema(schema).parquet(f"{folder}/{depth}")

    front = stored(seeds.select("source", "url", F.struct(F.lit(0).cast("long").alias("r"), F.col("pos").cast("long").alias("p")).alias("place"), F.lit(0).cast("long").alias("n")), 0)
    for depth in range(1, bounds[0] + 1):
        if front.isEmpty():
            break
        seen = spark.read.schema(schema).parquet(f"{folder}/*")
        counts = seen.groupBy("source").agg(F.count("*").alias("n"))
        reached = front.join(edges, "url").select("source", F.col("target").alias("url"), F.struct(F.col("rank").alias("r"), F.col("pos").cast("long").alias("p")).alias("place"))
        new = reached.join(seen.select("source", "url"), ["source", "url"], "left_anti")
        front = stored(new.join(small(counts, sources), "source"), depth)
    return spark.read.schema(schema).parquet(f"{folder}/*")
