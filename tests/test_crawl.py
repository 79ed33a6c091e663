"""Crawls within budgets against a queue, page by page."""

import random

from pyspark.sql import functions as F

from tidewell.operators import graph
from tidewell.plans import links


def by_queue(edges, seeds, sources):
    out = []
    for source, (depth, pages) in sources.items():
        found, level = {}, []
        for _, url in sorted((p, u) for s, u, p in seeds if s == source):
            if url not in found and len(found) < pages:
                found[url] = (0, len(found) + 1)
                level.append(url)
        for d in range(1, depth + 1):
            after = []
            for url in level:
                for target in edges.get(url, []):
                    if target not in found and len(found) < pages:
                        found[target] = (d, len(found) + 1)
                        after.append(target)
            level = after
        out += [(source, u, *v) for u, v in found.items()]
    return sorted(out)


def test_budgets(spark):
    rng = random.Random(2)
    edges = {f"p{i}": [f"p{rng.randrange(300)}" for _ in range(rng.randrange(8))] for i in range(300)}
    sources = {1: (3, 60), 2: (2, 1000), 3: (0, 5), 4: (9, 25), 5: (4, 0)}
    seeds = [(rng.randrange(1, 6), f"p{rng.randrange(300)}", k) for k in range(30)]
    e = spark.createDataFrame([(u, t, k) for u, ts in edges.items() for k, t in enumerate(ts)] + [("p1", None, 99)], "url string, target string, pos int")
    s = spark.createDataFrame([(k, *v) for k, v in sources.items()], "source long, max_depth int, max_pages long")
    got = graph.crawled_within(e, spark.createDataFrame(seeds, "source long, url string, pos int"), s)
    assert sorted((r["source"], r["url"], r["depth"], r["rank"]) for r in got.collect()) == by_queue(edges, seeds, sources)
    assert graph.crawled_within(e, spark.createDataFrame([], "source long, url string, pos int"), s).count() == 0
    assert graph.crawled_within(e, spark.createDataFrame(seeds, "source long, url string, pos int"), s.where("false")).count() == 0


def test_query_within_its_budgets(spark):
    rows = links.crawl_within_budget(spark, "/root/testdata/sf0.01")
    for r in rows.groupBy("source").agg(F.count("*").alias("n"), F.max("rank").alias("top"), F.max("depth").alias("depth"), F.countDistinct("url").alias("urls")).collect():
        assert r["n"] == r["top"] == r["urls"] <= r["source"] * 40 + 30 and r["depth"] <= r["source"] % 3 + 1
