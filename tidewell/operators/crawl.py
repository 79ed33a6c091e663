"""Crawling's bookkeeping: allowed addresses, priorities, the queue, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small
from .search import starts_with_any

#: Fixed value: what each matching keyword adds to a source's priority.
BOOST = 10


def allowed(url: Column, allow: Sequence[str] = (), deny: Sequence[str] = ()) -> Column:
    """An http(s) address that begins with an allowed prefix, if any are given, and with no denied one; case plays no part."""
    web = starts_with_any(url, ("http://", "https://"))
    return web & (starts_with_any(url, allow) if allow else F.lit(True)) & ~starts_with_any(url, deny)


def prioritised(sources: DataFrame, keywords: Sequence[str], boost: int = BOOST) -> DataFrame:
    """Sources (id, name, url_pattern, priority) with their priority raised for each keyword in name or pattern, the highest first, by id on ties."""
    held = lambda k: F.contains(F.lower(F.coalesce("url_pattern", F.lit(""))), F.lit(k)) | F.contains(F.lower(F.coalesce("name", F.lit(""))), F.lit(k))
    matched = sum((F.when(held(k.lower()), 1).otherwise(0) for k in keywords), F.lit(0))
    return sources.withColumn("matched", matched).withColumn("rank_priority", F.coalesce("priority", F.lit(0)) + F.col("matched") * boost).orderBy(F.desc("rank_priority"), "id")


def drained(queue: DataFrame, n: int = 5) -> DataFrame:
    """The first n pending entries (id, status)."""
    return queue.where("status = 'pending'").orderBy("id").limit(n)


def crawl_summary(results: DataFrame, *by: str) -> DataFrame:
    """Counts of results (status, review, conflict): crawled, approved, rejected, conflicts, skipped, errors."""
    ok = F.col("status") == "ok"
    return results.groupBy(*by).agg(
        F.count_if(ok).alias("crawled"), F.count_if(ok & (F.col("review") == "approved")).alias("approved"), F.count_if(ok & (F.coalesce("review", F.lit("")) != "approved")).alias("rejected"),
        F.count_if(ok & F.col("conflict")).alias("conflicts"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.endswith("status", F.lit("error"))).alias("errors"),
    )


def ruled(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """requests (id, uri, ...) with the rule of the longest prefix of their uri and whether any rule skips them, of rules (prefix, rule, skip): rule and prefix are null and
    skipped is false without a match; of equal prefixes the first rule counts. Blank prefixes are no rules, null uris match none.

    Each uri is cut to the lengths that rules have, and the cuts meet the rules by equality; so rules may be many, and no pair is tried in vain."""
    named = rules.where(F.trim(F.coalesce("prefix", F.lit(""))) != "").groupBy("prefix").agg(F.min("rule").alias("rule"), F.max(F.coalesce("skip", F.lit(False))).alias("skip"))
    lengths = named.agg(F.collect_set(F.length("prefix")).alias("__lengths"))  # as many as the longest prefix has characters, at most
    cuts = requests.select("id", "uri").crossJoin(F.broadcast(lengths))  # one row of lengths
    cuts = cuts.select("id", F.explode(F.transform(F.filter("__lengths", lambda n: n <= F.length("uri")), lambda n: F.substring("uri", F.lit(1), n))).alias("prefix"))
    found = cuts.join(small(named), "prefix").groupBy("id").agg(F.max_by(F.struct("prefix", "rule"), F.length("prefix")).alias("__best"), F.max("skip").alias("__skip"))
    out = requests.join(found, "id", "left")
    return out.select(*requests.columns, F.col("__best.prefix").alias("prefix"), F.col("__best.rule").alias("rule"), F.coalesce("__skip", F.lit(False)).alias("skipped"))
