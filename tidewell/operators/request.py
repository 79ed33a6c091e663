"""One search request, from its queries to the contents it shows: checks, channels that may fail, rewrites, rounds, parents, contents."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import small, written
from . import fusion, search

HITS = "channel string, qid long, id long, score double"
Channel = Callable[[DataFrame, int], DataFrame]


class Request(NamedTuple):
    """How a search is asked: hits wanted (kept within the limits), mode, score from which a document counts for further rounds, characters of a content, and whether all
    channels must answer: if so, one that fails is an error, as results would lack its hits."""

    k: int = 5
    mode: str = "fusion"
    least: float = search.MIN_SCORE
    chars: int = search.CONTENT_CHARS
    all_channels: bool = False


def tried(name: str, channel: Channel, queries: DataFrame, k: int, must: bool = False) -> DataFrame:
    """The hits of a channel, written; a channel that fails, when it is planned or when it runs, is an error if it must answer, else counts as empty, with a warning."""
    try:
        hits = channel(queries, k)
        return written(hits.select(F.lit(name).alias("channel"), F.col("qid").cast("long").alias("qid"), F.col("id").cast("long").alias("id"), F.col("score").cast("double").alias("score")), name)
    except (PySparkException, ValueError, ConnectionError, TimeoutError) as error:
        if must:
            raise
        warnings.warn(f"channel {name} failed and counts as empty: {str(error)[:200]}", stacklevel=2)
        return queries.sparkSession.createDataFrame([], HITS)


def one_round(queries: DataFrame, channels: dict[str, Channel], request: Request, number: int) -> DataFrame:
    """qid, id, score, rank, abs_cosine of a round: every channel once, fused as the mode says; the cosine is the vector channel's score."""
    asked = written(search.checked_queries(queries), "asked")
    found = {name: tried(name, channel, asked, search.OVER_FETCH * search.request_size(request.k), request.all_channels) for name, channel in channels.items()}
    hits = search.searched({name: lambda k, name=name: found[name] for name in found}, request.k, request.mode, number)
    if "vector" not in found:
        return hits.select("qid", "id", "score", "rank", F.lit(None).cast("double").alias("abs_cosine"))
    cosines = found["vector"].groupBy("qid", "id").agg(F.max("score").alias("abs_cosine"))
    return hits.join(cosines, ["qid", "id"], "left").select("qid", "id", "score", "rank", "abs_cosine")


def vague(queries: DataFrame, index_terms: DataFrame) -> DataFrame:
    """qid of queries (qid, text) that a rewrite may help: those of which no term of two characters or more stands in the index (term)."""
    terms = queries.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).where(F.length("term") >= 2)
    precise = index_terms.select("term").join(small(terms), "term").select("qid").distinct()
    return queries.select("qid").join(precise, "qid", "left_anti")


def kept_rewrites(queries: DataFrame, rewrites: DataFrame, may: DataFrame | None = None) -> DataFrame:
    """qid, text, q of rewrites (qid, text, q) that differ from the query, are not blank, and keep its meaning by their vectors; of queries in `may` (qid) alone, if given."""
    both = rewrites.join(queries.select("qid", F.col("text").alias("__text"), F.col("q").alias("__q")), "qid")
    good = both.where((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.trim("text") != F.col("__text")) & search.faithful(F.col("__q"), F.col("q")))
    return (good if may is None else good.join(may, "qid", "left_semi")).select("qid", F.trim("text").alias("text"), "q")


def answered(queries: DataFrame, channels: dict[str, Channel], documents: DataFrame, request: Request = Request(), rewrites: Sequence[DataFrame] = (), may: DataFrame | None = None) -> DataFrame:
    """qid, rank, id, score, abs_cosine, round, used_rewrite, content of queries (qid, text, q) over documents (id, parent_id, text).

    Round 0 asks the queries and, where there is one, the first rewrite (qid, text, q) that passes its checks; the better of both by the first hit's cosine stays. Each further
    table of rewrites is a round for queries that have too few documents yet. Hits are handed to their parents, a parent with its best child's score, and the k best show the
    first characters of their texts. Documents that are not listed are left out."""
    first = one_round(queries, channels, request, 0)
    if rewrites:
        again = one_round(kept_rewrites(queries, rewrites[0], may), channels, request, 0)
        both = first.select(*COLUMNS, F.lit(False).alias("used")).unionByName(again.select(*COLUMNS, F.lit(True).alias("used")))
        better = search.better_hits(first, again).select("qid", "id", F.col("used_rewrite").alias("used"))
        first = both.join(better, ["qid", "id", "used"], "left_semi")
    else:
        first = first.select(*COLUMNS, F.lit(False).alias("used"))
    first = written(first, "round")
    rounds = [first] + [one_round(kept_rewrites(queries, r, may), channels, request, n + 1).select(*COLUMNS, F.lit(True).alias("used")) for n, r in enumerate(rewrites[1 : search.ROUNDS])]
    hits = first.withColumn("round", F.lit(0))
    if len(rounds) > 1:
        rounds = [first] + [written(r, "round") for r in rounds[1:]]
        good = search.rounds_joined(rounds, request.least)
        told = rounds[0].withColumn("round", F.lit(0))
        for n, r in enumerate(rounds[1:]):
            told = told.unionByName(r.withColumn("round", F.lit(n + 1)))
        later = told.join(good.select("qid", "id", "round"), ["qid", "id", "round"], "left_semi").where("round > 0")
        hits = hits.unionByName(later)
    return shown(hits, documents, request)


COLUMNS = ("qid", "id", "score", "rank", "abs_cosine")


def shown(hits: DataFrame, documents: DataFrame, request: Request) -> DataFrame:
    """The k best parents of hits (qid, id, score, abs_cosine, round, used), with contents."""
    parents = documents.select("id", F.coalesce("parent_id", "id").alias("parent"))
    by = hits.join(parents, "id").groupBy("qid", F.col("parent").alias("id")).agg(
        F.max("score").alias("score"), F.max("abs_cosine").alias("abs_cosine"), F.min_by("round", F.struct(-F.col("score"), "round")).alias("round"), F.min_by("used", F.struct(-F.col("score"), "round")).alias("used_rewrite")
    )
    ranked = fusion.best(by, search.request_size(request.k))
    content = documents.select("id", F.substring("text", 1, request.chars).alias("content"))
    return ranked.join(content, "id").select("qid", "rank", "id", "score", "abs_cosine", "round", "used_rewrite", "content")

