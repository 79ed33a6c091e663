"""The search request: what may be seen, channels by mode, rounds, the better of two result sets, and expansion to parents."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import dot
from ..session import small
from . import fusion

#: Modes of a search, the limits of a request's size, the over-fetch, the boost of graph hits, characters of a result's content.
MODES = ("hybrid", "vector_only", "fts_only", "graph_only", "fusion")
LEAST_K, MOST_K, OVER_FETCH, BOOST, CONTENT_CHARS = 1, 50, 2, 1.2, 500
#: Rounds of a retrieval, documents that suffice after the first, score from which a document counts, and similarity that a rewrite keeps.
ROUNDS, ENOUGH, MIN_SCORE, FIDELITY = 3, 3, 0.6, 0.6


def children_only(docs: DataFrame, parent: str = "parent_id") -> DataFrame:
    return docs.where(F.col(parent).isNotNull())


def parents_only(docs: DataFrame, parent: str = "parent_id") -> DataFrame:
    return docs.where(F.col(parent).isNull())


def canonical_only(docs: DataFrame, flag: str = "is_canonical") -> DataFrame:
    """Rows whose flag is true; null is not."""
    return docs.where(F.coalesce(F.col(flag), F.lit(False)))


def not_superseded(docs: DataFrame, flag: str = "superseded") -> DataFrame:
    """Rows not taken over by a later one; null is not taken over."""
    return docs.where(~F.coalesce(F.col(flag), F.lit(False)))


def not_deleted(rows: DataFrame, flag: str = "del_flag") -> DataFrame:
    return rows.where(F.col(flag) == 0)


def scored_at_least(hits: DataFrame, least: float = MIN_SCORE, score: str = "score") -> DataFrame:
    return hits.where(F.col(score) >= least)


def any_column_contains(columns: Sequence[str], keyword: str) -> Column:
    """Whether any of the columns holds the keyword, as it is written."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.col(c), F.lit(keyword)), F.lit(False))
    return found


def starts_with_any(text: Column, prefixes: Sequence[str]) -> Column:
    """Whether the text begins with one of the prefixes, in any case; no prefix matches nothing."""
    if not prefixes:
        return F.lit(False)
    return F.exists(F.array(*[F.lit(p.lower()) for p in prefixes]), lambda p: F.startswith(F.lower(text), p))


def entity_hits(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """Queries (qid, text) that hold the name of any of a few entities (name, broadcast after a count)."""
    return queries.join(small(entities.select("name").distinct()), F.contains("text", "name"), "left_semi")


def known_titles_or_hashes(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of new (title, content_hash) with the title or the hash of a stored row: two semi joins on keys in place of an OR."""
    by = lambda c: new.join(stored.select(c).distinct(), c, "left_semi")
    return by("title").select(*new.columns).union(by("content_hash").select(*new.columns)).distinct()


def first_then_second(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """qid, id, rank: up to k hits, those of `first` (qid, id, rank) in their order, then those of `second` that are new."""
    both = first.select("qid", "id", F.lit(0).alias("part"), "rank").unionByName(second.select("qid", "id", F.lit(1).alias("part"), "rank"))
    once = both.groupBy("qid", "id").agg(F.min(F.struct("part", "rank")).alias("place"))
    w = Window.partitionBy("qid").orderBy("place", "id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "id", "rank")


def boosted(score: Column) -> Column:
    """The score of a graph hit, raised, 1 at most."""
    return F.least(score * BOOST, F.lit(1.0))


def request_size(k: int) -> int:
    return max(LEAST_K, min(MOST_K, k))


def searched(channels: dict[str, Callable[[int], DataFrame]], k: int, mode: str = "fusion", round_number: int = 0) -> DataFrame:
    """qid, id, score, rank of the k best. `channels` maps fts, vector and graph to functions of a number of hits that give qid, id, score.

    Modes ask one channel, or text and vectors by weight (hybrid), or all by reciprocal ranks (fusion, in round 0 only; later rounds are hybrid). Channels that are
    absent count as empty; without any the result is empty. An unknown mode is an error."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    k = request_size(k)
    if mode == "fusion" and round_number > 0:
        mode = "hybrid"
    wanted = {"vector_only": ("vector",), "fts_only": ("fts",), "graph_only": ("graph",), "hybrid": ("fts", "vector"), "fusion": ("fts", "vector", "graph")}[mode]
    parts = [channels[c](OVER_FETCH * k).select(F.lit(c).alias("channel"), "qid", "id", "score") for c in wanted if c in channels]
    if not parts:
        raise ValueError(f"mode {mode!r} needs one of the channels {wanted}")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    if len(wanted) == 1:
        return fusion.best(found.drop("channel"), k)
    if mode == "hybrid":
        return fusion.best(fusion.alpha_fusion(found).withColumnRenamed("hybrid_score", "score").select("qid", "id", "score"), k)
    return fusion.best(fusion.reciprocal_rank_fusion(found).withColumnRenamed("rrf_score", "score").select("qid", "id", "score"), k)


def checked_queries(queries: DataFrame) -> DataFrame:
    """Queries (qid, text) that are not blank."""
    return queries.where(F.trim(F.coalesce("text", F.lit(""))) != "")


def rounds_joined(rounds: Sequence[DataFrame], least: float = MIN_SCORE, enough: int = ENOUGH) -> DataFrame:
    """qid, id, score, round of up to ROUNDS rounds of hits (qid, id, score): a query goes on while the rounds before gave fewer than `enough`
    documents of the least score; of equal documents the best score stays, the earlier on ties."""
    out = None
    for number, hits in enumerate(rounds[:ROUNDS]):
        good = scored_at_least(hits, least).select("qid", "id", "score").withColumn("round", F.lit(number))
        if out is None:
            out = good
        else:
            done = out.groupBy("qid").agg(F.countDistinct("id").alias("n")).where(F.col("n") >= enough).select("qid")
            out = out.unionByName(good.join(done, "qid", "left_anti"))
    best = F.max(F.struct("score", (-F.col("round")).alias("minus"))).alias("b")
    return out.groupBy("qid", "id").agg(best).select("qid", "id", F.col("b.score").alias("score"), (-F.col("b.minus")).alias("round"))


def faithful(original: Column, rewritten: Column, least: float = FIDELITY) -> Column:
    """Whether a rewrite's unit vector is near enough to the original's; a missing vector skips the gate."""
    return F.when(original.isNull() | rewritten.isNull(), True).otherwise(dot(original, rewritten) >= least)


def better_hits(original: DataFrame, rewritten: DataFrame) -> DataFrame:
    """Of two result sets (qid, id, rank, abs_cosine) the rewritten one for queries where its first hit has a strictly higher cosine, else the original;
    a missing cosine is 0. With used_rewrite."""
    top = lambda df, name: df.groupBy("qid").agg(F.coalesce(F.min_by("abs_cosine", "rank"), F.lit(0.0)).alias(name))
    chosen = top(rewritten, "new").join(top(original, "old"), "qid", "left").where(F.col("new") > F.coalesce("old", F.lit(0.0))).select("qid")
    kept = original.join(chosen, "qid", "left_anti").select("qid", "id", "rank", "abs_cosine", F.lit(False).alias("used_rewrite"))
    return kept.unionByName(rewritten.join(chosen, "qid", "left_semi").select("qid", "id", "rank", "abs_cosine", F.lit(True).alias("used_rewrite")))


def contents_of(hits: DataFrame, texts: DataFrame, chars: int = CONTENT_CHARS) -> DataFrame:
    """Hits with the first characters of their texts (id, text)."""
    return hits.join(texts.select("id", F.substring("text", 1, chars).alias("content")), "id", "left")


def relevance_summary(hits: DataFrame, threshold: float = 0.5) -> DataFrame:
    """qid, qualified, total, min_score: how many hits (qid, score) reach the threshold."""
    qualified = F.count_if(F.col("score") >= threshold)
    return hits.groupBy("qid").agg(qualified.alias("qualified"), F.count("*").alias("total"), F.round(F.coalesce(F.min("score"), F.lit(0.0)), 4).alias("min_score"))


def near_roots(hits: DataFrame, k: int = 3, least: float = 0.6) -> DataFrame:
    """Candidates of a conflict: of each item's hits (qid, id, score) the k best, and of those the ones of the least score."""
    return fusion.best(hits, k).where(F.col("score") >= least)
