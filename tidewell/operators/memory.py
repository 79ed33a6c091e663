"""Memory items: decay, promotion, deduplication, and windows over sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Half-lives in days by type, and the bounds of decay and promotion.
HALF_LIVES = {"preference": 30.0, "event": 1.0}
HALF_LIFE = 3.0
MOST_DAYS = 30.0
COLD_DAYS, COLD_FLOOR, COLD_SPAN = 30.0, 0.3, 100.0
PROMOTE_MENTIONS, PROMOTE_DAYS = 2, 7.0


def age_days(then: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / F.lit(86_400e6)


def half_life(kind: Column) -> Column:
    out = F.lit(HALF_LIFE)
    for name, days in HALF_LIVES.items():
        out = F.when(kind == name, F.lit(days)).otherwise(out)
    return out


def decayed(score: Column, age: Column, kind: Column, mentions: Column) -> Column:
    """score x 0.5^(age / half-life) x (1 + 0.2 mentions), to four digits; null beyond MOST_DAYS."""
    return F.when(age <= MOST_DAYS, F.round(score * F.pow(F.lit(0.5), age / half_life(kind)) * (1 + 0.2 * F.coalesce(mentions, F.lit(0))), 4))


def cold_factor(age: Column) -> Column:
    """1 up to COLD_DAYS, then falling to COLD_FLOOR."""
    return F.when(age >= COLD_DAYS, F.greatest(F.lit(COLD_FLOOR), 1 - (age - COLD_DAYS) / COLD_SPAN)).otherwise(F.lit(1.0))


def dynamic_k(mean: Column) -> Column:
    return F.when(mean > 0.85, 5).when(mean >= 0.75, 3).otherwise(1)


def dual_verdict(first: Column, second: Column) -> Column:
    """Two judges of a conflict: one alone decides where the other is silent, both must agree on a contradiction."""
    contradiction = lambda c: c == "contradiction"
    return F.when(first.isNull(), second).when(second.isNull(), first).when(contradiction(first) & contradiction(second), "contradiction").otherwise(F.when(contradiction(first) | contradiction(second), "neutral").otherwise(first))


def last_n(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The last n rows of each key, by a descending order."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).drop("n")


def trimmed(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """What last_n leaves out."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") > n).drop("n")


def first_of_hash(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """Each text of a key once, where it first stands."""
    w = Window.partitionBy(key, F.sha2(text, 256)).orderBy(order)
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def promoted(short: DataFrame, long: DataFrame, now: Column) -> DataFrame:
    """Short-term items mentioned often and lately whose hash is not among the long-term ones."""
    fit = short.where((F.col("mentions") >= PROMOTE_MENTIONS) & (age_days(F.col("last_at"), now) <= PROMOTE_DAYS))
    return fit.join(long.select("hash"), "hash", "left_anti")


def merged_notes(rows: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """Distinct texts of a key joined in order of their first appearance, how many, and when last."""
    firsts = rows.groupBy(*keys, text).agg(F.min(order).alias("first_at"), F.max(order).alias("last_at"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("first_at", text))), lambda x: x[text])
    return firsts.groupBy(*keys).agg(F.array_join(parts, "\n").alias("content"), F.count("*").alias("n_contexts"), F.max("last_at").alias("last_at"))


def expanded(children: DataFrame, parents: DataFrame) -> DataFrame:
    """content, score, title, created_at of child hits (qid, content, parent_id, title, abs_cosine, hybrid_score, created_at) by qid: a child stands for its
    parent (id, content, title, created_at, superseded); superseded parents and empty contents go, each content stays once with its best score."""
    p = parents.select(F.col("id").alias("parent_id"), F.col("content").alias("p_content"), F.col("title").alias("p_title"), F.col("created_at").alias("p_created_at"), F.coalesce("superseded", F.lit(False)).alias("gone"))
    joined = children.join(p, "parent_id", "left").where(~F.coalesce("gone", F.lit(False)))
    known = F.col("gone").isNotNull()
    score = F.round(F.coalesce("abs_cosine", "hybrid_score", F.lit(0.0)), 4)
    rows = joined.select("qid", F.when(known, F.col("p_content")).otherwise(F.col("content")).alias("content"), score.alias("score"), F.when(known, F.col("p_title")).otherwise(F.col("title")).alias("title"), F.when(known, F.col("p_created_at")).otherwise(F.col("created_at")).alias("created_at"))
    best = F.max_by(F.struct("title", "created_at"), F.struct("score", "title")).alias("b")
    return rows.where(F.coalesce("content", F.lit("")) != "").groupBy("qid", "content").agg(F.max("score").alias("score"), best).select("qid", "content", "score", "b.title", "b.created_at")


def merged_duplicates(found: DataFrame) -> DataFrame:
    """What becomes of new items that match a stored one (id, content, superseded, mentions, new_content, verdict, layer): status and the stored row's new values.

    A superseded row takes nothing (status added); a contradiction supersedes it and the item is added; else the item is appended, unless the row holds it already,
    and in the short layer the row counts one more mention."""
    gone = F.coalesce("superseded", F.lit(False))
    against = F.coalesce(F.col("verdict") == "contradiction", F.lit(False))
    updates = ~gone & ~against
    held = F.contains("content", "new_content")
    short = F.col("layer") == "short"
    return found.select(
        "id", F.when(updates, "updated").otherwise("added").alias("status"), (gone | against).alias("superseded"),
        F.when(updates & ~held, F.concat_ws("\n", "content", "new_content")).otherwise(F.col("content")).alias("content"),
        F.when(updates & short, F.coalesce("mentions", F.lit(0)) + 1).otherwise(F.col("mentions")).alias("mentions"),
    )


def refreshed(items: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Items (id, mentions, last_at) with one more mention and the time for those among ids (id)."""
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    on = F.col("__hit").isNotNull()
    own = [c for c in items.columns if c not in ("mentions", "last_at")]
    return items.join(hit, "id", "left").select(*own, F.when(on, F.coalesce("mentions", F.lit(0)) + 1).otherwise(F.col("mentions")).alias("mentions"), F.when(on, now).otherwise(F.col("last_at")).alias("last_at"))


def short_duplicates(new: DataFrame, stored: DataFrame, least: float = 0.85) -> DataFrame:
    """The best match of each new item among hits (id, stored_id, score, superseded) that are not superseded and similar enough; by the lower id on ties."""
    fit = new.join(stored.where(~F.coalesce("superseded", F.lit(False))).select("stored_id"), "stored_id").where(F.col("score") >= least)
    return fit.groupBy("id").agg(F.max(F.struct("score", (-F.col("stored_id")).alias("minus"))).alias("b")).select("id", (-F.col("b.minus")).alias("stored_id"), F.col("b.score").alias("score"))


def recalled(memories: DataFrame, now: Column, k: int = 5, floor: float = 0.4) -> DataFrame:
    """The long-term memories (qid, content, score, recalled_at) that answer a query: those above the floor, weakened the longer ago they were recalled, as many as the
    mean score before that allows."""
    fit = memories.where(F.col("score") >= floor)
    mean = fit.groupBy("qid").agg(F.avg("score").alias("mean"))
    cold = F.coalesce(cold_factor(age_days(F.col("recalled_at"), now)), F.lit(1.0))
    w = Window.partitionBy("qid").orderBy(F.desc("final"), "content")
    ranked = fit.join(mean, "qid").withColumn("final", F.round(F.col("score") * cold, 4)).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= F.least(F.lit(k), dynamic_k(F.col("mean")))).select("qid", "content", F.col("final").alias("score"), "rank")


def recalled_short(memories: DataFrame, now: Column, k: int = 5, floor: float = 0.4) -> DataFrame:
    """The short-term memories (qid, content, score, kind, mentions, last_at, created_at): as `recalled`, but decayed by age and type and raised by mentions;
    none older than MOST_DAYS; without any time the score stays."""
    at = F.coalesce("last_at", "created_at")
    final = F.when(at.isNull(), F.round("score", 4)).otherwise(decayed(F.col("score"), age_days(at, now), F.col("kind"), F.col("mentions")))
    fit = memories.where(F.col("score") >= floor).withColumn("final", final).where(F.col("final").isNotNull())
    mean = fit.groupBy("qid").agg(F.avg("score").alias("mean"))
    w = Window.partitionBy("qid").orderBy(F.desc("final"), "content")
    ranked = fit.join(mean, "qid").withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= F.least(F.lit(k), dynamic_k(F.col("mean")))).select("qid", "content", F.col("final").alias("score"), "rank")


#: Types of facts, and the importance from which one is kept.
KINDS, IMPORTANCE = ("preference", "event", "fact"), 0.6


def kept_facts(facts: DataFrame, least: float = IMPORTANCE) -> DataFrame:
    """Facts (content, importance, kind) with content and enough importance; an unknown type is a fact."""
    kind = F.lower(F.trim(F.coalesce("kind", F.lit(""))))
    importance = F.coalesce(F.col("importance").try_cast("double"), F.lit(0.0))
    content = F.trim(F.coalesce("content", F.lit("")))
    out = facts.withColumn("content", content).withColumn("importance", importance).withColumn("kind", F.when(kind.isin(*KINDS), kind).otherwise("fact"))
    return out.where((F.col("content") != "") & (F.col("importance") >= least)).withColumn("importance", F.round("importance", 3))


#: The types of memories; what is of none is a fact.
MEMORY_TYPES, DEFAULT_TYPE = ("preference", "fact", "event"), "fact"


def memory_type(predicted: Column, said: Column, mode: str = "clf") -> Column:
    """The type of a memory: by the classifier, where it has one, else by what the model said, else a fact (clf); by what the model said alone (llm); always a fact (none)."""
    if mode not in ("clf", "llm", "none"):
        raise ValueError(f"mode {mode!r} is none of clf, llm, none")
    known = lambda c: F.when(c.isin(*MEMORY_TYPES), c)
    by_model = known(F.lower(F.trim(said.cast("string"))))
    return F.coalesce(*([known(predicted)] if mode == "clf" else []), *([by_model] if mode != "none" else []), F.lit(DEFAULT_TYPE))
