"""Entities and events of documents: allowed types, aliases of one entity, and the documents that name it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The types of entities that are kept.
TYPES = ("concept", "technology", "algorithm", "framework", "tool", "person", "company", "language", "event", "metric", "method")
#: How the model's answer is read.
ANSWER = "struct<entities: array<struct<name: string, type: string>>, events: array<struct<text: string, entity_names: array<string>>>>"


def alias_key(name: Column) -> Column:
    """What spellings of one name share: lower case, runs of all but letters and digits as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def entity_id(key: Column, kind: Column) -> Column:
    """The same for a key and type in every load."""
    return F.substring(F.sha2(F.concat_ws("|", key, kind), 256), 1, 16)


def answered(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (doc_id, name, type) and events (doc_id, event, names) of answers (doc_id, json). What cannot be read gives none."""
    read = answers.select("doc_id", F.from_json("json", ANSWER).alias("a"))
    entities = read.select("doc_id", F.explode("a.entities").alias("e")).select("doc_id", "e.name", "e.type")
    events = read.select("doc_id", F.explode("a.events").alias("e")).select("doc_id", F.col("e.text").alias("event"), F.col("e.entity_names").alias("names"))
    return entities, events.where(F.col("event").isNotNull())


def normalised(entities: DataFrame, aliases: DataFrame | None = None, types: Sequence[str] = TYPES) -> DataFrame:
    """doc_id, name, type, key, entity_id of entities (doc_id, name, type) with a name and an allowed type; aliases (alias, name) say which names mean another.

    An alias is looked up once: its name is not an alias itself. Names that differ in case or punctuation alone are one without a table."""
    kept = entities.where(F.col("type").isin(*types)).withColumn("key", alias_key(F.col("name"))).where("key <> ''")
    if aliases is not None:
        known = aliases.select(alias_key(F.col("alias")).alias("key"), alias_key(F.col("name")).alias("__meant")).where("key <> '' AND __meant <> ''")
        known = known.groupBy("key").agg(F.min("__meant").alias("__meant"))
        kept = kept.join(known, "key", "left").withColumn("key", F.coalesce("__meant", "key")).drop("__meant")
    return kept.select("doc_id", "name", "type", "key", entity_id(F.col("key"), F.col("type")).alias("entity_id"))


def source_links(entities: DataFrame) -> DataFrame:
    """entity_id, doc_id: the documents that name an entity under any alias, each once; rows and no arrays, as one entity may be in most documents."""
    return entities.select("entity_id", "doc_id").distinct()


def merged(entities: DataFrame, stored_links: DataFrame | None = None) -> DataFrame:
    """entity_id, name, type, n_docs, n_names of normalised entities: its commonest spelling (of equals the first), and with `stored_links` (entity_id, doc_id) of
    earlier loads the documents of both, each once."""
    spelled = entities.groupBy("entity_id", "type", "name").agg(F.count("*").alias("n"))
    told = spelled.groupBy("entity_id", "type").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("name"), F.count("*").alias("n_names"))
    links = source_links(entities)
    if stored_links is not None:
        links = links.unionByName(stored_links.join(told.select("entity_id"), "entity_id", "left_semi").select("entity_id", "doc_id")).distinct()
    return told.join(links.groupBy("entity_id").agg(F.count("*").alias("n_docs")), "entity_id").select("entity_id", "name", "type", "n_docs", "n_names")


def resolved_events(events: DataFrame, entities: DataFrame) -> DataFrame:
    """doc_id, event, entity_ids of events (doc_id, event, names): ids of the named entities of the same document, in order, each once; unknown names give none."""
    ids = entities.select("doc_id", alias_key(F.col("name")).alias("__key"), "entity_id").groupBy("doc_id", "__key").agg(F.min("entity_id").alias("entity_id"))
    keyed = events.withColumn("__row", F.monotonically_increasing_id())
    named = keyed.select("__row", "doc_id", F.posexplode("names").alias("__place", "__name")).withColumn("__key", alias_key(F.col("__name"))).join(ids, ["doc_id", "__key"])
    once = named.groupBy("__row", "entity_id").agg(F.min("__place").alias("__place"))
    lists = once.groupBy("__row").agg(F.transform(F.array_sort(F.collect_list(F.struct("__place", "entity_id"))), lambda x: x["entity_id"]).alias("entity_ids"))
    return keyed.join(lists, "__row", "left").select("doc_id", "event", F.coalesce("entity_ids", F.array().cast("array<string>")).alias("entity_ids"))
