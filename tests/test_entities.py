"""Literal cases of entities, events, prefix rules and memory types."""

import json

import pytest
from pyspark.sql import functions as F

from tidewell.operators import crawl, entities, memory


def test_entities_and_events(spark):
    answer = {"entities": [{"name": "G1 GC", "type": "algorithm"}, {"name": "g1-gc", "type": "algorithm"}, {"name": "Garbage First", "type": "algorithm"}, {"name": "Kafka", "type": "tool"}, {"name": "", "type": "tool"}, {"name": "X", "type": "planet"}], "events": [{"text": "tuned", "entity_names": ["KAFKA", "Garbage First", "g1 gc", "none"]}, {"text": "empty", "entity_names": []}]}
    other = {"entities": [{"name": "kafka", "type": "tool"}, {"name": "Kafka", "type": "framework"}]}
    answers = spark.createDataFrame([(1, json.dumps(answer)), (2, json.dumps(other)), (3, "no json"), (4, None)], "doc_id long, json string")
    aliases = spark.createDataFrame([("garbage first", "G1 GC"), (" ", "x"), (None, None)], "alias string, name string")
    found, events = entities.answered(answers)
    kept = entities.normalised(found, aliases)
    merged = {(r["name"], r["type"]): (r["n_docs"], r["n_names"], r["entity_id"]) for r in entities.merged(kept).collect()}
    assert {k: v[:2] for k, v in merged.items()} == {("G1 GC", "algorithm"): (1, 3), ("Kafka", "tool"): (2, 2), ("Kafka", "framework"): (1, 1)}
    g1, kafka = merged["G1 GC", "algorithm"][2], merged["Kafka", "tool"][2]
    assert {r["event"]: r["entity_ids"] for r in entities.resolved_events(events, kept).collect()} == {"tuned": [kafka, g1], "empty": []}
    stored = spark.createDataFrame([(kafka, 2), (kafka, 9), ("unseen", 7)], "entity_id string, doc_id long")
    again = {r["entity_id"]: r["n_docs"] for r in entities.merged(kept, stored).collect()}
    assert again[kafka] == 3 and again[g1] == 1 and "unseen" not in again
    assert entities.merged(entities.normalised(found.where("false"))).count() == 0


def test_prefix_rules(spark):
    rules = [("/api/", "api", False), ("/api/ai/", "ai", False), ("/api/ai/", "zz", None), ("/api/ai/free", "free", None), ("/health", "open", True), ("/", "all", False), ("", "blank", True), (None, "null", True), ("   ", "space", True)]
    uris = ["/api/ai/chat", "/api/ai/free/x", "/api", "/healthz", "other", None, "", "/"]
    got = crawl.ruled(spark.createDataFrame(list(enumerate(uris)), "id long, uri string"), spark.createDataFrame(rules, "prefix string, rule string, skip boolean"))
    got = {r["uri"]: (r["prefix"], r["rule"], r["skipped"]) for r in got.collect()}
    assert got == {"/api/ai/chat": ("/api/ai/", "ai", False), "/api/ai/free/x": ("/api/ai/free", "free", False), "/api": ("/", "all", False), "/healthz": ("/health", "open", True), "other": (None, None, False), None: (None, None, False), "": (None, None, False), "/": ("/", "all", False)}
    assert crawl.ruled(spark.createDataFrame([(1, "/a")], "id long, uri string"), spark.createDataFrame([], "prefix string, rule string, skip boolean")).first()["skipped"] is False


def test_memory_types(spark):
    rows = spark.createDataFrame([("event", "fact"), (None, " Preference "), ("other", "other"), (None, None)], "p string, s string")
    got = {m: [r[0] for r in rows.select(memory.memory_type(F.col("p"), F.col("s"), m)).collect()] for m in ("clf", "llm", "none")}
    assert got == {"clf": ["event", "preference", "fact", "fact"], "llm": ["fact", "preference", "fact", "fact"], "none": ["fact"] * 4}
    with pytest.raises(ValueError):
        memory.memory_type(F.col("p"), F.col("s"), "other")
