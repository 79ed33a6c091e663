"""The whole request: channels that fail, rewrites that keep the meaning, rounds, parents and contents."""

import pytest
from pyspark.sql import functions as F

from tidewell.operators import request

HITS = "qid long, id long, score double"


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(1, "cats", [1.0, 0.0]), (2, "dogs", [0.0, 1.0]), (3, "  ", [1.0, 0.0])], "qid long, text string, q array<double>")


@pytest.fixture
def documents(spark):
    rows = [(10, None, "parent of cats " * 60), (11, 10, "a cat"), (12, 10, "two cats"), (20, None, "dogs"), (30, None, "birds"), (40, None, "fish")]
    return spark.createDataFrame(rows, "id long, parent_id long, text string")


def table_of(spark, hits):
    """A channel that finds these hits for the queries' texts."""
    stored = spark.createDataFrame(hits, "text string, id long, score double")
    return lambda queries, k: queries.join(stored, "text").select("qid", "id", "score")


def got(df):
    return {(r["qid"], r["rank"]): (r["id"], r["score"], r["abs_cosine"], r["round"], r["used_rewrite"]) for r in df.collect()}


def test_parents_contents_and_failing_channels(spark, asked, documents):
    def broken(queries, k):
        raise ConnectionError("no index")

    def lost(queries, k):
        return queries.select("qid", F.raise_error(F.lit("gone")).cast("long").alias("id"), F.lit(1.0).alias("score"))

    vector = table_of(spark, [("cats", 11, 0.9), ("cats", 12, 0.8), ("cats", 30, 0.1), ("dogs", 20, 0.7), ("dogs", 99, 0.6), ("  ", 40, 1.0)])
    with pytest.warns(UserWarning, match="counts as empty"):
        df = request.answered(asked, {"fts": broken, "graph": lost, "vector": vector}, documents, request.Request(k=2, mode="vector_only"))
    assert got(df) == {(1, 1): (10, 0.9, 0.9, 0, False), (2, 1): (20, 0.7, 0.7, 0, False)}  # both children are hits of one parent; 99 is no document
    assert {r["id"]: len(r["content"]) for r in df.collect()} == {10: 500, 20: 4}
    with pytest.raises(ValueError):
        request.answered(asked, {"vector": vector}, documents, request.Request(mode="other"))


def test_all_channels_fail(spark, asked, documents):
    def broken(queries, k):
        raise ValueError("no index")

    with pytest.warns(UserWarning):
        assert request.answered(asked, {"fts": broken, "vector": broken}, documents).count() == 0


def test_rewrites_and_rounds(spark, asked, documents):
    vector = table_of(spark, [("cats", 30, 0.3), ("kittens", 11, 0.9), ("dogs", 20, 0.7), ("hounds", 40, 0.6), ("poodles", 30, 0.8), ("wolves", 40, 0.99)])
    schema = "qid long, text string, q array<double>"
    first = spark.createDataFrame([(1, " kittens ", [0.8, 0.6]), (2, "wolves", [1.0, 0.0])], schema)  # the second strays from its query
    second = spark.createDataFrame([(1, "hounds", [1.0, 0.0]), (2, "poodles", [0.0, 1.0]), (2, "dogs", [0.0, 1.0])], schema)  # an unchanged text is no rewrite
    ask = request.Request(k=5, mode="vector_only")
    assert got(request.answered(asked, {"vector": vector}, documents, ask, [first])) == {(1, 1): (10, 0.9, 0.9, 0, True), (2, 1): (20, 0.7, 0.7, 0, False)}
    both = got(request.answered(asked, {"vector": vector}, documents, ask, [first, second]))
    assert both == {(1, 1): (10, 0.9, 0.9, 0, True), (1, 2): (40, 0.6, 0.6, 1, True), (2, 1): (30, 0.8, 0.8, 1, True), (2, 2): (20, 0.7, 0.7, 0, False)}
    only = spark.createDataFrame([(2,)], "qid long")
    assert got(request.answered(asked, {"vector": vector}, documents, ask, [first], only))[1, 1] == (30, 0.3, 0.3, 0, False)


def test_vague_queries(spark):
    queries = spark.createDataFrame([(1, "how does it work"), (2, "Kafka retention"), (3, "x")], "qid long, text string")
    index = spark.createDataFrame([("kafka",), ("x",), ("retention",)], "term string")
    assert sorted(r["qid"] for r in request.vague(queries, index).collect()) == [1, 3]
