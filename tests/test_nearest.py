"""Nearest vectors of any number of queries, and requests whose channels must answer."""

import numpy as np
import pytest

from tidewell.operators import request, retrieval
from tidewell.plans import requests


def brute(queries, vectors, k, least):
    out = []
    for qid, q in queries:
        scored = sorted(((round(float(np.dot(q, v)), 9), i) for i, v in vectors), key=lambda r: (-r[0], r[1]))
        out += [(qid, i, s) for s, i in [r for r in scored if least is None or r[0] >= least][:k]]
    return sorted(out)


@pytest.mark.parametrize("most", [4, 10_000])
@pytest.mark.parametrize("cells", [30, 1 << 20])
@pytest.mark.parametrize("k, least", [(3, None), (3, 0.5), (None, 0.5), (None, None)])
def test_more_queries_than_a_matrix_holds(spark, monkeypatch, most, cells, k, least):
    monkeypatch.setattr(retrieval, "MOST_QUERIES", most)
    monkeypatch.setattr(retrieval, "CELLS", cells)
    rng = np.random.default_rng(1)
    rows = lambda n: [(i, [round(float(c), 1) for c in rng.normal(size=4)]) for i in range(n)]  # noqa: E731, tenths: many equal scores
    queries, vectors = [(f"q{i:02}", v) for i, v in rows(13)], rows(30)
    df = spark.createDataFrame([*queries, (None, [1.0] * 4), ("none", None)], "qid string, q array<double>"), spark.createDataFrame([*vectors, (99, None)], "id long, embedding array<double>")
    got = [(r["qid"], r["id"], r["score"]) for r in retrieval.nearest(*df, k, least).collect()]
    assert sorted(got) == brute(queries, vectors, k, least)


def test_no_number_comes_first(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(8)] + [(50, [float("nan"), 0.0])], "id long, embedding array<double>").coalesce(1)
    got = retrieval.nearest(spark.createDataFrame([(1, [1.0, 0.0])], "qid long, q array<double>"), vectors, 3)
    assert [r["id"] for r in got.orderBy("rank").collect()] == [50, 7, 6]


def test_a_channel_that_must_answer_raises(spark):
    def broken(queries, k):
        raise ValueError("no index")

    asked = spark.createDataFrame([(1, "cats", [1.0])], "qid long, text string, q array<double>")
    texts = spark.createDataFrame([(1, None, "cats")], "id long, parent_id long, text string")
    with pytest.raises(ValueError):
        request.answered(asked, {"fts": broken}, texts, request.Request(all_channels=True))


def test_whole_requests_of_many_queries(spark, monkeypatch, recwarn):
    """As many queries as a matrix cannot hold leave the vector channel whole; a channel that fails ends the query."""
    sf = "/root/testdata/sf0.001"
    want = sorted(map(tuple, requests.request_answers(spark, sf).collect()))
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 3)
    assert sorted(map(tuple, requests.request_answers(spark, sf).collect())) == want and any(r[4] is not None for r in want)
    assert not [w for w in recwarn if "counts as empty" in str(w.message)]

    def broken(*_):
        raise ValueError("no vectors")

    monkeypatch.setattr(retrieval, "nearest", broken)
    with pytest.raises(ValueError):
        requests.request_answers(spark, sf)
