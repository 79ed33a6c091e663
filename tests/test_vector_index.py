"""The stored vector index against all inner products, and the recall of its lists."""

import numpy as np
from pyspark.sql import functions as F

from tidewell.operators import vector_index as vi

SCHEMA = "id long, embedding array<double>"


def brute(rows, queries, k):
    out = []
    for qid, q in queries:
        scored = sorted((-round(float(np.dot(q, v)), 9), i) for i, v in rows)[:k]
        out += [(qid, i, -s, r + 1) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def found(index, queries, spark, k, probes=None):
    df = index.search(spark.createDataFrame([(q, [float(x) for x in v]) for q, v in queries], "qid long, q array<double>"), k, probes)
    return sorted((r["qid"], r["id"], r["score"], r["rank"]) for r in df.collect())


def test_exact_search(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 8)) * 3
    x = np.round(centres[rng.integers(12, size=700)] + rng.normal(size=(700, 8)), 3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(90)]  # one vector in many copies
    bad = [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2002, [float("nan")] * 8), (None, x[0].tolist())]
    for name, value in (("BLOCK", 32), ("ASKING", 3), ("BOUNDS", 5), ("PROBES", 2)):
        monkeypatch.setattr(vi, name, value)
    index = vi.VectorIndex(spark, f"{tmp_path}/index").build(spark.createDataFrame(rows + bad, SCHEMA).repartition(3), lists=9)
    assert index.blocks().agg(F.sum("n")).first()[0] == len(rows) and index.blocks().agg(F.max("n")).first()[0] <= 32
    queries = [(i, x[i]) for i in range(0, 40, 3)] + [(99, np.zeros(8))]
    for k in (1, 7, 2000):
        got, want = found(index, queries, spark, k), brute(rows, queries, k)
        assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])
    close = found(index, queries[:5], spark, 5, probes=3)
    want = {w[:2] for w in brute(rows, queries[:5], 5)}
    assert len({g[:2] for g in close} & want) >= 0.9 * len(want)


def test_lists_prune_the_read(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = np.eye(16) * 20
    x = np.repeat(centres, 50, axis=0) + rng.normal(size=(800, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    index = vi.VectorIndex(spark, f"{tmp_path}/index").build(spark.createDataFrame(rows, SCHEMA), lists=16)
    asked = spark.createDataFrame([(0, x[0].tolist())], "qid long, q array<double>")
    sent = spark.createDataFrame([(0,)], "list int")
    plan = index.lists_of(sent)._jdf.queryExecution().executedPlan().toString()
    assert "list" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert found(index, [(0, x[0])], spark, 10) == [(q, i, s, r) for q, i, s, r in sorted((r["qid"], r["id"], r["score"], r["rank"]) for r in index.search(asked, 10).collect())]
    assert [g[:2] for g in found(index, [(0, x[0])], spark, 10)] == [w[:2] for w in brute(rows, [(0, x[0])], 10)]


def test_recall_on_the_table(spark, tmp_path):
    """The share of the ten nearest that 12 of 16 lists hold, over all rows as queries; these vectors are spread evenly, which asks for many lists."""
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    index = vi.VectorIndex(spark, f"{tmp_path}/index").build(e, lists=16)
    queries = e.select(F.col("id").alias("qid"), F.col("embedding").alias("q"))
    exact, near = ({(r["qid"], r["id"]) for r in index.search(queries, 10, probes).collect()} for probes in (None, 12))
    assert len(exact) == 10 * e.count() and len(exact & near) >= 0.9 * len(exact)


def test_empty(spark, tmp_path):
    index = vi.VectorIndex(spark, f"{tmp_path}/index").build(spark.createDataFrame([], SCHEMA))
    assert found(index, [(1, np.ones(1))], spark, 5) == []
    some = vi.VectorIndex(spark, f"{tmp_path}/some").build(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA))
    assert some.search(spark.createDataFrame([], "qid long, q array<double>"), 3).count() == 0
