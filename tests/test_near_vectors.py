"""Near vectors by bands against all pairs, a hot group included; canonical rows against the rule row by row."""

import numpy as np
import pytest
from tidewell.operators import near_vectors as nv
from tidewell.operators import retrieval as similar
from tidewell.plans import retrieval


@pytest.mark.parametrize("tile", [1024, 40])
def test_pairs_equal_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(nv, "TILE", tile)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 32))
    hot = x[0] + rng.normal(size=(150, 32)) * 0.12  # a topic whose members nearly all are near to one another
    near = x[1:60] + rng.normal(size=(59, 32)) * 0.1
    rows = np.concatenate([x, hot, near])
    rows /= np.sqrt((rows**2).sum(axis=1))[:, None]
    data = [(i, v.tolist()) for i, v in enumerate(rows)] + [(2000 + i, rows[5].tolist()) for i in range(3)] + [(3000, None), (3001, [float("nan")] * 32)]
    df = spark.createDataFrame(data, "id long, embedding array<double>").repartition(3)
    got = {(r["id"], r["other_id"]): r["score"] for r in nv.near_pairs(df, 0.95).collect()}
    product = np.round(rows @ rows.T, 9)
    want = {(i, j) for i, j in zip(*np.nonzero(product >= 0.95)) if i < j}
    assert set(got) <= want and len(got) >= 0.998 * len(want) and len(want) > 5000
    assert all(abs(got[p] - product[p]) < 1e-8 for p in got)
    heads = {r["id"]: r["head"] for r in nv.members(df).collect()}
    assert heads == {i: i for i in range(len(rows))} | {2000 + i: 5 for i in range(3)}
    assert nv.near_pairs(df.where("id < 0")).count() == 0


def test_canonical_vectors_by_the_rule(spark):
    from test_functions import sequential

    sf = "/root/testdata/sf0.01"
    pairs = [(r["other_id"], r["id"], r["score"]) for r in retrieval.rounded_pairs(spark, sf, 0.4).collect()]
    assert {r["id"]: r["canonical_id"] for r in retrieval.canonical_vectors(spark, sf).collect()} == sequential(pairs)


@pytest.mark.parametrize("tile", [32_768, 40])
def test_similar_pairs_compare_all(spark, monkeypatch, tile):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    x[::7] = x[3]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, embedding array<float>")
    monkeypatch.setattr(similar, "STRIP", 64)
    found = similar.similar_pairs(df, 0.4, tile)
    d = x.astype(float)
    want = {(i, j): round(float(d[i] @ d[j]), 9) for i in range(300) for j in range(i + 1, 300) if round(float(d[i] @ d[j]), 9) >= 0.4}
    got = {(r["id"], r["other_id"]): r["score"] for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-9 for k in want)


def test_vectors_of_similar_pairs_travel_as_they_are_stored(spark):
    plan = similar.similar_pairs(spark.createDataFrame([(1, [1.0])], "id long, embedding array<float>"), 0.4)._jdf.queryExecution().optimizedPlan().toString()
    assert "array<double>" not in plan
