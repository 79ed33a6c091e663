import numpy as np
import pytest

from tidewell.llm import divergence
from tidewell.llm import soft_mixing as sm

SF = "/root/testdata/sf0.001"
MEMBERS = "__id long, __doc long, n double, p_clean double, p_low double, p_toxic double"


def dense(rows, weights, steps=60_000):
    """Totals of a dense projected gradient with a constant step, far past convergence."""
    n, p = np.array([r[2] for r in rows]), np.array([r[3:] for r in rows])
    supply = n @ p
    wish = np.array([weights[d] for d in sm.DOMAINS]) * supply[0] / weights["clean"]
    curvature = np.linalg.eigvalsh((p * n[:, None]).T @ p / np.sqrt(wish[:, None] * wish[None])).max()
    rate, moving, t = np.ones(len(n)), np.ones(len(n)), 1.0
    for _ in range(steps):
        new = np.clip(moving - p @ (((n * moving) @ p - wish) / wish) / curvature, 0, sm.MAX_RATE)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        moving = new + (t - 1) / later * (new - rate)
        rate, t = new, later
    return (n * rate) @ p, wish


def drawn(rng, n, kinds):
    return [(i, i * 7919 % 10_007, float(rng.integers(5, 900)), *map(float, rng.dirichlet(kinds(i)))) for i in range(n)]


@pytest.mark.parametrize("weights", [sm.WEIGHTS, {"clean": 0.4, "low": 0.3, "toxic": 0.3}, {"clean": 0.94, "low": 0.03, "toxic": 0.03}, {"clean": 0.8, "low": 0.15, "toxic": 0.05}])
@pytest.mark.parametrize("kinds", [lambda i: [8, 1, 1] if i % 3 else [1, 6, 2], lambda i: [40, 1, 1] if i % 50 > 1 else [1, 12, 1] if i % 50 else [1, 1, 12]])
def test_totals_equal_a_dense_solver(spark, weights, kinds):
    """Whether the weights can be met within the bound or not."""
    rows = drawn(np.random.default_rng(0), 800, kinds)
    rated, target, reached = sm.fitted_rates(spark.createDataFrame(rows, MEMBERS).repartition(2).cache(), weights)
    got = rated.collect()
    want, wish = dense(rows, weights, 4000)
    assert all(0 <= r["rate"] <= sm.MAX_RATE for r in got)
    for k, d in enumerate(sm.DOMAINS):
        total = sum(r["n"] * r[f"p_{d}"] * r["rate"] for r in got)
        assert abs(total - reached[d]) < 1e-6 * max(1, total) and np.isclose(target[d], wish[k])
        assert abs(total - want[k]) <= 0.005 * wish[k], (d, total, want, wish)


def test_copies_keep_totals_at_low_rates(spark):
    """A source of low quality that holds nearly half of the tokens, at a rate of about 0.06."""
    low = "id % 20 < 9"
    p = {"clean": f"CASE WHEN {low} THEN 0.01D WHEN id % 20 < 10 THEN 0.02D ELSE 0.98D END", "low": f"CASE WHEN {low} THEN 0.98D ELSE 0.01D END"}
    p["toxic"] = f"1 - ({p['clean']}) - ({p['low']})"
    members = spark.range(40000).selectExpr("id AS __id", "xxhash64(id) AS __doc", "cast(100 + id % 7 AS double) AS n", *[f"{e} AS p_{d}" for d, e in p.items()])
    rated, target, reached = sm.fitted_rates(members)
    got = sm.with_copies(rated)
    assert got.count() == 40000
    rate = got.where(low.replace("id", "__id")).selectExpr("avg(rate) AS r").first()["r"]
    assert 0.02 < rate < 0.15
    assert got.where("copies < floor(rate) OR copies > ceil(rate)").count() == 0
    sums = got.selectExpr(*[f"sum(copies * n * p_{d}) AS {d}" for d in sm.DOMAINS]).first()
    for d in sm.DOMAINS:
        assert abs(sums[d] - reached[d]) < 0.01 * reached[d]
        assert abs(sums[d] - target[d]) < 0.02 * target[d]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mixing_keeps_the_corpus(spark, sf):
    """After the quality rules: rates within the bound, copies by the rates, totals in the result."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = divergence.kept_documents(docs).cache()
    rows = sm.document_rates(kept, labels).collect()
    assert len(rows) == kept.count() and all(0 <= r["rate"] <= sm.MAX_RATE for r in rows)
    assert all(int(r["rate"]) <= r["copies"] <= int(r["rate"]) + 1 for r in rows)
    clean = [r for r in rows if r["p_clean"] > 0.5]
    assert sum(r["copies"] > 0 for r in clean) > (0.9 if sf == "sf0.001" else 0.98) * len(clean)
    for d in sm.DOMAINS:
        copied, expected = (sum(r[c] * r["n_tokens"] * r[f"p_{d}"] for r in rows) for c in ("copies", "rate"))
        assert abs(expected - rows[0][f"reached_{d}"]) < 1e-6 * max(1, expected)
        if sf == "sf0.01":
            assert abs(copied - expected) <= max(0.02 * expected, 0.002 * rows[0][f"target_{d}"])  # few tokens of the scarce one
    assert rows[0]["target_clean"] > 0


def test_classifier_and_copies(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rates = {r["doc_id"]: r for r in sm.document_rates(docs, labels).collect()}
    assert len(rates) == docs.count()
    truth = {r["doc_id"]: r for r in labels.collect()}
    clean = [rates[i] for i, r in truth.items() if r["quality"] == 1 and r["toxic"] == 0]
    assert np.mean([r["copies"] == 1 for r in clean]) > 0.9
    mixed = sm.mixed_documents(docs, labels)
    assert mixed.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {i: r["copies"] for i, r in rates.items() if r["copies"]}


def test_weights_that_cannot_be_met(spark, odd_documents):
    """One toxic text among many clean ones: MAX_RATE copies at most, a warning, and the clean ones stay."""
    rows = [(i, i, 100.0, 0.98, 0.01, 0.01) for i in range(400)] + [(400, 400, 100.0, 0.02, 0.01, 0.97)]
    rated, target, reached = sm.fitted_rates(spark.createDataFrame(rows, MEMBERS), {"clean": 0.5, "low": 0.0, "toxic": 0.5})
    got = {r["__id"]: r["rate"] for r in rated.collect()}
    assert got[400] == sm.MAX_RATE and min(got.values()) > 0.9 and reached["toxic"] < 0.1 * target["toxic"]
    labels = spark.createDataFrame([(1, 1, 0)] * 3, "doc_id long, quality int, toxic int")
    with pytest.warns(UserWarning, match="no rates"):
        sm.document_rates(odd_documents, labels).count()


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    none = spark.createDataFrame([], labels.schema)
    assert sm.document_rates(odd_documents, none).where("copies = 1").count() == 12
    assert sm.document_rates(no_documents, labels).count() == 0
    assert sm.mixed_documents(odd_documents, none).count() == 12
    assert sm.mixed_documents(no_documents, labels).count() == 0
    with pytest.raises(ValueError, match="reserved"):
        sm.mixed_documents(odd_documents.withColumnRenamed("node", "__doc"), labels)
