"""Full text for all queries at once: a task gives k rows a query, whatever the number of texts, and the same as joins."""

import random

import pytest

from tidewell import session
from tidewell.operators import retrieval


def frames(spark, n=300):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = [(i, " ".join(["common"] + [rng.choice(words) for _ in range(rng.randrange(0, 30))])) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "...")]
    queries = [(q, " ".join(["common"] + [rng.choice(words) for _ in range(4)])) for q in range(6)] + [(6, "absent"), (7, "")]
    return spark.createDataFrame(queries, "qid long, text string"), spark.createDataFrame(texts, "id long, text string").repartition(3)


def test_a_task_gives_k_rows_a_query(spark, monkeypatch):
    queries, texts = frames(spark)
    monkeypatch.setattr(retrieval, "best", lambda found, k: found)
    assert retrieval.bm25_of_texts(queries, texts, 4).count() <= 3 * 4 * 6


@pytest.mark.parametrize("options", [{}, {"k": 5}, {"k": 5, "match_all": True}, {"match_all": True}])
@pytest.mark.parametrize("cells", [1 << 20, 50])
def test_equals_joins(spark, monkeypatch, options, cells):
    queries, texts = frames(spark)
    monkeypatch.setattr(retrieval, "CELLS", cells)
    told = lambda: sorted(map(tuple, retrieval.bm25_of_texts(queries, texts, **options).collect()))
    got = told()
    monkeypatch.setattr(retrieval, "MOST_ASKED", 0)
    want = told()
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=2e-9)


@pytest.mark.parametrize("ask", [lambda q, t: retrieval.bm25_of_texts(q, t, 4), lambda q, t: retrieval.shared_terms(retrieval.terms_of(q), t.select("id", retrieval.tokens("text").alias("words")), 4)])
def test_words_are_split_after_texts_are_dealt(spark, monkeypatch, ask):
    """A filter on words would move before the dealing, where one row group is one task, and split all texts there too."""
    queries, texts = frames(spark)
    plans = []
    read = retrieval.Asked.counted

    def counted(self):
        plans.append(True)
        return read(self)

    monkeypatch.setattr(retrieval.Asked, "counted", counted)
    monkeypatch.setattr(retrieval, "written", lambda df, name: plans.append(df) or df)
    plans.append(ask(queries, texts))
    dealt = [p._jdf.queryExecution().optimizedPlan().toString() for p in plans if p is not True]
    below = [p[p.index("Repartition") :] for p in dealt if "Repartition" in p]
    assert True in plans and below and all("split(" not in p for p in below)


def test_large_inputs_are_dealt_if_few_tasks_hold_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "SPREAD_BYTES", 0)
    rows = spark.range(1000).selectExpr("id", "repeat('x', 20) AS text")
    rows.coalesce(1).write.parquet(f"{tmp_path}/one")
    rows.repartition(8).write.parquet(f"{tmp_path}/even")
    monkeypatch.setitem(session.spread.__globals__, "planned_bytes", lambda df: 1 << 20)
    with_setting(spark, "spark.sql.files.openCostInBytes", "200000000", lambda: [
        check(session.spread(spark.read.parquet(f"{tmp_path}/{name}")), moved) for name, moved in (("one", True), ("even", False))
    ])


def check(df, moved):
    assert ("Repartition" in df._jdf.queryExecution().optimizedPlan().toString()) == moved and df.count() == 1000


def with_setting(spark, key, value, run):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        run()
    finally:
        spark.conf.set(key, before)
