import numpy as np
import pytest

from tidewell.llm import ball_tree as bt


def brute(rows):
    """rows: (vec_id, embedding, label)."""
    x = []
    for i, v, label in rows:
        if i is None or label is None or v is None or not all(c is not None and np.isfinite(c) for c in v):
            continue
        x.append((i, (label + 1) % 10 if i % 7 == 0 else label, np.floor(256 * np.array(v, np.float64)).astype(np.int64)))
    out = []
    for i in sorted({r[0] for r in x if r[0] % 100 == 0}):
        label, q = min(((r[1], r[2]) for r in x if r[0] == i), key=lambda r: (r[1].tolist(), r[0]))
        scored = [(-int(sum(a * b for a, b in zip(q, v))), j, own == label) for j, own, v in x if j != i]
        asked = {}
        for score, j, _ in sorted(s for s in scored if s[2])[:5]:
            asked[j, -score] = sorted((s, k) for s, k, same in scored if not same and 80 * -score <= 100 * -s <= 100 * -score)[:5]
        out += [(i, j, r + 1, k, score, -s) for (j, score), best in asked.items() for r, (s, k) in enumerate(best)]
    return sorted(out)


def mined(spark, rows, **columns):
    df = spark.createDataFrame([(i, v, y, 1) for i, v, y in rows], "vec_id long, embedding array<double>, label int, rank int")
    got = bt.hard_negatives(df)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("seed, high", [(s, h) for s in range(4) for h in (False, True)])
def test_search_equals_brute_force(seed, high):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, 12)) * 30
    x = np.floor(centres[rng.integers(8, size=1500)] + rng.normal(size=(1500, 12)) * 3).astype(np.int64)
    ids, labels = rng.permutation(1500), rng.integers(3, size=1500)
    tree = bt.Tree(ids, labels, x)
    assert sorted(tree.ids) == list(range(1500))
    asks = rng.choice(1500, 40, replace=False)
    top = None if not high else np.sort(x @ x[asks].T, axis=0)[-rng.integers(1, 300, size=40), np.arange(40)]
    queries = bt.Queries(ids[asks], labels[asks], x[asks], np.full(40, bt.NONE), top)
    best, opened = bt.searched(tree, queries, 5)
    for q in range(40):
        fits = lambda k: (labels[k] == queries.labels[q]) if top is None else labels[k] != queries.labels[q] and 100 * (x[k] @ queries.x[q]) >= 80 * top[q] and x[k] @ queries.x[q] <= top[q]
        want = sorted((-int(x[k] @ queries.x[q]), int(ids[k])) for k in range(1500) if ids[k] != queries.ids[q] and fits(k))[:5]
        own = best.q == q
        assert list(zip((-best.score[own]).tolist(), best.id[own].tolist())) == want
    assert opened < 40 * len(tree.radii[-1]) / 2  # most leaves are skipped


def test_balls_hold_their_rows():
    rng = np.random.default_rng(3)
    x = rng.integers(-500, 500, size=(700, 9))
    tree = bt.Tree(np.arange(700), rng.integers(2, size=700) * (np.arange(700) < 300), x)
    q = rng.integers(-500, 500, size=(6, 9))
    size = np.sqrt((q.astype(float) ** 2).sum(axis=1))
    for e, centre, radius, mixed, first in zip(tree.edges, tree.centres, tree.radii, tree.mixed, tree.first):
        low, up = bt.interval(q, size, centre, radius)
        for k, (a, b) in enumerate(zip(e[:-1], e[1:])):
            assert (low[:, k, None] <= q @ tree.x[a:b].T).all() and (q @ tree.x[a:b].T <= up[:, k, None]).all()
            own = tree.labels[a:b]
            assert mixed[k] == (len(set(own)) > 1) and first[k] == own[0]


def test_whole_table_with_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=8) / 3 + 0.2], int(rng.integers(4))) for i in range(600)]
    rows += [(i, rows[0][1], i % 4) for i in range(600, 760)]  # one very common vector
    rows += [(900, None, 1), (1000, [1.0, None] + [0.0] * 6, 1), (1100, [float("nan")] * 8, 1), (None, rows[1][1], 1), (1200, [float("inf")] * 8, 2), (1300, rows[2][1], None)]
    assert mined(spark, rows) == brute(rows) and len(brute(rows)) > 100
    assert mined(spark, []) == [] and mined(spark, rows[1:50]) == []


def test_repeated_ids_and_negative_scores(spark):
    """Of repeated anchors the least vector asks, once; a positive of negative score has no negatives; shorter vectors end in zeros."""
    rows = [(100, [0.5, 0.5], 1), (100, [0.25, 1.0], 2), (100, [0.25, 1.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2), (2, [0.9, 0.0], 2), (3, [0.8], 3), (4, [-1.0, 0.0], 1), (5, [-0.9, 0.0], 3)]
    got = mined(spark, rows)
    assert got == brute(rows) and {r[1] for r in got} == {1}


def test_many_parts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in np.round(rng.normal(size=6), 2)], int(rng.integers(3))) for i in range(900)]
    for name, value in (("SUPER", 64), ("ROOTS", 3), ("ASKING", 2)):
        monkeypatch.setattr(bt, name, value)
    assert mined(spark, rows) == brute(rows)
