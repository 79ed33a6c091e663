import math
import re
import zlib
from collections import Counter

import numpy as np

from tidewell.llm import hmm


def tokens(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def part(i):
    return -1 if i is None else zlib.crc32(str(i).encode()) % 5


def test_forward_is_exact():
    rng = np.random.default_rng(0)
    a, b = rng.dirichlet(np.ones(hmm.STATES), hmm.STATES), rng.dirichlet(np.ones(30), hmm.STATES).T
    start = rng.dirichlet(np.ones(hmm.STATES))
    m = hmm.Model(start, start, a, b)
    flats = [rng.integers(30, size=n).astype(np.uint16) for n in (40, 17, 17, 1)]
    flat, lengths = np.concatenate(flats), np.array([len(f) for f in flats])
    got = hmm.forward(m, flat, np.cumsum(lengths) - lengths, lengths)
    for f, score in zip(flats, got):
        alpha = m.start.astype(float) * m.b[f[0]]
        for t in f[1:]:
            alpha = (alpha @ m.a.astype(float)) * m.b[t]
        assert abs(score - math.log10(alpha.sum())) < 1e-6


def test_counts_equal_slow_forward_backward():
    rng = np.random.default_rng(1)
    a, b = rng.dirichlet(np.ones(hmm.STATES), hmm.STATES), rng.dirichlet(np.ones(12), hmm.STATES).T
    start = rng.dirichlet(np.ones(hmm.STATES))
    m = hmm.Model(start, start, a, b)
    f = rng.integers(12, size=9).astype(np.uint16)
    s, c, moves, posterior, _, likelihood = hmm.expected_counts(m, f, np.array([0]), np.array([9]), np.array([True]))
    alpha, beta = [start * b[f[0]]], [np.ones(hmm.STATES)]
    for t in f[1:]:
        alpha.append((alpha[-1] @ a) * b[t])
    for t in f[:0:-1]:
        beta.insert(0, a @ (b[t] * beta[0]))
    total = alpha[-1].sum()
    assert np.isclose(likelihood, np.log(total), atol=1e-4)
    assert np.allclose(posterior, np.array(alpha) * np.array(beta) / total, atol=1e-4)
    want = sum(np.outer(alpha[t], b[f[t + 1]] * beta[t + 1]) * a / total for t in range(8))
    assert np.allclose(moves, want, atol=1e-3) and np.allclose(s, posterior[0]) and not c.any()


def test_base_score_and_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 300")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    count = Counter()
    for i, t in rows:
        if part(i) != 1:
            count.update(tokens(t))
            count[None] += 1
    n, v = sum(count.values()), len(count)
    got = {r["doc_id"]: r for r in hmm.score_texts(docs, classes=500, rounds=3).collect()}
    better = []
    for i, t in rows:
        own = [*tokens(t), None]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (part(i) == 1, len(own), sum(count[w] > 0 for w in own), n)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) + 1e-9
        better.append(r["score"] - r["base_score"] if part(i) == 1 else 0)
    assert sum(better) > 0


def test_production_rounds_part_states_of_a_dozen_rows(spark, monkeypatch):
    """Every round reads all training texts, and the states of a dozen rows differ."""
    ids = list(range(12))
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 7} and" for k in range(1, 30))) for i in ids], "doc_id long, text string")
    models, reads, scorer, counted = [], [], hmm.scorer, hmm.next_model
    monkeypatch.setattr(hmm, "scorer", lambda m: models.append(m) or scorer(m))
    monkeypatch.setattr(hmm, "next_model", lambda m, v, training: reads.append(training.count()) or counted(m, v, training))
    assert hmm.score_texts(docs).count() == 12
    assert reads == [sum(part(i) != 1 for i in ids)] * len(reads) and 2 < len(reads) <= hmm.ROUNDS
    b = models[0].b
    assert np.abs(b - b[:, :1]).max() > 1e-3


def test_likelihood_rises_and_ends_the_rounds(spark, monkeypatch):
    """Each round's likelihood a token exceeds the last one's; a round that gains less than asked for is the last. Six rounds beat the base by far, held out too."""
    docs, told, train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), [], hmm.trained
    monkeypatch.setattr(hmm, "trained", lambda *a: told.append(train(*a)) or told[-1])
    rows = hmm.score_texts(docs).where("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b", "sum(n_tokens) AS n").first()
    rounds = told[0][1]
    assert len(rounds) == hmm.ROUNDS and all(b > a for a, b in zip(rounds, rounds[1:])) and rounds[-1] > rounds[0] + 0.5
    assert rows["s"] / rows["n"] > rows["b"] / rows["n"] + 0.1  # decimal logarithms of a token
    monkeypatch.setattr(hmm, "trained", lambda v, training, rounds: told.append(train(v, training, rounds, 10.0)) or told[-1])
    hmm.score_texts(docs.where("doc_id < 50")).count()
    assert len(told[1][1]) == 2


def test_odd_rows(odd_documents, no_documents):
    out = hmm.score_texts(odd_documents, rounds=1).collect()
    assert len(out) == 12 and all(np.isfinite(r["score"]) and r["score"] < 0 for r in out)
    assert {r["n_tokens"] for r in out if r["doc_id"] in (3, 4, 5, 7)} == {1}
    assert hmm.score_texts(no_documents, rounds=1).count() == 0
