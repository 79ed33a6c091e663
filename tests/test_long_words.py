"""Words of any length, and lexicons of which only a part goes to the tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import segmentation
from tidewell.plans.retrieval import segmented_words
from tests.test_segmentation import best_path


def test_words_of_any_length():
    rng = random.Random(2)
    words = {"".join(rng.choice("甲乙丙") for _ in range(rng.choice([1, 2, 5, 7, 8, 9, 13, 25, 70]))): rng.randrange(1, 50) for _ in range(150)}
    lattice = segmentation.Lattice(list(words), np.array(list(words.values()), float))
    runs = ["".join(rng.choice([*words, "己"]) for _ in range(12)) for _ in range(60)]
    log = lambda ws: sum(np.log(words.get(w, 0.5) / (sum(words.values()) + 1.0)) for w in ws)
    for run, got in zip(runs, segmentation.segmented(lattice, runs)):
        assert "".join(got) == run and log(got) == pytest.approx(log(best_path(words, run)), abs=1e-9)
    assert any(len(w) == 70 for ws in segmentation.segmented(lattice, runs) for w in ws)


@pytest.mark.parametrize("rows", [0, 5, 60])
def test_large_lexicons_meet_texts_in_a_join(spark, monkeypatch, rows):
    rng = random.Random(6)
    words = {"".join(rng.choice("甲乙丙丁") for _ in range(rng.choice([1, 2, 3, 6, 7, 11, 30]))): rng.randrange(1, 12) for _ in range(120)}
    texts = [(i, "".join(rng.choice([*words, "己", " and "]) for _ in range(rng.randrange(30)))) for i in range(40)] + [(3, "甲乙"), (3, "甲乙"), (None, "丙丁甲"), (50, None), (51, ""), (52, "latin")]
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    lexicon = spark.createDataFrame(list(words.items()), "word string, n long").union(spark.createDataFrame([(None, 5), ("", 5), ("乙乙乙", 0)], "word string, n long"))
    told = lambda: sorted(map(str, segmentation.with_words(df, "text", "found", lexicon).collect()))
    want = told()
    monkeypatch.setattr(segmentation, "LEXICON_ROWS", rows)
    monkeypatch.setattr(segmentation, "SLICE_CHARS", 500)
    assert told() == want and len(want) == len(texts)


def test_filters_have_no_false_no():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 5000).astype(np.uint64)
    bits = segmentation.Filter(5000)
    for k in range(segmentation.PROBES):
        bits.add(segmentation.probe(hashes, segmentation.WORD + k, bits.size))
    assert bits.has(hashes, segmentation.WORD).all() and bits.has(hashes + np.uint64(1), segmentation.WORD).mean() < 0.01


@pytest.mark.parametrize("rows", [500_000, 2000])
def test_segmented_words_has_all_words(spark, monkeypatch, rows):
    """Words of more than six letters are found too."""
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(segmentation, "LEXICON_ROWS", rows)
    got = {r["doc_id"]: (r["n_words"], r["n_found"], r["n_same"]) for r in segmented_words(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").select("doc_id", F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "").alias("w")).collect()
    counts = {}
    for r in docs:
        for w in r["w"]:
            counts[w] = counts.get(w, 0) + 1
    lattice = segmentation.Lattice(list(counts), np.array(list(counts.values()), float))
    assert len(got) == len(docs) and max(map(len, counts)) > 12
    log = dict(zip(counts, np.log(np.array(list(counts.values()), float) / lattice.total).tolist()))
    for r in sorted(docs, key=lambda r: r["doc_id"])[:40]:
        run, best = "".join(r["w"]), [(0.0, 0)]
        for t in range(1, len(run) + 1):
            ends = [(best[t - n][0] + log[run[t - n : t]], n) for n in range(1, min(t, 30) + 1) if run[t - n : t] in log] + [(best[t - 1][0] + lattice.unknown, 1)]
            best.append(max(ends))
        at, found = len(run), []
        while at:
            found.append(run[at - best[at][1] : at])
            at -= best[at][1]
        assert got[r["doc_id"]] == (len(r["w"]), len(found), len(set(found) & set(r["w"])))
