"""Segmentation against dynamic programming over words as they stand, and Chinese queries that find their documents."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.operators import retrieval, segmentation
from tidewell.operators.inverted_index import InvertedIndex

LEXICON = [("垃圾", 20), ("回收", 20), ("垃圾回收", 30), ("机制", 15), ("器", 5), ("内存", 25), ("内", 2), ("存", 2), ("分配", 9), ("的", 60), ("研究", 8), ("研究生", 9), ("生命", 9), ("命", 3), ("起源", 7)]
TEXTS = {1: "Java垃圾回收机制", 2: "内存分配的研究", 3: "研究生命的起源 G1 GC", 4: "cats and dogs", 5: None, 6: "", 7: "未知字"}


def best_path(words, run):
    total = sum(words.values()) + 1.0
    best = [(0.0, [])] + [None] * len(run)
    for t in range(1, len(run) + 1):
        for n in range(1, t + 1):
            w = run[t - n : t]
            p = math.log(words[w] / total) if w in words else math.log(0.5 / total) if n == 1 else None
            if p is not None and (n == 1 or w in words):
                p = max(p, math.log(0.5 / total)) if n == 1 else p
                if best[t] is None or best[t - n][0] + p >= best[t][0]:
                    best[t] = best[t - n][0] + p, [*best[t - n][1], w]
    return best[-1][1]


def test_known_sentences():
    lattice = segmentation.Lattice([w for w, _ in LEXICON], np.array([n for _, n in LEXICON], float))
    assert segmentation.segmented(lattice, ["垃圾回收机制", "研究生命的起源", "", "未知"]) == [["垃圾回收", "机制"], ["研究", "生命", "的", "起源"], [], ["未", "知"]]


@pytest.mark.parametrize("seed", range(5))
def test_equals_dynamic_programming(seed):
    rng = random.Random(seed)
    letters = "甲乙丙丁戊"
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))): rng.randrange(1, 100) for _ in range(30)}
    runs = ["".join(rng.choice(letters + "己") for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    lattice = segmentation.Lattice(list(words), np.array(list(words.values()), float))
    for run, got in zip(runs, segmentation.segmented(lattice, runs)):
        want = best_path(words, run)
        log = lambda ws: sum(math.log(words.get(w, 0.5) / (sum(words.values()) + 1.0)) for w in ws)
        assert "".join(got) == run and math.isclose(log(got), log(want), abs_tol=1e-9)


def test_chinese_queries_get_hits(spark, tmp_path):
    lexicon = spark.createDataFrame(LEXICON, "word string, n long")
    terms = segmentation.segmenter(lexicon)
    texts = spark.createDataFrame(list(TEXTS.items()), "id long, text string")
    words = {r["id"]: r["w"] for r in texts.select("id", terms(F.col("text")).alias("w")).collect()}
    assert words == {1: ["垃圾回收", "机制", "java"], 2: ["内存", "分配", "的", "研究"], 3: ["研究", "生命", "的", "起源", "g1", "gc"], 4: ["cats", "and", "dogs"], 5: [], 6: [], 7: ["未", "知", "字"]}
    queries = spark.createDataFrame([(1, "什么是垃圾回收"), (2, "生命起源"), (3, "dogs"), (4, "知")], "qid long, text string")
    hits = {(r["qid"], r["id"]) for r in retrieval.bm25_of_texts(queries, texts, 5, terms=terms).collect()}
    assert hits == {(1, 1), (2, 3), (3, 4), (4, 7)}
    assert {(r["qid"], r["id"]) for r in retrieval.bm25_of_texts(queries, texts, 5).collect()} == {(3, 4)}  # without segmentation none of them
    index = InvertedIndex(spark, f"{tmp_path}/index", buckets=4, terms=terms)
    index.appended(texts)
    assert {(r["qid"], r["id"]) for r in index.search(queries, 5).collect()} == hits


def test_learnt_lexicon(spark, monkeypatch):
    rng = random.Random(1)
    words = ["垃圾", "回收", "内存", "分配", "研究生", "起源"]
    texts = ["".join(rng.choice(words) for _ in range(30)) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,), ("latin only",)], "text string")
    lexicon = segmentation.learnt_lexicon(df, least=5, cohesion=1.2)
    learnt = {r["word"] for r in lexicon.collect()}
    assert set(words) <= learnt and learnt >= set("".join(words))
    known = lexicon.where(F.col("word").isin(words)).collect()
    lattice = segmentation.Lattice([r["word"] for r in known], np.array([r["n"] for r in known], float))
    assert segmentation.segmented(lattice, ["内存分配研究生"]) == [["内存", "分配", "研究生"]]
    monkeypatch.setattr(segmentation, "LEXICON_ROWS", 3)
    with pytest.raises(ValueError):
        segmentation.segmenter(lexicon)


def test_one_long_run_among_many_short_ones_takes_memory_of_its_length():
    rng = random.Random(3)
    words = {"".join(rng.choice("甲乙丙丁") for _ in range(rng.randrange(1, 6))): rng.randrange(1, 100) for _ in range(60)}
    runs = ["".join(rng.choice("甲乙丙丁己") for _ in range(30_000))] + ["".join(rng.choice("甲乙丙丁己") for _ in range(rng.randrange(1, 12))) for _ in range(1500)]
    lattice = segmentation.Lattice(list(words), np.array(list(words.values()), float))
    tracemalloc.start()
    got = segmentation.segmented(lattice, runs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # a table of all runs by the longest one's length would be 720 MB
    assert ["".join(g) for g in got] == runs
    assert got[1:50] == [best_path(words, r) for r in runs[1:50]]


def test_blocks_and_slices_change_nothing(monkeypatch):
    rng = random.Random(4)
    words = {"".join(rng.choice("甲乙丙") for _ in range(rng.randrange(1, 7))): rng.randrange(1, 9) for _ in range(40)}
    runs = ["".join(rng.choice("甲乙丙己") for _ in range(rng.randrange(0, 300))) for _ in range(120)]
    lattice = segmentation.Lattice(list(words), np.array(list(words.values()), float))
    whole = segmentation.segmented(lattice, runs)
    monkeypatch.setattr(segmentation, "BLOCK", 37)
    monkeypatch.setattr(segmentation, "SLICE_CHARS", 700)
    assert segmentation.segmented(lattice, runs) == whole
    assert [w for runs in segmentation.cut_texts(lattice, pa.array([runs], pa.list_(pa.string()))).to_pylist()[0] for w in runs] == [w for r in whole for w in r]
