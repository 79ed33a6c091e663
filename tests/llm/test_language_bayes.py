import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewell.llm import language_bayes as lb


def trains(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 != 0


def grams(text):
    """n-grams of letters, 0 for what is none and for both ends of a word; zeros stand at the ends of an n-gram alone."""
    import re

    out = []
    for word in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        codes = [0] + [ord(c) if unicodedata.category(c)[0] in "LM" else 0 for c in word.lower()] + [0]
        for n in (1, 2, 3):
            own = [tuple(codes[k : k + n]) for k in range(len(codes) - n + 1)]
            out += [g for g in own if any(g) and all(g[1:-1])]
    return out


def bucket(gram, buckets):
    x = np.full(1, len(gram), np.uint64)
    for c in gram:
        x = lb.mixed(x * np.uint64(0x100000001B3) + np.uint64(c))
    return int(x[0] % np.uint64(buckets))


def brute(rows, buckets):
    languages = sorted({lang for i, _, lang in rows if trains(i) and lang is not None})
    counts, texts, hashed = {k: Counter() for k in languages}, Counter(), {}
    hashes = lambda text: [hashed.setdefault(g, None) or hashed.__setitem__(g, bucket(g, buckets)) or hashed[g] for g in grams(text)]
    for i, text, lang in rows:
        if trains(i) and lang is not None:
            texts[lang] += 1
            counts[lang].update(hashes(text))
    out = []
    for i, text, _ in rows:
        own = Counter(hashes(text))
        if not own or not languages:
            out.append((i, "und", 0.0))
            continue
        total = [np.log(texts[k] / sum(texts.values())) + sum(n * np.log((counts[k][b] + lb.SMOOTH) / (sum(counts[k].values()) + lb.SMOOTH * buckets)) for b, n in own.items()) for k in languages]
        best = int(np.argmax(total))
        out.append((i, languages[best], 1 / np.exp(np.array(total) - total[best]).sum()))
    return out


ROWS = [(i, t, lang) for i, (t, lang) in enumerate([("der hund und die katze", "de"), ("the dog and the cat", "en"), ("le chien et le chat", "fr"), ("ß 12 Straße", "de"), ("it's here, isn't it?", "en"), ("été à l'école", "fr")] * 6)]
ROWS += [(100, "", "en"), (101, None, "de"), (102, "123 ... 456", "fr"), (103, "die straße", None), (None, "the end", "xx"), (104, "e", "en"), (105, "日本 語", "ja"), (105, "日本 語", "ja"), (110, "the " * 30_000, "en")]


def check(got, want):
    assert len(got) == len(want)
    key = lambda r: (str(r[0]), r[1], round(r[2], 4))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-3


def test_equals_brute_force(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, lang string, score int")
    rows = lb.identified(df).collect()
    check([(r["doc_id"], r["lang_pred"], r["score"]) for r in rows], brute(ROWS, lb.BUCKETS))
    assert all(r["held_out"] == (r["doc_id"] is not None and not trains(r["doc_id"])) for r in rows)


def test_no_training_rows_and_odd_rows(spark, odd_documents, no_documents):
    schema = "doc_id long, text string, lang string"
    got = lb.identified(spark.createDataFrame([(1, "words", None), (2, None, None)], schema)).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd_documents.collect()]
    check([(r["doc_id"], r["lang_pred"], r["score"]) for r in lb.identified(odd_documents).collect()], brute(rows, lb.BUCKETS))
    assert lb.identified(no_documents).count() == 0


def test_buckets_shrink_with_languages(spark, monkeypatch):
    monkeypatch.setattr(lb, "MATRIX_BYTES", 4 * 4 * (1 << 12))
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    assert len(lb.fitted(df).logs) == 1 << 12
    monkeypatch.setattr(lb, "MATRIX_BYTES", 4 * 3 * lb.LEAST_BUCKETS)
    with pytest.raises(ValueError, match="values of lang"):
        lb.fitted(df)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lb.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_long_texts_score_alike():
    m = lb.Model(["a", "b"], np.log([0.5, 0.5]), np.random.default_rng(0).normal(size=(64, 2)).astype(np.float32))
    one, both = (lb.predictions(m, pa.array(t, pa.string())) for t in (["Some words here"], ["other", "Some words here", ""]))
    assert one[0][0] == both[0][1] and np.isclose(one[1][0], both[1][1]) and both[0][2] == -1
