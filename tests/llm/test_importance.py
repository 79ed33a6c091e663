import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidewell.llm import importance as im


def buckets(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(rows, target):
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for count, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            np.add.at(count, buckets(text)[1], 1)
    gain = [math.floor(1000 * math.log((t[k] + 1) * (int(s.sum()) + 10_000) / ((s[k] + 1) * (int(t.sum()) + 10_000)))) for k in range(10_000)]
    out = []
    for i, text in rows:
        n, own = buckets(text)
        weight = sum(gain[b] for b in own)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((k for k, r in enumerate(out) if r[1] >= 20), key=lambda k: (-out[k][4], out[k][0] is None, out[k][0] or 0, out[k][2], out[k][3]))
    rank = {k: r + 1 for r, k in enumerate(order[: 5 * len(order) // 100])}
    return sorted(((*r, rank.get(k)) for k, r in enumerate(out)), key=str)


def test_grams_equal_brute_force():
    rng = random.Random(0)
    texts = ["", "a", "A b c a b c", "Über x1 x1 x1", "a,b;c a b", "z" * 300 + " q " + "y" * 70, "...", "ß", "a\x00b c"]
    texts += [" ".join(rng.choice(["aa", "b", "ccc", "é", "ab1"]) for _ in range(rng.randrange(40))) for _ in range(80)]
    g, gain = im.Grams(pa.array(texts, pa.string())), np.arange(im.BUCKETS) ** 2 % 977 - 300
    want = [buckets(t)[1] for t in texts]
    assert g.bucket_counts().tolist() == np.bincount(sum(want, []), minlength=im.BUCKETS).tolist()
    assert g.sums(gain).tolist() == [sum(int(gain[b]) for b in own) for own in want] and g.features().tolist() == list(map(len, want))
    assert im.Grams(pa.array([], pa.string())).sums(gain).tolist() == []


@pytest.mark.parametrize("high", [3, 1 << im.BITS])
def test_suffix_array(high):
    rng = np.random.default_rng(0)
    ids = np.append(rng.integers(0, 4, size=500), [high])
    order, prefix = im.suffix_array(ids)
    padded = ids.tolist() + [0, 0]
    assert order.tolist() == sorted(range(501), key=lambda k: (padded[k : k + 3], k))
    for k in range(1, 501):
        a, b = (padded[order[j] : order[j] + 3] for j in (k - 1, k))
        assert prefix[k] == next((n for n in range(3) if a[n] != b[n]), 3)


def test_checksums_combine():
    rng = random.Random(1)
    parts = [(rng.randbytes(rng.randrange(9)), rng.randbytes(rng.randrange(3000))) for _ in range(50)]
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    got = im.joined(crc(a for a, _ in parts), crc(b for _, b in parts), np.array([len(b) for _, b in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


def test_whole_tables(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    rows += [(1, rows[0][1]), (1, rows[0][1]), (None, rows[3][1]), (5000, None), (5001, "word " * 70_000)]
    target = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    df, goal = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t, 1) for t in target], "text string, rank int")
    for some, texts in ((goal, target), (goal.where("false"), [])):
        got = im.resampled(df, some)
        assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, texts)


def test_odd_rows(spark, odd_documents, no_documents):
    target = spark.createDataFrame([("the quick brown fox",), (None,)], "text string")
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    assert sorted((tuple(r) for r in im.resampled(odd_documents, target).collect()), key=str) == brute(rows, ["the quick brown fox", None])
    assert im.resampled(no_documents, target).count() == 0
