import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import byte_cnn, convolution, toxicity_cnn

SF = "/root/testdata/sf0.01"


def auc(rows, label):
    up, down = ([r["score"] for r in rows if r[label] == k] for k in (1, 0))
    return np.mean([(a > b) + (a == b) / 2 for a in up for b in down])


@pytest.mark.parametrize("score, label, better", [(toxicity_cnn.score_toxicity, "toxic", 0.9), (byte_cnn.score_quality, "quality", 0.95)])
def test_held_out(spark, score, label, better):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert auc(rows, label) > better
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("score, cut", [(toxicity_cnn.score_toxicity, 0.5), (byte_cnn.score_quality, 0.7)])
def test_odd_rows(spark, odd_documents, no_documents, score, cut):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for used in (labels, spark.createDataFrame([], labels.schema), spark.createDataFrame([(None, None, None), (1, None, 1)], labels.schema)):
        rows = score(odd_documents, used).collect()
        assert len(rows) == 12 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (3, 4, 7)}) == 1
    assert score(no_documents, labels).count() == 0


def two_kinds(spark, n=60):
    rng = random.Random(1)
    word = lambda k: rng.choice(["awful", "nasty", "vile"] if k else ["calm", "gentle", "kind"])
    rows = [(i, " ".join(["the tale of"] + [word(i % 2) for _ in range(12)]), i % 2) for i in range(n)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y, y) for i, _, y in rows], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("score, label, cut", [(toxicity_cnn.score_toxicity, "toxic", 0.5), (byte_cnn.score_quality, "quality", 0.7)])
def test_fits_a_few_rows(spark, score, label, cut):
    docs, labels = two_kinds(spark)
    rows = score(docs, labels).join(labels, "doc_id").collect()
    assert len(rows) == 60 and auc([r for r in rows if r["held_out"]], label) == 1
    assert np.mean([r["predicted"] == r[label] for r in rows]) > 0.9


def test_one_long_text_does_not_starve_a_class(spark):
    """The probe of a long text with the least hash: both classes keep all their rows, and the text is read to its end."""
    docs, labels = two_kinds(spark)
    first = labels.where("toxic = 1").orderBy(F.xxhash64("doc_id", F.lit(0).cast("long"))).first()["doc_id"]
    long = " ".join(f"filler{i}" for i in range(100_000)) + " lastword"
    docs = docs.withColumn("text", F.when(F.col("doc_id") == first, F.lit(long)).otherwise(F.col("text")))
    texts, y, weight = convolution.labelled_sample(docs, labels, "toxic", F.lit(True))
    pieces = -(-len(long) // convolution.PIECE_CHARS)
    assert (y == 1).sum() == 29 + pieces and (y == 0).sum() == 30 and max(map(len, texts)) <= convolution.PIECE_CHARS
    assert sum(t.endswith("lastword") for t in texts) == 1
    assert np.isclose(weight[y == 1].sum(), weight[y == 0].sum())
    own = np.array([len(t) > 1000 for t in texts])
    assert weight[own].sum() < 1.01 * weight[y == 0].max()
    few, y, _ = convolution.labelled_sample(docs, labels, "toxic", F.lit(True), rows=10)
    assert len(few) == 20 and y.sum() == 10


def test_sample_without_rows(spark):
    docs, labels = two_kinds(spark)
    texts, y, weight = convolution.labelled_sample(docs, labels.where("false"), "toxic", F.lit(True))
    assert texts == [] and len(y) == len(weight) == 0


def test_pooling_covers_whole_texts():
    c = byte_cnn.Chunked(pa.array(["", "a" * 10, "b" * 5000]))
    covered = np.zeros(5000, bool)
    for begin, length in zip(c.begin[2:] - c.offsets[2], c.length[2:]):
        covered[begin : begin + length] = True
    assert covered.all() and c.counts[:2].tolist() == [1, 1]
    p = toxicity_cnn.initial(1, 50)
    e = toxicity_cnn.Encoded(pa.array([" ".join(f"w{i % 700}" for i in range(3000)), "one two", ""]), np.random.default_rng(0).integers(0, 50, toxicity_cnn.BUCKETS).astype(np.int32))
    whole, parts = (toxicity_cnn.logits_of(e, p, toxicity_cnn.tables(p), most) for most in (400_000, 256))
    assert np.allclose(whole, parts, atol=1e-5)


def test_byte_network_equals_a_naive_convolution():
    text = "Zürich is far; naïve bytes " * 40
    p = byte_cnn.initial(3)
    c = byte_cnn.Chunked(pa.array([text]))
    best = []
    for begin, length in zip(c.begin, c.length):
        chunk = [b + 1 for b in text.encode()[begin : begin + length]] + [0] * (byte_cnn.CHUNK - length)
        values = []
        for at in range(0, byte_cnn.CHUNK - byte_cnn.WINDOW + 1, byte_cnn.STRIDE):
            vectors = [p["e"][b] if b else 0 * p["e"][0] for b in chunk[at : at + byte_cnn.WINDOW]]
            values.append(np.maximum(0, sum(v @ p["w"][j] for j, v in enumerate(vectors)) + p["b"]))
        best.append(np.max(values, axis=0))
    want = np.concatenate([np.mean(best, axis=0), np.max(best, axis=0)]) @ p["o"] + p["c"][0]
    assert np.isclose(byte_cnn.logits_of(c, p)[0], want, atol=1e-4)
    assert len(c.begin) > 1


def test_word_network_equals_a_naive_convolution():
    rows = np.random.default_rng(0).integers(1, 50, toxicity_cnn.BUCKETS).astype(np.int32)
    rows[0] = 0
    p = toxicity_cnn.initial(2, 50)
    e = toxicity_cnn.Encoded(pa.array(["some words, and (some) more Words here"]), rows)
    vectors = [p["e"][[r for r in e.subs[i] if r]].sum(axis=0) if i else np.zeros(toxicity_cnn.WIDTH) for i in e.ids]
    best = []
    for n in toxicity_cnn.SIZES:
        windows = [sum(vectors[at + j] @ p[f"w{n}"][j] for j in range(n) if at + j < len(vectors)) for at in range(int(e.counts[0]) + 1)]
        best.append(np.max(np.maximum(0, windows), axis=0))
    want = np.concatenate(best) @ p["o"] + p["c"][0]
    assert np.isclose(toxicity_cnn.logits_of(e, p, toxicity_cnn.tables(p))[0], want, atol=1e-4)


def test_toxicity_learns_from_rows_outside_the_first_sample(spark):
    """A word found only in toxic texts that the first fit never saw is learnt, and counted, and the rest still is."""
    docs, labels = two_kinds(spark, 1200)
    drawn = {r["doc_id"] for r in convolution.labelled_rows(docs, labels, "toxic", toxicity_cnn.bucket_of("doc_id", 5) > 0, 60).collect()}
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    outside = ~F.col("doc_id").isin(sorted(drawn)) & (F.col("doc_id") % 4 == 1)  # toxic by its odd number
    text = F.when(outside, F.lit("the tale of zork zork zork zork zork zork")).otherwise(F.col("text"))
    rows = toxicity_cnn.score_toxicity(docs.select("doc_id", text.alias("text")), labels, sample=60).join(labels, "doc_id").where(held).withColumn("new", outside).collect()
    assert len([r for r in rows if r["new"]]) > 30 and all(r["predicted"] == 1 for r in rows if r["new"])
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.98


def test_thresholds_come_from_all_rows(spark):
    rows = [(float(k % 50) / 10 + (1.0 if language else 0.0), language, int(k % 50 >= 20)) for k in range(400) for language in (0, 1)] + [(-3.0, 2, 1)] * 3
    told = spark.createDataFrame(rows, "logit double, language int, y int")
    cuts = toxicity_cnn.thresholds(told, np.zeros(len(toxicity_cnn.LANGUAGES) + 1))
    assert abs(cuts[0] - 1.95) < 0.05 and abs(cuts[1] - 2.95) < 0.05 and len(set(cuts[2:])) == 1
    assert (toxicity_cnn.thresholds(told.where("language = 2"), np.full(len(toxicity_cnn.LANGUAGES) + 1, 0.7)) == 0.7).all()
