import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark, tmp_path):
    from test_fuzzy_lines import brute
    from test_order_minhash import brute_classes

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        before, after = ({(r["doc_id"], r["text"]) for r in d.collect()} if "text" in d.columns else None for d in (docs, out))
        if name == "packing":
            rows = out.collect()
            by = {}
            for r in rows:
                by.setdefault(r["sequence_id"], []).append(r)
            for own in by.values():
                at = 0
                for r in sorted(own, key=lambda r: r["offset"]):
                    assert r["offset"] == at
                    at += r["length"]
                assert at <= 1024
            assert {r["doc_id"] for r in rows} == {i for i, _ in before}
            break
        assert out.columns == docs.columns
        if name == "line dedup":
            want = brute(sorted(before))
            assert sum(dict(after)[i] != want[i] for i in want) <= 2
        elif name == "near dedup":
            want = {min(c) for c in brute_classes(sorted(before))}
            assert {i for i, _ in after} == want and len(after) == out.count()
        else:
            assert after <= before and len(after) > 0.6 * len(before)
        docs = out


def test_odd_tables(spark, odd_documents, no_documents):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd_documents, no_documents):
            out = stage(spark, docs, SF)
            assert name == "packing" or out.columns == docs.columns
            n = out.count()
            assert n <= 4 * docs.count() + (20 if name == "packing" else 0) and (n or docs is no_documents)
    assert corpus_pipeline.near_dedup(spark, odd_documents, SF).where("doc_id = 2").count() == 0
    assert corpus_pipeline.near_dedup(spark, odd_documents, SF).where("doc_id IS NULL").count() == 1


def test_packing_is_full(spark):
    from tidewell.llm import slack_packing as sp

    rng = random.Random(2)
    counts = {}
    for _ in range(20_000):
        n = min(1023, max(1, int(rng.lognormvariate(5, 1))))
        counts[n] = counts.get(n, 0) + 1
    plan = sp.bin_plan(counts, 1024)
    used = {}
    for times, combination in plan:
        assert sum(k * n for k, n in combination.items()) <= 1024
        for k, n in combination.items():
            used[k] = used.get(k, 0) + n * times
    assert used == counts
    bins, tokens = sum(t for t, _ in plan), sum(k * n for k, n in counts.items())
    assert bins <= 1.002 * (tokens / 1024) + 2
    assert len(plan) < 4000
