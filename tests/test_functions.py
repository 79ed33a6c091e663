"""Literal cases of functions and operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import jsons, scores, text
from tidewell.operators import documents, fusion, interview, memory, metrics
from tidewell.sources import files, tables
from tidewell.streaming import stateful


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_reciprocal_ranks(spark):
    lists = {"fts": [1, 2, 3], "vector": [2, 3, 1], "graph": [3, 1]}
    c = spark.createDataFrame([("q", ch, i, 1.0 / (n + 1)) for ch, ids in lists.items() for n, i in enumerate(ids)], "qid string, channel string, id long, score double")
    got = {r["id"]: r["rrf_score"] for r in fusion.reciprocal_rank_fusion(c).collect()}
    assert got[1] == got[3] == pytest.approx(1 / 61 + 1 / 62 + 1 / 63, abs=1e-8) and got[2] == pytest.approx(1 / 61 + 1 / 62, abs=1e-8)
    best = fusion.best(fusion.reciprocal_rank_fusion(c), 3, "rrf_score").orderBy("rank").collect()
    assert [r["id"] for r in best] == [1, 3, 2]


@pytest.mark.parametrize("counts, want", [([2, 3, 5], [0, 1 / 3, 1]), ([3, 3, 3], [0.6] * 3), ([4], [0.6])])
def test_graph_scores(spark, counts, want):
    df = spark.createDataFrame([("q", float(c), i) for i, c in enumerate(counts)], "qid string, score double, id long")
    assert [r["normalised"] for r in fusion.graph_scores(df).orderBy("id").collect()] == pytest.approx(want)


def test_lines(spark):
    lines = ["第 3 页", "Page 2 of 10", "--- Page 1/3 ---", "Chapter one", "12"]
    assert [one(spark, text.is_page_furniture(F.lit(x)))[0] for x in lines] == [True, True, True, False, True]
    noise = ["", "···", "……", "-", "你好", "2026年"]
    assert [one(spark, text.is_noise(F.lit(x)))[0] for x in noise] == [True] * 4 + [False] * 2
    assert one(spark, text.strip_boilerplate(F.lit("a\nCopyright 2020 X\n\n\n\nb\n")))[0] == "a\n\nb"


def test_urls(spark):
    cases = {"HTTP://User@Example.COM:80/A/b/?x=1#f": "http://example.com:80/A/b?x=1", "https://a.b/": "https://a.b"}
    assert {u: one(spark, text.normalised_url(F.lit(u)))[0] for u in cases} == cases
    base = F.lit("http://h.x/dir/page?q=1")
    assert one(spark, *[text.resolved(F.lit(x), base) for x in ("/a", "b", "//c.d/e", "mailto:x@y", "#z")]) == ("http://h.x/a", "http://h.x/dir/b", "http://c.d/e", None, None)


def test_text_parts(spark):
    assert one(spark, text.suggestion_map(F.lit("a; ;c")))[0] == {"1": "a", "3": "c"}
    assert one(spark, text.feedback_sentences(F.lit("short. A longer sentence! ok")))[0] == ["A longer sentence."]
    assert one(spark, *text.question_number(F.lit(" 3-f2 "))) == (3, 2) and one(spark, *text.question_number(F.lit("x"))) == (None, None)
    assert one(spark, text.joined_by_number(F.create_map(F.lit("10"), F.lit("b"), F.lit("2"), F.lit("a"))))[0] == "a; b"
    assert one(spark, text.identity(F.lit(" ")), text.identity(F.lit("a%")), text.identity(F.lit("bob"))) == ("unknown", "unknown", "bob")
    assert one(spark, text.split_claims(F.lit("one! two")), text.split_claims(F.lit("one"))) == (["one", "two"], ["one"])


def test_scores(spark):
    radar = scores.radar(F.lit(80), F.lit(70), F.lit(90))
    assert one(spark, radar["skills"], radar["potential"]) == (73, 77)
    nothing = scores.radar(*[F.lit(None).cast("int")] * 3)
    assert one(spark, *nothing.values()) == (0, 0, 0, 0, 0)
    assert one(spark, *scores.ten_scale([F.lit(8), F.lit(10), F.lit(7), F.lit(9)])) == (80, 100, 70, 90)
    assert one(spark, *scores.ten_scale([F.lit(8), F.lit(10), F.lit(11), F.lit(9)])) == (8, 10, 11, 9)
    turns = spark.createDataFrame([("s", 1, 80, False), ("s", 2, 61, False), ("s", 3, 59, False), ("s", 4, 10, True), ("t", 1, None, False)], "session string, seq int, score int, is_follow_up boolean")
    assert rows(interview.session_scores(turns), "session", "score", "n_scored") == [("s", 67, 3), ("t", None, 0)]
    assert one(spark, jsons.score_value(F.lit("79.6")), jsons.score_value(F.lit("x")), jsons.score_value(F.lit("120"))) == (80, None, 100)


def test_json(spark):
    fenced = F.lit('```json\n{"a": {"b": [{"output": "7"}]}}\n```')
    assert json.loads(one(spark, jsons.recovered(fenced))[0]) == {"a": {"b": [{"output": "7"}]}}
    assert one(spark, jsons.nested_value(F.lit('{"choices": [{"x": {"output": "found"}}]}'), "output"))[0] == "found"
    assert one(spark, jsons.string_list(F.lit('["a", " b "]')), jsons.string_list(F.lit("a; b,"))) == (["a", "b"], ["a", "b"])
    assert one(spark, jsons.ordered_map(F.lit('["x", ""]')), jsons.ordered_map(F.lit('{"k": "v"}'))) == ({"1": "x"}, {"k": "v"})
    assert one(spark, jsons.recovered(F.lit("no object")))[0] is None


def test_decay(spark):
    got = one(spark, *[memory.decayed(F.lit(0.9), F.lit(5.0), F.lit(k), F.lit(0)) for k in ("preference", "event", "fact")])
    assert got == pytest.approx((0.8018, 0.0281, 0.2835), abs=1e-4)
    assert one(spark, *[F.lit(0.9) * memory.cold_factor(F.lit(d)) for d in (90.0, 200.0, 60.0, 1.0)]) == pytest.approx((0.36, 0.27, 0.63, 0.9))
    assert one(spark, memory.decayed(F.lit(0.9), F.lit(31.0), F.lit("fact"), F.lit(0)))[0] is None


def test_metrics(spark):
    assert one(spark, *metrics.prf(F.lit(10), F.lit(2), F.lit(3))) == pytest.approx((10 / 12, 10 / 13, 20 / 25))
    assert one(spark, *metrics.prf(F.lit(0), F.lit(0), F.lit(0))) == (0, 0, 0)
    empty = spark.createDataFrame([], "label int, prediction int")
    assert metrics.kappa(empty).first()["kappa"] == 0
    hits = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("b", 2, "x"), ("c", 1, "q")], "qid string, rank int, item string")
    golden = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "n"), ("b", "m")], "qid string, item string")
    assert rows(metrics.first_hits(hits, golden, 5), "qid", "hit", "recall", "mrr") == [("a", 1, 1.0, 1.0), ("b", 1, pytest.approx(1 / 3), 0.5), ("c", 0, 0.0, 0.0)]
    pairs = spark.createDataFrame([(1, 1, 1, 1.0), (1, 1, 2, 1.0), (1, 2, 1, 1.0)], "sample long, expected long, got long, score double")
    assert rows(metrics.greedy_matches(pairs), "expected", "got") == [(1, 1)]


def test_follow_up(spark):
    reason = lambda ai, n, score: one(spark, interview.follow_up(F.lit(ai), F.lit(False), F.lit(n), F.lit(score), F.lit(0)))[0]
    assert [reason(True, 0, 80), reason(True, 2, 80), reason(False, 0, 50), reason(False, 0, 90)] == ["AI_SUGGESTED", "FOLLOW_UP_LIMIT_REACHED", "LOW_SCORE", "NO_TRIGGER"]


def test_chunks(spark):
    body = "A sentence about nothing in particular. " * 30
    two = documents.chunked_text(f"## first\n{body}\n### deep\n{body}\n## second\n{body * 6}")
    assert [c["title"] for c in two][:2] == ["first", "first > deep"] and all(len(c["content"]) <= 4000 for c in two)
    assert all(len(x) <= 300 for c in two for x in c["children"]) and {c["title"] for c in two} == {"first", "first > deep", "second"}
    assert documents.chunked_text("short") == [] and documents.chunked_text(None) == []
    assert one(spark, F.size(documents.chunks(F.lit("short"))))[0] == 1


def test_cleaning():
    clean = documents.cleaned_text
    assert clean("你好，世界。") == "你好,世界。" and clean("一段文字\n接着写") == "一段文字接着写" and clean("a broken\nline") == "a broken line"
    assert clean("# Title\ntext") == "## Title\ntext" and clean("```\n# x\n```") == "```\n# x\n```" and clean("Page 2 of 10\nwords") == "words"
    assert clean("see https://a.b/ｃ ＡＢ") == "see https://a.b/ｃ AB"


def sequential(pairs):
    """The rule row by row."""
    links, canonical = {}, {}
    for i, e, score in pairs:
        links.setdefault(i, []).append((-score, e))
        links.setdefault(e, [])
    for i in sorted(links):
        canonical[i] = next((e for _, e in sorted(links[i]) if canonical[e] == e), i)
    return canonical


def test_greedy_canonical(spark):
    schema = "id long, earlier_id long, score double"
    pairs = [(2, 1, 0.97), (3, 2, 0.99), (4, 3, 0.96), (4, 1, 0.95)]
    assert dict(rows(documents.greedy_canonical(spark.createDataFrame(pairs, schema)), "id", "canonical_id")) == {1: 1, 2: 1, 3: 3, 4: 3} == sequential(pairs)
    rng = random.Random(5)
    one = list({(a, b): (a, b, rng.choice([0.95, 0.96, 0.99])) for a, b in (sorted(rng.sample(range(600), 2), reverse=True) for _ in range(1500))}.values())  # one cluster
    one += [(900 + k, 900 + k // 2, 0.95) for k in range(1, 60)]  # a tree of links
    df = spark.createDataFrame(one + one[:50], schema)
    for most in (100_000, 150):  # in one task, and in rounds with a remainder smaller than the cluster
        assert dict(rows(documents.greedy_canonical(df, most), "id", "canonical_id")) == sequential(one)
    assert documents.greedy_canonical(spark.createDataFrame([], schema)).count() == 0


def test_rate_limit():
    assert stateful.accept([0, 1, 2, 3, 61, 62], [], 2, 60)[0] == [True, True, False, False, True, True]


def test_streams(spark, tmp_path):
    schema = "key long, event_id long, ts timestamp"
    day = "2024-01-01 00:00:"
    spark.createDataFrame([(1, i, None) for i in range(6)], "key long, event_id long, x string").select("key", "event_id", F.to_timestamp(F.concat(F.lit(day), F.lpad((F.col("event_id") * 10).cast("string"), 2, "0"))).alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = stateful.rate_limited_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 2, 25.0)
    run = stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(120)
    batch = stateful.rate_limited(spark.read.parquet(f"{tmp_path}/in"), 2, 25.0)
    assert rows(spark.table("limited"), "event_id", "accepted") == rows(batch, "event_id", "accepted")
    once = stateful.idempotent_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ["key"])
    run = once.writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/d").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("once").count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo".encode())
    (tmp_path / "b.csv").write_bytes("你好".encode("gb18030"))
    (tmp_path / "c.bin").write_bytes(b"%PDF-1.4")
    found = files.binary_files(spark, str(tmp_path)).select(F.substring_index("path", "/", -1).alias("n"), files.detected_format(F.col("content"), F.col("path")).alias("f"), files.decoded(F.col("content")).alias("t"))
    assert rows(found, "n", "f", "t") == [("a.txt", "text", "héllo"), ("b.csv", "csv", "你好"), ("c.bin", "pdf", "%PDF-1.4")]
    table = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["c", "d"])], "k int, n int, cells array<string>")
    assert files.markdown_table(table, "k", "n", "cells").first()["markdown"] == "| a | b |\n| --- | --- |\n| c | d |"
    base = spark.createDataFrame([(1, "x", 2), (2, "y", 3)], "k int, v string, w int")
    patch = spark.createDataFrame([(2, None, 9), (3, "z", 1)], "k int, v string, w int")
    assert rows(tables.upserted(base, patch, ["k"]), "k", "v", "w") == [(1, "x", 2), (2, "y", 9), (3, "z", 1)]
    titles = spark.createDataFrame([("t",), ("t > a",), ("tt",), (None,)], "title string")
    assert tables.without_document(titles, "t").count() == 2
    blocks = spark.createDataFrame([(1, 0.0, 40.0, 9.0, "left"), (1, 60.0, 99.0, 5.0, "right"), (1, 0.0, 99.0, 1.0, "head")], "page int, x0 double, x1 double, y0 double, text string").withColumn("middle", F.lit(50.0))
    assert files.reading_order(blocks).first()["text"] == "head\nleft\nright"
    moves = spark.createDataFrame([("s", 1, "INIT"), ("s", 2, "ASKING"), ("s", 3, "INIT")], "k string, n int, state string")
    assert rows(interview.illegal_moves(moves, "k", "n", "state"), "n", "previous") == [(3, "ASKING")]


def test_radar_clamps_before_weighing(spark):
    from tidewell.functions.scores import radar

    df = spark.createDataFrame([(1, 250, 80, None), (2, -40, 50, 60), (3, None, None, None), (4, 50, 51, 52)], "id int, r int, i int, d int")
    got = {r["id"]: r for r in df.select("id", *[c.alias(n) for n, c in radar(F.col("r"), F.col("i"), F.col("d")).items()]).collect()}
    assert (got[1]["resume"], got[1]["potential"], got[1]["skills"]) == (100, 86, 86)  # (25 * 100 + 55 * 80) / 80 = 86.25
    assert (got[2]["potential"], got[2]["skills"]) == (40, 35)  # 39.5 is rounded up
    assert (got[3]["potential"], got[3]["skills"], got[3]["demeanor"]) == (0, 0, 0) and got[4]["potential"] == 51


def test_merged_paragraphs():
    from tidewell.operators.documents import cleaned_text, merged_lines

    assert merged_lines(["well-", "known", "words."]) == ["well-known words."]
    assert merged_lines(["Java 是一种面向对象", "编程语言，它支持", "x", "", "垃圾回收机制。"]) == ["Java 是一种面向对象编程语言，它支持x", "垃圾回收机制。"]
    assert merged_lines(["It ends.", "It goes on"]) == ["It ends. It goes on"]
    assert merged_lines(["- one", "- two", "plain", "text", "> quoted", "more"]) == ["- one", "- two", "plain text", "> quoted", "more"]
    assert cleaned_text("# Big title\ncontent") == "## Big title\ncontent"
    assert cleaned_text("```\na  b\n```\none\npage 3 of 9\n……\n\nkept") == "```\na  b\n```\none\nkept"


def test_boilerplate_kinds(spark):
    from tidewell.functions.text import strip_boilerplate

    lines = ["body", "版权归某公司所有", "本文档为内部资料", "公司名称：某某", "部门logo", "Copyright 2020", "第 3 页", "body 2"]
    df = spark.createDataFrame([("\n".join(lines),)], "t string")
    assert df.select(strip_boilerplate(F.col("t"))).first()[0] == "body\nbody 2"


def test_proper_names(spark):
    df = spark.createDataFrame([("Elisabeth überDieschie Ärztehaus mayor Hamburger2 Dresdener",)], "t string")
    from tidewell.functions.text import proper_names

    assert df.select(proper_names(F.col("t"))).first()[0] == ["Elisabeth", "Ärztehaus", "Dresdener"]


@pytest.mark.parametrize("above", [True, False])
@pytest.mark.parametrize("inclusive", [True, False])
def test_threshold_scan_equals_rows(spark, above, inclusive):
    import operator

    from tidewell.operators.metrics import threshold_scan

    rows_ = [(s / 10, s % 3 == 0) for s in range(11)] + [(None, True), (None, False)]
    got = {r["t"]: (r["tp"], r["fp"], r["fn"]) for r in threshold_scan(spark.createDataFrame(rows_, "score double, positive boolean"), [0.5, 0.2, 0.9], above, inclusive).collect()}
    passes = {(True, True): operator.ge, (True, False): operator.gt, (False, True): operator.le, (False, False): operator.lt}[above, inclusive]
    for t in (0.5, 0.2, 0.9):
        hit = [s is not None and passes(s, t) for s, _ in rows_]
        assert got[t] == (sum(h and p for h, (_, p) in zip(hit, rows_)), sum(h and not p for h, (_, p) in zip(hit, rows_)), sum(not h and p for h, (_, p) in zip(hit, rows_)))


def test_similar_pairs_by_tiles(spark):
    import numpy as np

    from tidewell.operators.retrieval import similar_pairs

    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    got = {(r["id"], r["other_id"]) for r in similar_pairs(df, 0.7, tile=16).collect()}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if x[i] @ x[j] >= 0.7} and got


def test_greedy_matches_take_the_best_score(spark):
    pairs = spark.createDataFrame([(1, 1, 1, 0.5), (1, 1, 2, 0.9), (1, 2, 2, 0.8), (1, 2, 1, 0.1)], "sample long, expected long, got long, score double")
    assert sorted(rows(metrics.greedy_matches(pairs), "expected", "got")) == [(1, 2), (2, 1)]


def timed(spark, events):
    df = spark.createDataFrame([(k, i, float(t), *rest) for k, i, t, *rest in events], "key long, event_id long, t double" + (", failed boolean" if len(events[0]) > 3 else ""))
    return df.withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")))


def test_token_bucket_fills_again(spark):
    calls = timed(spark, [(1, i, t) for i, t in enumerate([0, 0, 0, 0.5, 1.0, 1.2, 9, 9, 9])] + [(2, 100, 0), (None, 200, 1), (None, 201, 1)])
    got = {r["event_id"]: r["accepted"] for r in stateful.token_bucket(calls, capacity=2, per_second=1).collect()}
    assert [got[i] for i in range(9)] == [True, True, False, False, True, False, True, True, False] and got[100] and got[200] and got[201]


def test_breaker_opens_half_opens_and_closes(spark):
    fails = [True, True, False, False, False, False, True, False, False, False]
    times = [0, 1, 2, 3, 12, 13, 14, 30, 31, 32]
    calls = timed(spark, [(1, i, t, f) for i, (t, f) in enumerate(zip(times, fails))])
    got = {r["event_id"]: (r["state"], r["allowed"]) for r in stateful.circuit_breaker(calls, window=2, rate=50, wait=10, probes=2).collect()}
    assert got[0] == got[1] == ("closed", True) and got[2] == got[3] == ("open", False)
    assert got[4] == got[5] == ("half_open", True) and got[6] == got[7] == ("closed", True) and got[8] == ("open", False)


def test_folds_do_not_depend_on_batches(spark):
    calls = timed(spark, [(i % 3, i, (i * 7919 % 1000) / 10) for i in range(300)])
    keep = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    e = calls.withColumn("priority", (F.col("event_id") % 4).cast("int"))
    whole = sorted(map(tuple, stateful.debounced(e, 0.3, 1.0).collect())), sorted(map(tuple, stateful.rate_limited(calls, 3, 5.0).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert whole == (sorted(map(tuple, stateful.debounced(e, 0.3, 1.0).collect())), sorted(map(tuple, stateful.rate_limited(calls, 3, 5.0).collect())))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", keep)
    assert sum(r[2] for r in whole[0]) == 300


def test_frequent_words_are_counted_where_they_stand(spark):
    rows = [(1, ["b", "a", "a", "c", "b"]), (2, []), (3, None), (4, ["x"]), (5, ["a", "b", "c"])]
    want = [(1, "a", 2, 2), (1, "b", 2, 1), (4, "x", 1, 1), (5, "a", 1, 1), (5, "b", 1, 2)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, words array<string>").where(F.size("words") > 0)
    once = documents.frequent_words(frame(rows), 2)
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, once.collect())) == want
    again = documents.frequent_words(frame([*rows, (4, ["y", "y"])]), 2)  # an id of two rows is one text
    assert sorted(map(tuple, again.collect())) == [*want[:2], (4, "x", 1, 2), (4, "y", 2, 1), *want[3:]]


def test_chunks_are_made_a_few_texts_at_a_time(monkeypatch):
    monkeypatch.setattr(documents, "TEXTS", 3)
    texts = [None, "", "short"] + [f"## h\n{'word and word. ' * n}" for n in range(0, 800, 90)]
    sizes = []
    made = documents.pa.array
    monkeypatch.setattr(documents.pa, "array", lambda rows, *a: (sizes.append(len(rows)), made(rows, *a))[1])
    (out,) = documents._chunks(iter([made(texts)]))
    assert max(sizes) <= 3 and out.to_pylist() == [documents.chunked_text(t) for t in texts]
