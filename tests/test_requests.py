"""Literal cases of search, memory, reports, claims, text functions and office files."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.operators import agents, claims, crawl, interview, memory, metrics, search
from tidewell.sources import files


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def words(*w):
    return F.array(*[F.lit(x) for x in w]).cast("array<string>")


def test_search_modes_and_sizes(spark):
    hits = spark.createDataFrame([("q", 1, 0.9), ("q", 2, 0.5)], "qid string, id long, score double")
    none = hits.where("false")
    assert [search.request_size(k) for k in (-3, 0, 7, 99)] == [1, 1, 7, 50]
    with pytest.raises(ValueError):
        search.searched({"fts": lambda k: hits}, 5, "other")
    with pytest.raises(ValueError):
        search.searched({}, 5)
    assert rows(search.searched({"fts": lambda k: hits}, 1, "fts_only"), "id", "rank") == [(1, 1)]
    assert rows(search.searched({"fts": lambda k: hits, "vector": lambda k: none}, 5), "id") == [(1,), (2,)]
    assert search.searched({"fts": lambda k: none}, 5).count() == 0
    assert rows(search.searched({"fts": lambda k: hits, "vector": lambda k: none}, 5, round_number=1), "id", "score") == [(1, 0.3), (2, 0.0)]


def test_rounds_and_order(spark):
    hits = lambda *r: spark.createDataFrame([("q", *x) for x in r], "qid string, id long, score double")
    first, second, third = hits((1, 0.7), (2, 0.1)), hits((1, 0.9), (3, 0.8), (4, 0.8)), hits((5, 0.9))
    assert rows(search.rounds_joined([first, second, third]), "id", "score", "round") == [(1, 0.9, 1), (3, 0.8, 1), (4, 0.8, 1)]
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "qid string, id long, rank int")
    b = spark.createDataFrame([("q", 2, 1), ("q", 9, 2), ("q", 8, 3)], "qid string, id long, rank int")
    assert rows(search.first_then_second(a, b, 3), "rank", "id") == [(1, 1), (2, 2), (3, 9)]
    assert one(spark, search.boosted(F.lit(0.5)), search.boosted(F.lit(0.9))) == (pytest.approx(0.6), 1.0)
    unit = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, search.faithful(unit(1, 0), unit(0.8, 0.6)), search.faithful(unit(1, 0), unit(0, 1)), search.faithful(unit(1, 0), F.lit(None).cast("array<double>"))) == (True, False, True)
    assert rows(search.near_roots(hits((1, 0.9), (2, 0.8), (3, 0.59), (4, 0.7)), 3), "id") == [(1,), (2,), (4,)]
    texts = spark.createDataFrame([(1, "x" * 600)], "id long, text string")
    assert search.contents_of(first, texts).where("id = 1").first()["content"] == "x" * 500
    assert one(spark, search.starts_with_any(F.lit("HTTP://A.b"), ["http://a"]), search.starts_with_any(F.lit("x"), [])) == (True, False)


def test_paths_and_failures(spark):
    path = lambda tools, turns, said: one(spark, agents.path_of(words(*tools), F.lit(turns), F.lit(said)))[0]
    assert [path(["re_search", "recall_memory"], 1, ""), path(["recall_memory"], 2, ""), path(["a"], 2, ""), path([], 1, "今天天气"), path([], 1, "hi"), path(["a"], 1, "")] == [
        "reselect", "memory", "knowledge_multi", "realtime", "casual", "knowledge_single"
    ]
    assert one(spark, agents.no_extra(words("a", "re_search"), words("a")), agents.no_extra(words("b"), words("a")), agents.covered(words(), words()), agents.required_given(words("x"), words("x", "y")), agents.required_given(F.lit(None), words())) == (True, False, True, True, True)
    yes, no = F.lit(True), F.lit(False)
    fail = lambda a, e, c, n: one(spark, agents.failure_of(a, e, c, F.lit(n), F.lit(1)))[0]
    assert [fail(no, no, no, 1), fail(yes, no, no, 1), fail(yes, yes, no, 1), fail(yes, yes, yes, 3), fail(F.lit(None).cast("boolean"), yes, yes, 2)] == list(agents.FAILURES)
    assert agents.scorecard(spark.createDataFrame([], "passed boolean, tool_correct boolean, no_extra boolean, args_ok boolean, grounding double, tool_count int, tokens long, duration_ms double")).first()["pass_rate"] == 0


def test_recall(spark):
    now = F.lit("2024-03-01").cast("timestamp")
    m = spark.createDataFrame([("q", "old", 0.9, "2023-06-01"), ("q", "new", 0.8, None), ("q", "low", 0.3, None), ("q", "mid", 0.6, None)], "qid string, content string, score double, recalled_at string")
    assert rows(memory.recalled(m.withColumn("recalled_at", F.col("recalled_at").cast("timestamp")), now), "rank", "content", "score") == [(1, "new", 0.8), (2, "mid", 0.6), (3, "old", 0.27)]
    s = spark.createDataFrame([("q", "a", 0.9, "fact", 0, "2024-02-27"), ("q", "gone", 0.9, "fact", 0, "2024-01-01"), ("q", "b", 0.9, "fact", 5, None)], "qid string, content string, score double, kind string, mentions int, created_at string")
    got = memory.recalled_short(s.withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("last_at", F.lit(None).cast("timestamp")), now)
    assert rows(got, "rank", "content", "score") == [(1, "b", 0.9), (2, "a", 0.45)]
    stored = spark.createDataFrame([(7, False), (8, True), (9, None)], "stored_id long, superseded boolean")
    hits = spark.createDataFrame([(1, 7, 0.9), (1, 8, 0.99), (1, 9, 0.9), (2, 9, 0.5)], "id long, stored_id long, score double")
    assert rows(memory.short_duplicates(hits, stored), "id", "stored_id") == [(1, 7)]
    items = spark.createDataFrame([(1, None, None), (2, 3, None)], "id long, mentions int, last_at timestamp")
    assert rows(memory.refreshed(items, spark.createDataFrame([(1,), (1,)], "id long"), now), "id", "mentions") == [(1, 1), (2, 3)]
    facts = spark.createDataFrame([(" likes tea ", "0.9", "Preference"), ("x", "bad", "fact"), ("", "1", "fact"), ("y", "0.6", "odd")], "content string, importance string, kind string")
    assert rows(memory.kept_facts(facts), "content", "importance", "kind") == [("likes tea", 0.9, "preference"), ("y", 0.6, "fact")]


def test_reports(spark):
    scores = {"resume": F.lit(70), "interview": F.lit(90), "demeanor": F.lit(90), "skills": F.lit(None).cast("int")}
    assert one(spark, interview.extreme_dimension(scores), interview.extreme_dimension(scores, False)) == ("interview", "skills")
    comment = lambda s, a, b: one(spark, interview.overall_comment(F.lit(s), F.lit(a), F.lit(b)))[0]
    assert comment(90, "x", "y").endswith("Current strength is x, and prioritize improving y.") and comment(65, "x", "x") == interview.COMMENTS[2][1] and comment(None, None, "y") == interview.COMMENTS[3][1]
    assert one(spark, interview.next_actions(words("a", "b", "a"), words("b", "c", "d")))[0] == ["a", "b", "c"]
    none = F.lit(None)
    told = lambda *c: one(spark, interview.follow_up_needed(*c))[0]
    assert [told(none.cast("boolean"), F.lit(True), words(), F.lit(" ")), told(none.cast("boolean"), none.cast("boolean"), words(), none.cast("string")), told(F.lit(False), F.lit(False), words("m"), F.lit("q")), told(none.cast("boolean"), F.lit(True), words("m"), F.lit(""))] == [False, True, False, True]
    turns = spark.createDataFrame([("a", 1, "1", None, False), ("a", 2, "2-F1", None, False), ("b", 1, "3", None, False), ("c", 1, "1", "1-F1", False), ("d", 1, "1", "2", True), ("f", 1, "x", None, None)], "session string, seq int, question string, next_question string, finished boolean")
    totals = spark.createDataFrame([(s, 3) for s in "abcdef"] + [("g", 0)], "session string, total int")
    assert rows(interview.flow_of_last_turn(turns, totals), "session", "state", "question") == [("a", "ASKING", "3"), ("b", "COMPLETED", None), ("c", "ASKING", "1-F1"), ("d", "COMPLETED", None), ("e", "ASKING", "1"), ("f", "ASKING", "1")]
    assert one(spark, *[interview.runtime_confidence(F.lit(t), F.lit(n), F.lit(f)) for t, n, f in ((True, 0, False), (False, 2, True), (None, 2, False), (False, 0, True))]) == ("TERMINAL", "EXACT", "DERIVED", "READ_ONLY")
    at = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, interview.duration_seconds(at("2024-01-01 00:00:00"), at("2024-01-01 00:01:01.9")), interview.duration_seconds(at("2024-01-02"), at("2024-01-01")), interview.duration_seconds(at(None), at("2024-01-01"))) == (61, 0, None)
    assert one(spark, interview.first_told(none.cast("string"), F.lit(" "), F.lit(" x "), F.lit("y"))) == ("x",)


def test_text_functions(spark):
    f = lambda c: one(spark, c)[0]
    s = F.lit
    assert [f(text.crawl_filename(s(u))) for u in ("https://a.b/c/d?x=1", "https://a.b/", "")] == ["crawl_d.txt", "crawl_a.b.txt", "crawl_page.txt"]
    assert f(text.candidate_entities(s("What is the Spark engine, and a Delta table? x y"))) == ["What", "Spark", "engine", "Delta", "table"]
    assert f(text.without_particles(s(" 为什么呀 "))) == "为什么"
    assert [f(text.facts_match(s(a), s(b))) for a, b in (("喜欢喝美式咖啡不加糖", "用户喜欢喝美式咖啡且不加糖"), ("用户喜欢咖啡", "用户偏好简洁"), ("Tea！", "likes 《tea》"), ("", "x"))] == [True, False, True, False]
    assert f(text.topic(s("  a \n b  "))) == "a b" and f(text.topic(s(None).cast("string"))) == "未知主题" and len(f(text.topic(s("x" * 50)))) == 30
    assert f(text.learning_note(s("t"), s("q"), s(3), s(None).cast("int"), s("fb"), s("s1"))) == "【待学笔记】t\n面试问题: q\n本题得分: 3/?\n面试反馈: fb\n来源会话: s1"
    assert f(text.search_address(s("a b&c"), "https://x.y/s?q={query}&z=1")) == "https://x.y/s?q=a%20b%26c&z=1"
    assert f(text.sanitised_context(s("\x01 a\r\nb\rc\n\n\n\nd\x0b "))) == "a\nb\nc\n\nd" and len(f(text.sanitised_context(s("y" * 3000)))) == 2000
    assert f(text.sentences_with(s("我喜欢茶。你呢？They left!rest"), words("茶", "rest", ""))) == ["我喜欢茶。", "rest"]
    assert f(text.turn_digest(s("1"), s("x" * 1000 + "tail"))) == f(text.turn_digest(s("1"), s("x" * 1000)))
    assert [f(text.image_of_value(s(a), s(o), s(None).cast("double"))) for a, o in ((0.05, 0.0), (0.01, 0.2), (0.0, 0.3))] == [True, False, True]
    assert f(text.rewritten_with_context(s("and that?"), words("index"))) == "and that? index" and f(text.rewritten_with_context(s("hm"), words())) == "hm"


def test_claims_and_metrics(spark):
    judged = spark.createDataFrame([(1, "contradiction", "contradiction", 0.6), (1, "contradiction", "entailment", 0.9), (2, "entailment", "entailment", 0.95), (3, "neutral", "neutral", 0.9)], "id int, label string, verdict string, confidence double")
    scan = {r["threshold"]: r for r in claims.verdict_scan(judged, [0.5, 0.7]).collect()}
    assert scan[0.5]["accuracy_3class"] == 1 and scan[0.5]["pred_contradiction"] == 1 and scan[0.7]["pred_entailment"] == 2 and scan[0.7]["accuracy_binary"] == pytest.approx(0.6667)
    grid = spark.createDataFrame([(0.7, 0.3, 0.5, 0.5), (0.8, 0.3, 0.5, 0.5), (0.9, 0.1, 0.5, 0.6)], "high double, low double, kappa3 double, kappa2 double")
    assert [r["high"] for r in claims.best_agreement(grid).collect()] == [0.9, 0.7, 0.8]
    assert metrics.evaluated_and_skipped(spark.createDataFrame([(["a"],), ([],), (None,)], "golden array<string>")).first() == (1, 2)
    ab = spark.createDataFrame([("hit", "graph", 0.5), ("hit", "all", 0.75), ("mrr", "graph", 0.2)], "metric string, mode string, value double")
    assert rows(metrics.ablation(ab, "graph", "all"), "metric", "base", "full", "gain") == [("hit", 0.5, 0.75, 0.25), ("mrr", 0.2, None, None)]
    judges = spark.createDataFrame([("a", 1.0, 0.5), ("a", None, 0.7), ("b", None, None)], "k string, faithfulness double, relevancy double")
    assert rows(metrics.judge_means(judges, "k"), "k", "faithfulness", "relevancy", "n_judged") == [("a", 1.0, 0.6, 1), ("b", None, None, 0)]
    means = metrics.subset_means(spark.createDataFrame([(1, 1.0), (2, 0.0), (3, 0.5)], "id int, v double"), spark.createDataFrame([(1, True), (2, True)], "id int, enough boolean"), "id", "enough", "v")
    assert rows(means, "enough", "mean", "n") == [("true", 0.5, 2), ("unknown", 0.5, 1)]
    gate = spark.createDataFrame([(0.2, False), (0.9, True), (0.4, True)], "top_cosine double, sufficient boolean")
    assert rows(metrics.gate_scan(gate, [0.3, 0.5]), "t", "tp", "fp", "fn") == [(0.3, 1, 0, 0), (0.5, 1, 1, 0)]
    one_class = spark.createDataFrame([(True, True), (True, False)], "label boolean, prediction boolean")
    assert metrics.variant_metrics(one_class).first() == (0.5, 0.0, 0.0)
    src = spark.createDataFrame([(1, "Docs", "https://a", None), (2, "News", "https://b/docs", 5)], "id int, name string, url_pattern string, priority int")
    assert [r["id"] for r in crawl.prioritised(src, ["docs", "news"]).collect()] == [2, 1]


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", body)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_office_files(spark):
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    docx = zipped(word__document=f"<w:document {W}><w:body>{p('Title', 'Heading1')}{p('')}{p('Body')}<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl></w:body></w:document>")
    book = f'<workbook {M}><sheets><sheet name="One" sheetId="1"/></sheets></workbook>'
    sheet = f'<worksheet {M}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>z</t></is></c></row><row r="2"/><row r="3"><c r="B3"><v>4.5</v></c></row></sheetData></worksheet>'
    xlsx = zipped(xl__workbook=book, xl__worksheets__sheet1=sheet, xl__sharedStrings=f"<sst {M}><si><t>head</t></si></sst>")
    df = spark.createDataFrame([("f/a.docx", docx), ("f/b.xlsx", xlsx), ("f/c.txt", "héllo".encode()), ("f/d.docx", b"broken"), ("f/e.pdf", b"%PDF-1.4")], "path string, content binary")
    got = {r["path"]: (r["format"], r["text"]) for r in files.parsed_documents(df).collect()}
    assert got["f/a.docx"] == ("docx", "# Title\n\nBody\n\n| a | b |\n| --- | --- |\n| 1 | 2 |")
    assert got["f/b.xlsx"] == ("xlsx", "## One\n| head |  | z |\n| --- | --- | --- |\n|  | 4.5 |  |")
    assert got["f/c.txt"] == ("text", "héllo") and got["f/d.docx"] == ("docx", "") and got["f/e.pdf"] == ("pdf", None)
