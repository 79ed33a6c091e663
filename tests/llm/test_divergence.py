import re

from tidewell.llm import divergence as dv

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            covered |= set(range(i, i + 5))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_base_counts(spark, odd_documents, documents):
    extra = spark.createDataFrame([(900, "a b c d e f g a b c d e x\nx y\nx y\n\n", "en"), (901, "a a a a a a a a", "en"), (902, "\n\n a|b #c\t*", "de")], "doc_id long, text string, lang string")
    docs = documents.select("doc_id", "text", "lang").limit(50).union(extra).union(odd_documents.where("doc_id <> 6 OR doc_id IS NULL").select("doc_id", "text", "lang"))
    want = sorted((r["doc_id"] or -1, *brute(r["text"])) for r in docs.collect())
    got = dv.judged(docs)
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted((r["doc_id"] or -1, *[r[c] for c in cols]) for r in got.collect()) == want
    assert got.where("kept AND base_failed").count() == 0


def test_verdicts(spark, documents, no_documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = {r["quality"]: r for r in dv.judged(docs).join(labels, "doc_id").where("n_words >= 10").groupBy("quality").agg({"kept": "count"}).collect()}
    kept = {r["quality"]: r["count"] for r in dv.judged(docs).join(labels, "doc_id").where("kept AND n_words >= 10").groupBy("quality").count().collect()}
    assert kept[1] > 0.97 * told[1]["count(kept)"] and kept.get(0, 0) < 0.3 * told[0]["count(kept)"]
    assert dv.judged(no_documents).count() == 0 and dv.kept_documents(no_documents).columns == no_documents.columns
    plan = dv.judged(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_js_distance(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(dv.js_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("a"), dv.js_distance(F.array(F.lit(0.3), F.lit(0.7)), F.array(F.lit(0.3), F.lit(0.7))).alias("b")).first()
    assert abs(row["a"] - 1) < 1e-9 and row["b"] < 1e-6


def brute_histograms(text, lang):
    """Counts of character classes and of common words, in plain Python."""
    import regex

    text = text or ""
    rest, classes = text, []
    for pattern in dv.CLASSES:
        less = regex.sub(pattern, "", rest)
        classes.append(len(rest) - len(less))
        rest = less
    words = regex.findall(r"\p{L}+", text.lower())
    common = dv.COMMON_WORDS.get(lang or "", dv.OTHER_WORDS)
    counts = [words.count(w) for w in common]
    return [*classes, len(rest)], [*counts, len(words) - sum(counts)]


def brute_distance(p, q):
    import math

    middle = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / m) for a, m in zip(x, middle) if a > 0)
    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def test_verdict_equals_brute_force(spark, documents):
    share = lambda c: [x / sum(c) if sum(c) else 0.0 for x in c]
    rows = {r["doc_id"]: r for r in documents.collect()}
    base = {i: brute(r["text"]) for i, r in rows.items()}
    histograms = {i: tuple(map(share, brute_histograms(r["text"], r["lang"]))) for i, r in rows.items()}
    references = {}
    for lang in {r["lang"] or "" for r in rows.values()}:
        fit = [i for i, r in rows.items() if (r["lang"] or "") == lang and not base[i][-1] and base[i][0] >= dv.MIN_WORDS]
        if fit:
            references[lang] = [share([sorted(histograms[i][k][j] for i in fit)[-(-len(fit) // 2) - 1] for j in range(len(histograms[fit[0]][k]))]) for k in (0, 1)]
    told = 0
    for r in dv.judged(documents).collect():
        i, n = r["doc_id"], base[r["doc_id"]][0]
        if (reference := references.get(rows[i]["lang"] or "")) is None:
            assert r["kept"] == (not base[i][-1])
            continue
        a, b = (brute_distance(histograms[i][k], reference[k]) for k in (0, 1))
        assert abs(r["class_distance"] - a) < 1e-6 and abs(r["word_distance"] - b) < 1e-6
        strange = n >= dv.MIN_WORDS and (a > dv.CLASS_LIMIT + dv.CLASS_SLACK / max(n, 1) ** 0.5 or b > dv.WORD_LIMIT + dv.WORD_SLACK / max(n, 1) ** 0.5)
        assert r["kept"] == (not base[i][-1] and not strange)
        told += strange
    assert told > 0
