"""Quality rules: distribution divergence from language references, in DataFrame functions alone.

Per document: a histogram of character classes and one of the common words of its language. Per language: references, the medians of
the histograms of its documents that pass the base rules and are long enough. A document is rejected if the Jensen-Shannon distance of
either histogram from its language's reference exceeds the limit. Documents with fewer than `min_words` words are not judged by the
method, as short histograms are noise.

Nulls: a null text is empty, and fails the base rules for its few words; a null language is a language of its own. A language without
a list of common words takes the first words of all lists; one without a document fit for reference rejects none. Very long texts are judged
whole, within one row. Ties: a distance equal to its limit passes; of two middle values the lower is the median. Repeated rows each
give a row, an empty table none. Columns besides doc_id, text and lang play no part; `kept_documents` keeps them, but refuses names that begin with `__`. On large
input the medians come from merged summaries, exact to a thousandth of the ranks, so they may differ slightly with the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, unreserved, written

#: Common words of four languages.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "with", "as", "be", "this"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "una"],
}
OTHER_WORDS = sorted({w for words in COMMON_WORDS.values() for w in words[:4]})
#: Character classes that are taken out of a text one after another; what is left is the last class.
CLASSES = [r"\p{Ll}+", r"[\x20\x09-\x0D]+", r"\p{Lu}+", r"\p{Nd}+", r"[.,;:'\"()?-]+", r"\p{L}+"]
SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: Bytes of a row in a broadcast table: of the references of a language, of a key.
REFERENCE_BYTES, KEY_BYTES = 2048, 64

MIN_WORDS = 30
#: Distances beyond limit + slack / sqrt(n_words) reject: short histograms are noisier.
CLASS_LIMIT, CLASS_SLACK = 0.15, 0.55
WORD_LIMIT, WORD_SLACK = 0.32, 0.6


def bound(value: Column, use) -> Column:
    """`use` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column) -> Column:
    """Words within windows of WINDOW words found twice or more in the array: windows are hashed, sorted with their places, and those
    equal to a neighbour cover their words."""

    def covered(places: Column) -> Column:
        ends = F.transform(places, lambda p, i: F.least(F.lit(WINDOW).cast("long"), F.coalesce(F.get(places, (i + 1).cast("int")) - p, F.lit(WINDOW).cast("long"))))
        return F.aggregate(ends, F.lit(0).cast("long"), lambda a, x: a + x)

    def twice(s: Column) -> Column:
        near = lambda x, i: (F.get(s, (i - 1).cast("int"))["h"] == x["h"]) | (F.get(s, (i + 1).cast("int"))["h"] == x["h"])
        return F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(near(x, i), F.lit(False))), lambda x: x["p"]))

    def counted(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(bound(bound(ordered, twice), covered))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(F.size(words) >= WINDOW, bound(windows, counted)).otherwise(F.lit(0).cast("long"))


def base_columns(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text, words and the base rules' counts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text.alias("text"), digest.alias("digest"))
    df = df.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return df.select(
        "doc_id", "lang", "text", "digest",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        bound(F.col("words"), repeated_words).alias("n_repeat_words"),
    )


def class_counts(text: Column) -> Column:
    """Characters of each class, by taking out one class after another."""

    def taken(rest: Column, classes: list[str]) -> Column:
        if not classes:
            return F.array(F.length(rest).cast("double"))
        return bound(F.regexp_replace(rest, classes[0], ""), lambda less: F.concat(F.array((F.length(rest) - F.length(less)).cast("double")), taken(less, classes[1:])))

    return taken(text, CLASSES)


def word_counts(text: Column, lang: Column) -> Column:
    """Counts of the language's common words, then of all other words; words are runs of letters in lower case.

    Each word stands between spaces of its own, so that counting is a replacement of bytes."""
    spaced = F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), r"\P{L}+", "  ")
    times = lambda s, w: (F.octet_length(s) - F.octet_length(F.replace(s, w, F.lit("")))) / F.octet_length(w)
    lists = F.lit(None).cast("array<string>")
    for code, words in COMMON_WORDS.items():
        lists = F.when(lang == code, F.array(*[F.lit(f" {w} ") for w in words])).otherwise(lists)
    lists = F.coalesce(lists, F.array(*[F.lit(f" {w} ") for w in OTHER_WORDS]))

    def counted(s: Column) -> Column:
        words = times(s, F.lit("  ")) - 1
        return bound(F.transform(lists, lambda w: times(s, w)), lambda c: F.concat(c, F.array(words - total(c))))

    return bound(spaced, counted)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def shares(counts: Column) -> Column:
    return bound(counts, lambda c: bound(total(c), lambda n: F.transform(c, lambda v: F.when(n > 0, v / n).otherwise(F.lit(0.0)))))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits, 0 to 1."""
    half = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(F.greatest(F.lit(0.0), 0.5 * half(p, q) + 0.5 * half(q, p)))


def middle(column: str, n: int) -> Column:
    """The median of each place of an array, by mergeable sketches; strange documents hardly move it."""
    return F.array(*[F.percentile_approx(F.get(F.col(column), F.lit(i)), 0.5, 1000) for i in range(n)])


def judged(docs: DataFrame, min_words: int = MIN_WORDS, class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """doc_id, lang, base counts, base_failed, both distances (null where there is no reference) and kept."""
    df = base_columns(docs)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    df = df.select(*[c for c in df.columns if c != "text"], failed.alias("base_failed"), shares(class_counts(F.col("text"))).alias("classes"), shares(word_counts(F.col("text"), F.col("lang"))).alias("common"))
    df = written(df, "divergence")  # the texts are read once; what follows reads the histograms
    fit = df.where(~F.col("base_failed") & (F.col("n_words") >= min_words))
    size = max(len(w) for w in [*COMMON_WORDS.values(), OTHER_WORDS]) + 1
    references = fit.groupBy("lang").agg(shares(middle("classes", len(CLASSES) + 1)).alias("class_reference"), shares(F.filter(middle("common", size), lambda v: v.isNotNull())).alias("word_reference"))
    references = written(references, "references")
    df = df.join(small_side(references, references.count() * REFERENCE_BYTES), "lang", "left")
    df = df.withColumn("class_distance", js_distance(F.col("classes"), F.col("class_reference"))).withColumn("word_distance", js_distance(F.col("common"), F.col("word_reference")))
    noise = 1 / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    strange = (F.col("n_words") >= min_words) & ((F.col("class_distance") > class_limit + CLASS_SLACK * noise) | (F.col("word_distance") > word_limit + WORD_SLACK * noise))
    return df.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(strange, F.lit(False))).drop("classes", "common", "class_reference", "word_reference")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their columns. Rejected rows' keys are broadcast up to a size, joined by a shuffle beyond."""
    docs = unreserved(docs)
    gone = written(judged(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__i"), F.col("digest").alias("__d")).distinct(), "gone")
    digest = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    return docs.join(small_side(gone, gone.count() * KEY_BYTES), (digest == F.col("__d")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__i")), "left_anti")
