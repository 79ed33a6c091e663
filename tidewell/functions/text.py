"""Text as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of page furniture (numbers of pages), boilerplate lines (page numbers, rights, disclaimers, internal notices, names and logos),
#: and characters that carry meaning.
PAGE_FURNITURE = r"(?i)^(?:第\s*\d+\s*页|page\s*\d+(?:\s*(?:of|/)\s*\d+)?|-{3,}\s*page\s*\d+(?:\s*(?:of|/)\s*\d+)?[\s-]*|页码[:：]\s*\d+|\d{1,4})\s*$"
BOILERPLATE = r"(?i)^(?:第\s*\d+\s*页|page\s*\d+(?:\s*(?:of|/)\s*\d+)?|(?:版权所有|版权归[^。；]*所有|Copyright|©|All rights reserved)[^。；]*|免责声明[^。；]*|本文档[^。；]*(?:内部|机密|仅供)[^。；]*|(?:公司|组织|部门)[^。；]*(?:名称|logo)[^。；]*)\s*[。；]?\s*$"
MEANINGFUL = r"[一-鿿A-Za-z0-9]"
TITLE_SEPARATOR = " > "


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


#: SQL of `proper_names`, for a column {0}.
PROPER_NAMES_SQL = r"list_filter(regexp_split_to_array({0}, '[^\p{{L}}\p{{N}}]+'), lambda x: regexp_matches(x, '^\p{{Lu}}\p{{Ll}}{{7,}}$'))"


def proper_names(text: Column) -> Column:
    """Capitalised words of eight letters or more, which stand for entities; word borders are all but letters and digits of any script."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda x: x.rlike(r"^\p{Lu}\p{Ll}{7,}$"))


def cjk_bigrams(text: Column) -> Column:
    """Pairs of neighbouring CJK characters, where no dictionary segments them."""
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"([一-鿿]+)"), F.lit(1)), lambda run: F.when(F.length(run) < 2, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2))))))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def cache_key(*parts: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def fingerprint(name: Column, args: Column) -> Column:
    """A hash of a name and its map of arguments, whatever their order."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(args)))
    return F.sha2(F.concat_ws("|", name, F.to_json(ordered)), 256)


def root_title(title: Column) -> Column:
    return F.substring_index(title, TITLE_SEPARATOR, 1)


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, r"[\p{C}&&[^\n\t]]", "")


def is_page_furniture(line: Column) -> Column:
    return F.trim(line).rlike(PAGE_FURNITURE)


def is_noise(text: Column) -> Column:
    """No letter, digit or CJK character; letters with accents alone do not count."""
    return ~F.coalesce(text, F.lit("")).rlike(MEANINGFUL)


def strip_boilerplate(text: Column) -> Column:
    """Without lines of page numbers, copyright and the like; blank lines squeezed."""
    kept = F.filter(F.split(text, "\n"), lambda line: ~((F.trim(line) != "") & F.trim(line).rlike(BOILERPLATE)))
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def normalise_headings(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^(\s*)#(?!#)(\s+\S.*)$", "$1##$2")


def squeeze_spaces(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")


def truncated_at_boundary(text: Column, most: int = 2000) -> Column:
    """Cut at the last paragraph end within `most` characters, else at the last line end, else there."""
    head = F.substring(text, 1, most)
    paragraph, line = (F.regexp_extract(head, rf"(?s)^(.*){end}", 1) for end in ("\n\n", "\n"))
    return F.when(F.length(text) <= most, text).when(paragraph != "", paragraph).when(line != "", line).otherwise(head)


def normalised_url(url: Column) -> Column:
    """Scheme and host in lower case, port and query kept, no user, fragment or slash at the end."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r"^.*@", ""))
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*(/[^?]*)?", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"(\?.*)$", 1)
    return F.concat(scheme, F.lit("://"), host, path, query)


def html_title(html: Column, most: int = 200) -> Column:
    return F.substring(F.trim(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)), 1, most)


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""href=["']([^"']+)"""), F.lit(1))


def resolved(link: Column, base: Column) -> Column:
    """An absolute http(s) address of a link of a page, null for other kinds. Dots in paths are kept."""
    origin = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    return (
        F.when(link.rlike(r"(?i)^https?://"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z]+:)", 1), link)).when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("#") | link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string")).otherwise(F.concat(folder, F.lit("/"), link))
    )


def image_references(text: Column) -> Column:
    """Targets of Markdown images, then of img elements, without repeats."""
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)\s]+)"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"""<img[^>]*src=["']([^"']+)"""), F.lit(1))))


def identity(name: Column) -> Column:
    """Blank names, and those with characters that patterns give a meaning to, are unknown."""
    clean = F.trim(name)
    return F.when(clean.isNull() | (clean == "") | clean.rlike(r"[%_\\]"), F.lit("unknown")).otherwise(clean)


def escaped_like(text: Column) -> Column:
    return F.regexp_replace(text, r"([%_\\])", r"\\$1")


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^0-9A-Za-z.\-_]", "_")


def split_claims(text: Column) -> Column:
    """Sentences of a claim; the whole where there is only one."""
    parts = F.filter(F.transform(F.split(text, r"[。！？；!?;]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) >= 2, parts).otherwise(F.array(F.trim(text)))


def feedback_sentences(text: Column, least: int = 6) -> Column:
    """Sentences of feedback of at least `least` characters, each with a full stop."""
    parts = F.filter(F.transform(F.split(text, r"[;.!?\r\n；。！？]"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)
    return F.transform(parts, lambda x: F.concat(x, F.lit(".")))


def suggestion_map(text: Column) -> Column:
    """Parts between semicolons by their number; blank parts use a number up."""
    parts = F.transform(F.split(text, ";"), lambda x, i: F.struct((i + 1).cast("string").alias("key"), F.trim(x).alias("value")))
    return F.map_from_entries(F.filter(parts, lambda x: x["value"] != ""))


def joined_by_number(m: Column) -> Column:
    """Values of a map ordered by their keys as numbers, other keys last."""
    entries = F.transform(F.map_entries(m), lambda e: F.struct(F.coalesce(e["key"].try_cast("int"), F.lit(2**31 - 1)).alias("n"), e["key"].alias("k"), e["value"].alias("v")))
    return F.array_join(F.transform(F.array_sort(entries), lambda e: e["v"]), "; ")


def question_number(raw: Column) -> tuple[Column, Column]:
    """(main number, follow-up number or 0) of `n` and `n-Fk`; null for others."""
    clean, pattern = F.upper(F.trim(raw)), r"^(\d+)(?:-F(\d+))?$"
    main = F.regexp_extract(clean, pattern, 1).try_cast("int")
    return main, F.when(main.isNotNull(), F.coalesce(F.regexp_extract(clean, pattern, 2).try_cast("int"), F.lit(0)))


def keyword_hits(text: Column, words: Sequence[str]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Size of the common set by the shorter list; null if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least)


def client_address(forwarded: Column) -> Column:
    return F.trim(F.substring_index(forwarded, ",", 1))


def numbered_lines(items: Column) -> Column:
    """`1. text` lines of the items that are not blank."""
    kept = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.transform(kept, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def turn_digest(question: Column, answer: Column, chars: int = 1000) -> Column:
    """A hash of a question's number and the beginning of its answer."""
    return F.sha2(F.concat_ws("|", F.coalesce(question, F.lit("")), F.substring(F.coalesce(answer, F.lit("")), 1, chars)), 256)


def crawl_filename(url: Column, chars: int = 50) -> Column:
    """The name of a crawled page: the last part of its path without the query, `page` where there is none."""
    base = F.regexp_replace(F.substring_index(url, "?", 1), "/+$", "")
    segment = F.substring_index(base, "/", -1)
    return F.concat(F.lit("crawl_"), F.substring(F.when(segment == "", "page").otherwise(segment), 1, chars), F.lit(".txt"))


#: Words that name nothing, marks between words, and particles of speech.
STOP_WORDS = (
    "的", "了", "是", "在", "和", "有", "不", "这", "我", "你", "他", "她", "它", "们", "那", "就", "都", "也", "还", "但", "而", "如果", "因为", "所以", "虽然", "或者", "什么", "怎么",
    "为什么", "如何", "哪些", "哪个", "可以", "可能", "需要", "应该", "进行", "通过", "使用", "一个", "一些", "这个", "那个", "一下", "一起", "已经", "不是", "非常", "比较", "the", "a", "an",
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might",
    "shall", "can", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "about", "that", "this", "these", "those", "it", "its",
    "not", "no", "nor", "or", "and", "but", "if", "then", "else", "when", "up", "out", "so", "than",
)
DELIMITERS = r"[\s，。、；：？！,.:;?!]+"
PARTICLES = ("哦", "呢", "呀", "啦", "请问", "那个", "嘛", "吧")


def candidate_entities(query: Column, most: int = 5) -> Column:
    """The first words of a query of two characters or more that are no stop words."""
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.slice(F.filter(F.split(query, DELIMITERS), lambda w: (F.length(w) > 1) & ~F.array_contains(stops, F.lower(w))), 1, most)


def without_particles(query: Column) -> Column:
    out = F.trim(query)
    for p in PARTICLES:
        out = F.replace(out, F.lit(p), F.lit(""))
    return F.trim(out)


def bare_fact(text: Column) -> Column:
    """A fact in lower case without spaces and common punctuation."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s，。！？、；：\"''（）()【】《》~～]+", ""))


def facts_match(predicted: Column, golden: Column, least: float = 0.6) -> Column:
    """Whether one bare fact holds the other, or their characters overlap: common distinct characters over the longer length."""
    a, b = bare_fact(predicted), bare_fact(golden)
    common = F.size(F.array_intersect(F.split(a, ""), F.split(b, "")))
    share = common / F.greatest(F.length(a), F.length(b), F.lit(1))
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a) | (share >= least))


#: The topic of an empty question, and the labels of a learning note.
NO_TOPIC = "未知主题"
NOTE_LABELS = ("【待学笔记】", "面试问题: ", "本题得分: ", "面试反馈: ", "来源会话: ")


def topic(question: Column, chars: int = 30, missing: str = NO_TOPIC) -> Column:
    """The beginning of a question, its white space squeezed."""
    squeezed = F.regexp_replace(F.trim(F.coalesce(question, F.lit(""))), r"\s+", " ")
    return F.when(squeezed == "", missing).otherwise(F.substring(squeezed, 1, chars))


def learning_note(topic_: Column, question: Column, score: Column, total: Column, feedback: Column, session: Column) -> Column:
    """A note on a weak answer; unknown parts are empty, an unknown total is a question mark."""
    text = lambda c, missing="": F.coalesce(c.cast("string"), F.lit(missing))
    values = (text(topic_), text(question), F.concat(text(score), F.lit("/"), text(total, "?")), text(feedback), text(session))
    lines = [F.concat(F.lit(label), value) for label, value in zip(NOTE_LABELS, values)]
    return F.concat_ws("\n", *lines)


def search_address(topic_: Column, template: str) -> Column:
    """A search address: {query} of the template is the topic, encoded, a space as %20."""
    before, after = template.split("{query}")
    return F.concat(F.lit(before), F.replace(F.url_encode(topic_), F.lit("+"), F.lit("%20")), F.lit(after))


def sanitised_context(text: Column, chars: int = 2000) -> Column:
    """Line ends as line feeds, no control characters but tab and line feed, blank lines squeezed, cut."""
    out = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\r", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), r"\n{3,}", "\n\n")
    return F.substring(F.regexp_replace(out, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), 1, chars)


def sentences_with(text: Column, keywords: Column) -> Column:
    """Sentences, each with its closing mark, that hold a keyword of an array."""
    sentences = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[。！？!?])"), lambda s: F.trim(s)), lambda s: s != "")
    words = F.filter(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.coalesce(k, F.lit("")) != "")
    return F.filter(sentences, lambda s: F.exists(words, lambda k: F.contains(s, k)))


def image_of_value(area: Column, ocr: Column, judged: Column, least_area: float = 0.05, least_ocr: float = 0.3, least_judged: float = 0.3) -> Column:
    """Whether an image covers enough of its page, or its text or content scores enough; unknown scores are 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return (zero(area) >= least_area) | (zero(ocr) >= least_ocr) | (zero(judged) >= least_judged)


def rewritten_with_context(follow_up: Column, terms: Column) -> Column:
    """A follow-up question with the first known term of the question before, if any."""
    return F.when(F.size(F.coalesce(terms, F.array().cast("array<string>"))) > 0, F.concat_ws(" ", follow_up, F.get(terms, 0))).otherwise(follow_up)
