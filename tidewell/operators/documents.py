"""Documents: cleaning, chunking, listings, duplicates."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MEANINGFUL, PAGE_FURNITURE
from ..session import written

#: Sizes of chunks in characters, and the places to cut at, best first.
LEAST, PARENT, CHILD, OVERLAP = 50, 4000, 300, 50
CUTS = ("\n\n", "\n", "。", ".", " ", "")
CHUNKS = "array<struct<parent: int, title: string, content: string, children: array<string>>>"


def pieces(text: str, size: int, overlap: int, cuts: tuple[str, ...] = CUTS) -> list[str]:
    """Parts of at most `size` characters, cut at the best places, neighbours sharing up to `overlap` characters."""
    if len(text) <= size:
        return [text] if text.strip() else []
    cut = next(c for c in cuts if c == "" or c in text)
    rest = cuts[cuts.index(cut) + 1 :]
    units = list(text) if cut == "" else [u + cut for u in text.split(cut)[:-1]] + [text.split(cut)[-1]]
    out: list[str] = []
    held: list[str] = []
    length = 0
    for unit in units:
        if len(unit) > size:
            if held:
                out.append("".join(held))
            held, length = [], 0
            out += pieces(unit, size, overlap, rest)
            continue
        if length + len(unit) > size:
            out.append("".join(held))
            while held and (length > overlap or length + len(unit) > size):
                length -= len(held.pop(0))
        held.append(unit)
        length += len(unit)
    if held:
        out.append("".join(held))
    return [p.strip() for p in out if p.strip()]


def sections(text: str) -> list[tuple[str, str]]:
    """(title path, content) of the parts under headings of level two and three; code fences are not looked into."""
    found, two, three, held, fenced = [], "", "", [], False

    def close() -> None:
        body = "\n".join(held).strip()
        if body:
            found.append((" > ".join(t for t in (two, three) if t), body))
        held.clear()

    for line in text.split("\n"):
        if re.match(r"\s{0,3}(```|~~~)", line):
            fenced = not fenced
        heading = None if fenced else re.match(r"(##|###)\s+(\S.*)$", line.strip())
        if heading is None:
            held.append(line)
            continue
        close()
        if heading[1] == "##":
            two, three = heading[2].strip(), ""
        else:
            three = heading[2].strip()
    close()
    return found


def chunked_text(text: str | None) -> list[dict]:
    if not text or not text.strip():
        return []
    parents = [(t, c) for t, c in sections(text) if len(c) >= LEAST]
    if not parents:
        whole = text.strip()
        if len(whole) < LEAST:
            return []
        parents = [("", whole)]
    split = [(t, p) for t, c in parents for p in ([c] if len(c) <= PARENT else [x for x in pieces(c, PARENT, 0) if len(x) >= LEAST])]
    return [{"parent": i, "title": t, "content": c, "children": pieces(c, CHILD, OVERLAP)} for i, (t, c) in enumerate(split)]


#: Texts that are chunked at a time.
TEXTS = 64
CHUNKS_ARROW = pa.list_(pa.struct([("parent", pa.int32()), ("title", pa.string()), ("content", pa.string()), ("children", pa.list_(pa.string()))]))


def _chunks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        parts = [pa.array([chunked_text(t) for t in batch.slice(at, TEXTS).to_pylist()], CHUNKS_ARROW) for at in range(0, len(batch), TEXTS)]
        yield pa.concat_arrays([pa.array([], CHUNKS_ARROW), *parts])


def chunks(text: Column) -> Column:
    """Parents (by headings, capped) with their children; one parent and child of the whole where nothing can be cut."""
    cut = F.arrow_udf(_chunks, CHUNKS)(text)
    whole = F.array(F.struct(F.lit(0).alias("parent"), F.lit("").alias("title"), text.alias("content"), F.array(text).alias("children")))
    return F.when(F.size(cut) > 0, cut).otherwise(whole.cast(CHUNKS))


def chunk_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, parent, title, parent_chars, child (number), content of each child."""
    parents = docs.select(id_column, F.explode(chunks(F.col(text_column))).alias("p"))
    return parents.select(id_column, F.col("p.parent").alias("parent"), F.col("p.title").alias("title"), F.length("p.content").alias("parent_chars"), F.posexplode("p.children").alias("child", "content"))


def frequent_words(texts: DataFrame, k: int) -> DataFrame:
    """id, word, n, rank of the k most frequent words of each id of texts (id, words), ties to the first seen. A task counts a text's words, so none are shuffled;
    only where an id stands more than once, which is asked first by ids alone, words meet by id."""
    if texts.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").limit(1).count():
        seen = texts.select("id", F.posexplode("words").alias("pos", "word")).groupBy("id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
        w = Window.partitionBy("id").orderBy(F.desc("n"), "first_pos")
        return seen.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "word", "n", "rank")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1).flatten().dictionary_encode()
            row, code = pc.list_parent_indices(batch.column(1)).to_numpy().astype(np.int64), words.indices.to_numpy()
            pairs, first, n = np.unique(row * max(1, len(words.dictionary)) + code, return_index=True, return_counts=True)
            row, code = np.divmod(pairs, max(1, len(words.dictionary)))
            order = np.lexsort((first, -n, row))
            rank = np.arange(len(row)) - np.searchsorted(row, row) + 1  # rows are in order, so places within them are ranks
            order, rank = order[rank <= k], rank[rank <= k]
            columns = [batch.column(0).take(pa.array(row[order])), words.dictionary.take(pa.array(code[order])), pa.array(n[order]), pa.array(rank, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "word", "n", "rank"])

    return texts.mapInArrow(counted, f"id {dict(texts.dtypes)['id']}, word string, n long, rank int")


def composed(text: str) -> str:
    """NFKC; most texts need only a look."""
    return text if text.isascii() or unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)


def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda t: None if t is None else composed(t))


def nfkc(text: Column) -> Column:
    """Compatibility forms composed; the engine has no such function."""
    return F.pandas_udf(_nfkc, "string")(text)


#: Lines that are blocks of their own, and the characters without spaces between them.
BLOCK_START = re.compile(r"\s{0,3}(#{1,6}(?:\s|\S)|>\s?|[-*+]\s|\d+[.)]\s|(-{3,}|\*{3,}|_{3,})\s*$|```|~~~)|\s*\|.*\|\s*$|\$\$|\s*\\begin\{[^}]*\}")
CJK = re.compile("[\u4e00-\u9fff\u3400-\u4dbf]")
KEPT = re.compile(r"`[^`\n]+`|\$[^$\n]+\$|https?://[^\s<>\"'，。；）)\]]+")


def regions(text: str) -> list[tuple[str, list[str]]]:
    """(kind, lines) of fenced code, displayed mathematics, tables and body."""
    out: list[tuple[str, list[str]]] = []
    inside = ""
    for line in text.split("\n"):
        fence = re.match(r"\s{0,3}(```|~~~)", line)
        if inside == "code":
            out[-1][1].append(line)
            inside = "" if fence else inside
        elif inside == "math":
            out[-1][1].append(line)
            inside = "" if line.rstrip().endswith("$$") or re.match(r"\s*\\end\{", line) else inside
        elif fence:
            out.append(("code", [line]))
            inside = "code"
        elif re.match(r"\s*\\begin\{", line) or (line.strip().startswith("$$") and not (len(line.strip()) > 2 and line.strip().endswith("$$"))):
            out.append(("math", [line]))
            inside = "math"
        else:
            kind = "table" if re.match(r"\s*\|.*\|\s*$", line) else "body"
            if not out or out[-1][0] != kind:
                out.append((kind, []))
            out[-1][1].append(line)
    return out


def normalised_around(text: str) -> str:
    """NFKC, but for inline code, mathematics and addresses."""
    if composed(text) is text:
        return text
    parts, at = [], 0
    for m in KEPT.finditer(text):
        parts += [composed(text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*parts, composed(text[at:])])


def merged_lines(lines: list[str]) -> list[str]:
    """Paragraphs, each joined to one line. Blank lines end a paragraph, and a line that is a block of its own stands alone. Lines are joined
    without a space after a hyphen, which stays, and where either side is CJK; else with one."""
    out: list[str] = []
    joins = False  # whether the next line may go on with the last
    for line in lines:
        clean = line.strip()
        block = bool(BLOCK_START.match(clean))
        if clean and joins and not block:
            bare = out[-1].endswith(("-", "－")) or CJK.search(out[-1][-1:] + clean[:1])
            out[-1] += clean if bare else f" {clean}"
        elif clean:
            out.append(clean)
        joins = bool(clean) and not block
    return out


FURNITURE = re.compile(PAGE_FURNITURE)


def cleaned_text(text: str | None) -> str | None:
    if text is None:
        return None
    text = text.replace("\r\n", "\n")
    if not text.replace("\n", "").replace("\t", "").isprintable():  # characters of the general category C, and separators, which stay
        text = "".join(c for c in text if c in "\n\t" or unicodedata.category(c)[0] != "C")
    out: list[str] = []
    for kind, lines in regions(text):
        if kind in ("code", "math"):
            out += lines
            continue
        lines = ["" if FURNITURE.match(line.strip()) else normalised_around(line) for line in lines]
        if kind == "table":
            out += [line.strip() for line in lines if line.strip()]
            continue
        for line in merged_lines(lines):
            if not re.search(MEANINGFUL, line):
                continue
            heading = re.match(r"#(\s+\S.*)$", line)
            line = f"##{heading[1]}" if heading else line
            if line.startswith("#") and out and out[-1]:
                out.append("")
            out.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def _cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(cleaned_text)


def cleaned(text: Column) -> Column:
    """Documents cleaned region by region: code and mathematics untouched, tables by line, paragraphs merged."""
    return F.pandas_udf(_cleaned, "string")(text)


def normalised(text: Column, most: int | None = None) -> Column:
    """NFKC, no zero-width characters, spaces squeezed, cut to `most` characters."""
    out = F.regexp_replace(nfkc(text), "[​-‏⁠﻿]", "")
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"(?m) +$", ""), r"\n{3,}", "\n\n")
    return out if most is None else F.substring(out, 1, most)


def listing(docs: DataFrame, title: str, id_column: str, page: int = 1, size: int = 10) -> DataFrame:
    """A page of titles with their first id and row count, in order of their first id."""
    grouped = docs.groupBy(title).agg(F.min(id_column).alias("id"), F.count(id_column).alias("chunk_count"))
    return grouped.orderBy("id").offset((page - 1) * size).limit(size)


def exact_duplicates(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id and first_id of rows whose text stands in an earlier row."""
    w = Window.partitionBy(F.sha2(text_column, 256))
    return docs.withColumn("first_id", F.min(id_column).over(w)).where(F.col("first_id") < F.col(id_column)).select(F.col(id_column).alias("id"), "first_id")


#: Links up to which the rest of the canonical choice is settled in one task.
SETTLED_LINKS = 200_000


def greedy_canonical(pairs: DataFrame, most: int = SETTLED_LINKS) -> DataFrame:
    """id and canonical_id from similar pairs (id, earlier_id, score): rows in order of id, each joins the best earlier canonical row (of equal scores the least id) or becomes
    canonical itself.

    The order matters, but not all of it: a row is canonical once all its earlier neighbours are known not to be, and is not once one of them is canonical.
    So rounds of joins decide many rows each, whatever the size of a cluster; when `most` links or fewer are left, one task settles them in order."""
    links = pairs.where("earlier_id < id").groupBy("id", "earlier_id").agg(F.max("score").alias("score"))
    links = written(links, "links")
    earlier = F.col("earlier_id").alias("id")
    open_rows, left, decided = links.select("id").union(links.select(earlier)).distinct(), links.select("id", "earlier_id"), []
    while left.count() > most:
        free = open_rows.join(left.select("id").distinct(), "id", "left_anti").withColumn("canonical", F.lit(True))
        free = written(free, "free")
        joins = left.join(free.select(F.col("id").alias("earlier_id")), "earlier_id", "left_semi").select("id").distinct().withColumn("canonical", F.lit(False))
        joins = written(joins, "joins")
        decided += [free, joins]
        open_rows = written(open_rows.join(free, "id", "left_anti").join(joins, "id", "left_anti"), "open")
        left = written(left.join(joins, "id", "left_anti").join(joins.select(F.col("id").alias("earlier_id")), "earlier_id", "left_anti"), "left")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        before: dict[int, list[int]] = {}
        for i, e in zip(pdf["id"].tolist(), pdf["earlier_id"].tolist()):
            before.setdefault(i, []).append(e)
        canonical: dict[int, bool] = {}
        for i in sorted(before):
            canonical[i] = not any(canonical.get(e, True) for e in before[i])  # rows without links of their own are canonical
        return pd.DataFrame({"id": list(canonical), "canonical": list(canonical.values())})

    rest = left.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(settle, "id long, canonical boolean")  # `most` links, at most
    decided += [rest, open_rows.join(left.select("id").distinct(), "id", "left_anti").withColumn("canonical", F.lit(True))]
    status = decided[0]
    for part in decided[1:]:
        status = status.unionByName(part)
    status = written(status, "status")
    heads = status.where("canonical").select(F.col("id").alias("earlier_id"))
    chosen = links.join(heads, "earlier_id", "left_semi").groupBy("id").agg(F.max_by("earlier_id", F.struct("score", -F.col("earlier_id"))).alias("head"))
    return status.join(chosen, "id", "left").select("id", F.when(F.col("canonical"), F.col("id")).otherwise(F.col("head")).alias("canonical_id"))


#: How a crawled page is judged under each policy.
def reviewed(policy: Column, sufficient: Column, score: Column, conflict: Column, least: float = 0.6) -> Column:
    """approved, rejected or conflict of a page; without a score the open policy approves."""
    return (
        F.when(F.coalesce(conflict, F.lit(False)) & (policy != "fail_open"), "conflict").when(score.isNull(), F.when(policy == "fail_open", "approved").otherwise("rejected"))
        .when(policy == "strict", F.when(F.coalesce(sufficient, F.lit(False)) & (score >= least), "approved").otherwise("rejected"))
        .otherwise(F.when(F.coalesce(sufficient, F.lit(False)) | (score >= least), "approved").otherwise("rejected"))
    )
