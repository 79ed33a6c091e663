"""Files: formats by name and magic bytes, text of unknown encoding, office files and delimited tables as Markdown, JSON and tab-separated sets."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats by the first bytes (in hexadecimal) and by extension.
MAGIC = {"25504446": "pdf", "504B0304": "zip"}
EXTENSIONS = {"pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "csv": "csv", "md": "markdown", "markdown": "markdown", "txt": "text", "html": "html", "htm": "html"}


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def detected_format(content: Column, path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    named = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])[extension]
    first = F.hex(F.substring(content, 1, 4))
    out = F.coalesce(named, F.lit("unknown"))
    for magic, kind in MAGIC.items():
        known = F.when(named.isin("docx", "xlsx"), named).otherwise(F.lit(kind)) if kind == "zip" else F.lit(kind)
        out = F.when(first == magic, known).otherwise(out)
    return out


def _by_encodings(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def decoded(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        for name in ("utf-8-sig", "utf-8", "gb18030"):
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                continue
        return raw.decode("latin-1")

    for batch in batches:
        yield batch.map(decoded)


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 in the engine, other encodings by trial."""
    utf8 = F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", "")
    return F.when(F.is_valid_utf8(content.cast("string")), utf8).otherwise(F.pandas_udf(_by_encodings, "string")(content))


def stored_name(content: Column, name: Column) -> Column:
    """The name a file is kept under, led by a hash of its content."""
    return F.concat(F.substring(F.sha2(content, 256), 1, 16), F.lit("_"), F.regexp_replace(name, r"[^0-9A-Za-z.\-_]", "_"))


def csv_rows(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Rows of a delimited file as an array of trimmed cells, empty ones dropped."""
    names = [f"_c{i}" for i in range(columns)]
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(path)
    cells = F.array(*[F.trim(F.coalesce(F.col(n), F.lit(""))) for n in names])
    return rows.select(cells.alias("cells")).where(F.exists("cells", lambda x: x != ""))


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def markdown_table(rows: DataFrame, key: str, order: str, cells: str) -> DataFrame:
    """One Markdown table a key, a separator after its first row."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(cells)))), lambda r: r[cells])
    grouped = rows.groupBy(key).agg(listed.alias("rows"))
    lines = F.transform("rows", markdown_row)
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get("rows", 0), lambda _: F.lit("---")), " | "), F.lit(" |"))
    return grouped.select(key, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n").alias("markdown"))


def json_set(spark: SparkSession, path: str, schema: str, required: Sequence[str], least: int = 20) -> DataFrame:
    """A JSON set of at least `least` rows with the required keys."""
    rows = spark.read.schema(schema).json(path, multiLine=True)
    told = rows.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in required]).first()
    if told["n"] < least:
        raise ValueError(f"{told['n']} rows; at least {least} are needed")
    missing = [c for c in required if told[c]]
    if missing:
        raise ValueError(f"rows without {missing}")
    return rows


def relevance_judgements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).schema("qid string, cid string, score double").csv(path)


def hashed_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by a seeded hash of their key: the same rows on each run."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def reading_order(blocks: DataFrame, middle: str = "middle") -> DataFrame:
    """Text of pages of two columns from blocks (page, x0, x1, y0, text): blocks across the middle, then the left column, then the right."""
    zone = F.when((F.col("x0") < F.col(middle)) & (F.col("x1") > F.col(middle)), 0).when(F.col("x1") <= F.col(middle), 1).otherwise(2)
    ordered = F.array_sort(F.collect_list(F.struct(zone.alias("zone"), "y0", "x0", "text")))
    return blocks.groupBy("page").agg(F.array_join(F.transform(ordered, lambda b: b["text"]), "\n").alias("text"))


def zipped_xml(content: bytes, names: Callable[[str], bool]) -> dict[str, ElementTree.Element]:
    """The parsed members of an office file that are asked for; none if it is no such file."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            return {n: ElementTree.fromstring(archive.read(n)) for n in archive.namelist() if names(n)}
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
        return {}


def rows_as_markdown(rows: Sequence[Sequence[str]]) -> list[str]:
    """Lines of a table: all rows as wide as the widest, a rule after the first."""
    width = max(map(len, rows), default=0)
    lines = [f"| {' | '.join([*r, *[''] * (width - len(r))])} |" for r in rows]
    return [*lines[:1], f"| {' | '.join(['---'] * width)} |", *lines[1:]] if lines else []


def docx_markdown(content: bytes) -> str:
    """Paragraphs (headings by their level) and tables of a document in order."""
    body = zipped_xml(content, lambda n: n == "word/document.xml").get("word/document.xml")
    if body is None:
        return ""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    plain = lambda node: "".join(t.text or "" for t in node.iter(f"{w}t")).strip()
    blocks: list[str] = []
    for node in body.find(f"{w}body") or []:
        if node.tag == f"{w}p" and (text := plain(node)):
            style = node.find(f"{w}pPr/{w}pStyle")
            level = re.fullmatch(r"(?i)heading\s*(\d)", style.get(f"{w}val", "")) if style is not None else None
            blocks.append(f"{'#' * min(6, int(level[1]))} {text}" if level else text)
        elif node.tag == f"{w}tbl":
            rows = [[plain(cell).replace("\n", " ") for cell in row.findall(f"{w}tc")] for row in node.findall(f"{w}tr")]
            blocks.append("\n".join(rows_as_markdown([r for r in rows if any(r)])))
    return "\n\n".join(b for b in blocks if b)


def column_number(cell: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for c in re.match(r"[A-Z]*", cell)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def xlsx_markdown(content: bytes) -> str:
    """Each sheet as a heading and a table of its rows that are not empty."""
    parts = zipped_xml(content, lambda n: n in ("xl/workbook.xml", "xl/sharedStrings.xml") or n.startswith("xl/worksheets/sheet"))
    if "xl/workbook.xml" not in parts:
        return ""
    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{m}t"))
    shared = [text(s) for s in parts["xl/sharedStrings.xml"]] if "xl/sharedStrings.xml" in parts else []
    names = [s.get("name", "") for s in parts["xl/workbook.xml"].iter(f"{m}sheet")]
    sheets = sorted((n for n in parts if n.startswith("xl/worksheets/")), key=lambda n: int(re.sub(r"\D", "", n.rpartition("/")[2]) or 0))
    out = []
    for name, sheet in zip(names, sheets):
        rows = []
        for row in parts[sheet].iter(f"{m}row"):
            cells: list[str] = []
            for cell in row.findall(f"{m}c"):
                at = column_number(cell.get("r", "")) if cell.get("r") else len(cells)
                value = cell.find(f"{m}v")
                raw = text(cell) if cell.get("t") == "inlineStr" else (value.text or "") if value is not None else ""
                cells += [""] * (at + 1 - len(cells))
                cells[at] = (shared[int(raw)] if cell.get("t") == "s" and raw else raw).strip()
            if any(cells):
                rows.append(cells)
        out.append("\n".join([f"## {name}", *rows_as_markdown(rows)]))
    return "\n\n".join(out)


#: Readers of formats whose bytes are no text.
READERS = {"docx": docx_markdown, "xlsx": xlsx_markdown}


def _read(kinds: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for kind, content in kinds:
        yield pd.Series([READERS[k](c) if k in READERS and c is not None else None for k, c in zip(kind, content)])


def parsed_documents(files: DataFrame) -> DataFrame:
    """path, format, text of files (path, content): office files by their XML, text formats decoded; other formats have no text."""
    kind = detected_format(F.col("content"), F.col("path"))
    told = files.withColumn("format", kind)
    office = F.pandas_udf(_read, "string")("format", "content")
    text = F.when(F.col("format").isin(*READERS), office).when(F.col("format").isin("csv", "markdown", "text", "html"), decoded(F.col("content")))
    return told.select("path", "format", text.alias("text"))
