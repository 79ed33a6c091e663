"""Line deduplication by MinHash: one line of each group of near-equal lines stays, the others go from their documents.

Lines are parts between line feeds; those without a word (blank ones) always stay. Rows are numbered and written once, and a line is known by
its row's number and its place. Lines equal to an earlier one (in order of doc_id, row number and place) go first, by a 128-bit hash of the line.
Of each remaining line, PERMUTATIONS least hashes of its shingles of SHINGLE
characters form a signature; BANDS bands of ROWS make bucket keys, by which lines of Jaccard similarity LIMIT meet with a probability
of 0.998 and more similar ones almost surely. Candidates are compared exactly (linking.py) and joined by distributed union-find; the first line of each
component stays.

Texts move only where they must: keys and ids are shuffled, and only lines with a candidate are read again for the comparison.
Tables of lines to drop are broadcast up to a size in bytes, and joined by a shuffle beyond.

Nulls: a null text stays null and has no lines. A null id sorts first. Repeated rows are rows of their own: the first keeps its lines, the
others lose them. Ties: of equal ids the lower row number is first. Lines shorter than a shingle are padded; very long lines and texts are processed
whole. A document whose lines all go becomes an empty text, and stays. An empty table gives no
rows. Further columns are untouched, also ones named n_lines or n_dropped in `drop_lines_only`; names that begin with `__` are refused.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import gathered
from .common import Scratch, slices, small_side, texts_of, unreserved, written
from .divergence import bound
from .linking import common_of, jaccard, linked_components
from .order_minhash import mixed

SHINGLE, BANDS, ROWS, LIMIT = 8, 12, 4, 0.8
HAS_WORD = r"[^\x20\x09-\x0D]"
#: Shingles of a step of the signatures, and bytes of the texts sliced before, small enough for the cache of one core.
STEP, SLICE = 1 << 15, 256 << 10
#: Bytes of a row with an array in a broadcast table, without its elements, and of a row of numbers.
ROW_BYTES, NUMBER_BYTES = 64, 40


def numbered(docs: DataFrame) -> DataFrame:
    """docs with the number __row."""
    return unreserved(docs).withColumn("__row", F.monotonically_increasing_id())


def exact_drops(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(__row, __drop) of lines equal to an earlier line: the row and an array of places."""
    lines = rows.select(F.col("doc_id").cast("long").alias("id"), F.col("__row"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("place", "line")).where(F.col("line").rlike(HAS_WORD))
    lines = scratch.put(lines.select("id", "__row", "place", F.unhex(F.md5("line")).alias("digest")))
    firsts = scratch.put(lines.groupBy("digest").agg(F.min(F.struct("id", "__row", "place")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    later = lines.join(small_side(firsts, firsts.count() * 3 * NUMBER_BYTES), "digest").where(F.struct("id", "__row", "place") != F.col("first"))
    drops = scratch.put(by_row(later))
    scratch.drop(lines, firsts)
    return drops


def by_row(places: DataFrame) -> DataFrame:
    return places.groupBy("__row").agg(F.collect_list("place").alias("__drop"))


def with_drops(rows: DataFrame, drops: DataFrame) -> DataFrame:
    """Rows with their array of dropped places, null for none."""
    size = drops.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("__drop")), F.lit(0)).alias("places")).first()
    return rows.join(small_side(drops, size["n"] * ROW_BYTES + size["places"] * 4), "__row", "left")


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of all lines in order, shingles of each line)."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    padded = np.maximum(size, SHINGLE)
    starts = np.cumsum(padded) - padded
    flat = np.full(int(padded.sum()), 2**64 - 1, np.uint64)  # what pads short lines is no character
    flat[gathered(starts, size)] = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    rolled, width = flat + np.uint64(1), 1
    while width < SHINGLE:  # SHINGLE is a power of two
        rolled = rolled[: len(rolled) - width] * np.uint64(pow(0x100000001B3, width, 2**64)) + rolled[width:]
        width *= 2
    windows = padded - SHINGLE + 1
    return mixed(rolled[gathered(starts, windows)]), windows


def shingle_sets(lines: list[str]) -> tuple[list[np.ndarray], Callable[[int, int], bool]]:
    """Sorted distinct shingle hashes of each line, which decide alone."""
    h, windows = shingle_hashes(lines)
    own = np.repeat(np.arange(len(lines)), windows)
    for end, n in zip(np.cumsum(windows).tolist(), windows.tolist()):
        h[end - n : end].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return np.split(h[new], np.cumsum(np.bincount(own[new], minlength=len(lines)))[:-1]), lambda i, j: True


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Band keys of each line that has a word and is not dropped."""
    rng = np.random.default_rng(17)
    factors, shifts = (rng.integers(2**32, size=BANDS * ROWS, dtype=np.uint64).astype(np.uint32) for _ in range(2))
    factors |= np.uint32(1)
    for batch in slices(batches, "text", SLICE):
        which, places, lines = [], [], []
        for i, (text, drop) in enumerate(zip(texts_of(batch).to_pylist(), batch.column(3).to_pylist())):
            gone = set(drop or ())
            for place, line in enumerate(text.split("\n")):
                if place not in gone and line.strip(" \t\n\x0b\x0c\r"):
                    which.append(i)
                    places.append(place)
                    lines.append(line)
        if not lines:
            continue
        h, windows = shingle_hashes(lines)
        h = (h >> np.uint64(32)).astype(np.uint32)
        ends = np.cumsum(windows)
        least = np.empty((len(lines), BANDS * ROWS), np.uint64)
        first = 0
        while first < len(lines):
            begin = ends[first] - windows[first]
            last = max(first + 1, int(np.searchsorted(ends, begin + STEP, side="right")))
            own, at = h[begin : ends[last - 1]], ends[first:last] - windows[first:last] - begin
            buffer = np.empty_like(own)
            for k, (f, s) in enumerate(zip(factors, shifts)):
                np.multiply(own, f, out=buffer)
                np.add(buffer, s, out=buffer)
                least[first:last, k] = np.minimum.reduceat(buffer, at)
            first = last
        keys = np.zeros((len(lines), BANDS), np.uint64)
        for j in range(ROWS):
            keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + least[:, j::ROWS] + np.uint64(1))
        keys = mixed(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
        rows = pa.array(np.array(which))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.array(places, np.int32)), lists], names=["id", "__row", "place", "keys"])


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Jaccard similarity of the shingle sets of pairs of lines. A leader's line stands in many pairs and is hashed once."""
    for batch in slices(batches, "body_b", 4 << 20):
        coded = pa.concat_arrays([texts_of(batch, "body_a"), texts_of(batch, "body_b")]).dictionary_encode()
        sets, _ = shingle_sets(coded.dictionary.to_pylist())
        size, which = np.array([len(s) for s in sets]), coded.indices.to_numpy()
        a, b = which[: batch.num_rows], which[batch.num_rows :]
        similarity = jaccard(common_of(sets, a, b), size[a], size[b])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similarity), pa.array(similarity >= LIMIT), batch.column(4)], names=["a", "b", "similarity", "same", "size"])


def fuzzy_drops(rows: DataFrame, exact: DataFrame, scratch: Scratch) -> DataFrame:
    """(__row, place) of lines near-equal to an earlier one, among those that `exact` does not drop."""
    texts = rows.select(F.col("doc_id").cast("long").alias("id"), "__row", F.col("text").cast("string").alias("text"))
    lines = with_drops(texts, exact).select("id", "__row", "text", "__drop").mapInArrow(signatures, "id long, __row long, place int, keys array<long>")
    lines = scratch.put(lines.withColumn("node", F.monotonically_increasing_id()))

    def bodies_of(some: DataFrame) -> DataFrame:
        some = scratch.put(some)
        wanted = lines.select("__row", "place", "node").join(small_side(some, some.count() * NUMBER_BYTES), "node")
        wanted = scratch.put(wanted.groupBy("__row").agg(F.collect_list(F.struct("place", "node")).alias("wanted")))
        size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("wanted")), F.lit(0)).alias("lines")).first()
        found = texts.select("__row", "text").join(small_side(wanted, size["n"] * ROW_BYTES + size["lines"] * NUMBER_BYTES), "__row")
        found = found.select(F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w"))
        return scratch.put(found.select(F.col("w.node").alias("node"), F.get("lines", F.col("w.place")).alias("body")))

    keys = lines.select("node", F.explode("keys").alias("key"))
    component = linked_components(keys, bodies_of, verified, shingle_sets, jaccard, LIMIT, scratch)
    members = scratch.put(lines.select("id", "__row", "place", "node").join(small_side(component, component.count() * NUMBER_BYTES), "node"))
    firsts = members.groupBy("component").agg(F.min(F.struct("id", "__row", "place")).alias("first"))
    return members.join(firsts, "component").where(F.struct("id", "__row", "place") != F.col("first")).select("__row", "place")


def dropped(docs: DataFrame) -> DataFrame:
    """docs with __drop, the places of the lines that go, null for none, and __lines, the number of lines with a word. The table is written before, and read from there."""
    scratch = Scratch(docs.sparkSession, "lines")
    rows = written(numbered(docs), "rows")
    exact = exact_drops(rows, scratch)
    fuzzy = fuzzy_drops(rows, exact, scratch)
    drops = written(by_row(exact.select("__row", F.explode("__drop").alias("place")).union(fuzzy)), "drops")
    scratch.drop_all()
    lines = F.split(F.col("text").cast("string"), "\n")
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.filter(lines, lambda x: x.rlike(HAS_WORD))))
    return with_drops(rows, drops).withColumn("__lines", n_lines.cast("long"))


def left_text() -> Column:
    """The text without the lines of __drop."""
    text = F.col("text").cast("string")
    staying = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__drop")), lambda i: F.get(x, i))
    return F.when(F.col("__drop").isNull(), text).otherwise(F.array_join(bound(F.split(text, "\n"), staying), "\n"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """The columns of docs but n_lines and n_dropped with repeated lines taken out of text, then n_lines (with a word, before) and n_dropped."""
    rows = dropped(docs)
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    n_dropped = F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).cast("long")
    return rows.select(*[left_text().alias("text") if c == "text" else F.col(c) for c in own], F.col("__lines").alias("n_lines"), n_dropped.alias("n_dropped"))


def drop_lines_only(docs: DataFrame) -> DataFrame:
    """The columns of docs, whatever their names, with repeated lines taken out of text."""
    return dropped(docs).select(*[left_text().alias("text") if c == "text" else F.col(c) for c in docs.columns])
