"""Words of text without spaces: the path of greatest probability over the lattice of a lexicon's words.

A lexicon is a table (word, n). It may be given, or learnt: `learnt_lexicon` counts all runs of up to MOST characters within CJK text, over all texts, and keeps those that are
frequent and hold together better than their parts would by chance. Words of a given one may be of any length. Characters that no word covers stand alone, rarer than any word.

Runs of CJK characters are cut so; other letters and digits are words as `functions.text.tokens` has them. Of paths of equal probability the one with the longer last word counts.
Runs are cut some SLICE_CHARS characters at a time, in one list of places, so memory follows the longest run, not the number of runs times its length.
Null texts have no words.

`segmenter` sends a lexicon to the tasks whole: its rows are counted, and more than LEXICON_ROWS are an error. `with_words` takes lexicons of any size: the most frequent words, up to
LEXICON_ROWS, go to the tasks; of the others only bits of their hashes do (a Bloom filter), by which a task finds what may be such words in each text; these meet the
lexicon in a join, and those that stand in it go back to their text before it is cut. The bits only spare rows, so the words are those of the whole lexicon.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import tokens
from ..session import written

#: Characters of a learnt word at most, and rows of a lexicon that goes to the tasks.
MOST, LEXICON_ROWS = 6, 500_000
#: Lengths at which it is asked whether a longer word begins so, and beyond them their multiples.
LEVELS = (6, 8, 10, 12, 16, 24)
#: Bits a word of a filter at least, places of a key in it, and bits in a row of its table.
BITS, PROBES, BLOCK_BITS = 24, 3, 1 << 16
#: Characters that are cut at a time, unless one run alone is longer, and places whose words are looked up at a time.
SLICE_CHARS, BLOCK = 1 << 20, 1 << 17
CJK = r"[㐀-䶿一-鿿]+"


def cjk_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({CJK})"), F.lit(1))


def learnt_lexicon(texts: DataFrame, least: int = 5, cohesion: float = 2.0, most: int = MOST) -> DataFrame:
    """(word, n) of texts (text): characters, and runs of two to `most` characters that stand at least `least` times and whose logarithm of frequency exceeds
    that of each two parts, taken as independent, by `cohesion`. One explode and two aggregations over all texts; no text is sampled."""
    runs = texts.select(F.explode(cjk_runs(F.col("text"))).alias("run"))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.when(F.length("run") >= k, F.transform(F.sequence(F.lit(1), F.length("run") - k + 1), lambda i: F.substring("run", i, k))).otherwise(F.array().cast("array<string>"))))
    counts = runs.select(F.explode(grams).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= least) | (F.length("word") == 1))
    total = counts.where(F.length("word") == 1).agg(F.sum("n").cast("double").alias("total"))
    cuts = counts.where(F.length("word") > 1).select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("cut"))
    cuts = cuts.select("word", "n", F.expr("substring(word, 1, cut)").alias("left"), F.expr("substring(word, cut + 1)").alias("right"))
    side = lambda c: counts.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}"))
    parts = cuts.join(side("left"), "left").join(side("right"), "right").crossJoin(F.broadcast(total))  # one row of totals
    bound = F.log(F.col("n")) + F.log("total") - F.log("n_left") - F.log("n_right")
    kept = parts.groupBy("word", "n").agg(F.min(bound).alias("holds")).where(F.col("holds") > cohesion)
    return kept.select("word", "n").union(counts.where(F.length("word") == 1))


def is_level(n: int) -> bool:
    """Lengths at which prefixes of longer words are kept: a bounded number for each doubling of the length."""
    return n in LEVELS or (n > LEVELS[-1] and n & (n - 1) == 0)


class Filter:
    """Bits of hashes, of words and of beginnings of longer ones: without a false no, and with few a false yes."""

    def __init__(self, words: int, held: np.ndarray | None = None) -> None:
        self.size = filter_bits(words)
        self.held = np.zeros(self.size // 8, np.uint8) if held is None else held

    def add(self, at: np.ndarray) -> None:
        bits = np.zeros(self.size, bool)
        bits[at] = True
        self.held |= np.packbits(bits, bitorder="little")

    def has(self, hashes: np.ndarray, salt: int) -> np.ndarray:
        yes = np.ones(len(hashes), bool)
        for k in range(PROBES):
            own = np.flatnonzero(yes)
            at = probe(hashes[own], salt + k, self.size)
            yes[own] = (self.held[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return yes


#: What keys of a filter are: words, and beginnings of longer ones.
WORD, BEGINNING = 1, 1 + PROBES


def filter_bits(words: int) -> int:
    return max(BLOCK_BITS, 1 << int(np.ceil(np.log2(max(1, BITS * words)))))


def probe(hashes: np.ndarray, salt: int, size: int) -> np.ndarray:
    """Places of keys in a filter of `size` bits, a power of two."""
    h = (hashes ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32) & np.uint64(size - 1)).astype(np.int64)


def stepped(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The hashes of one character more."""
    h = (h ^ codes.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def hashes_of(words: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """64-bit hashes of words, and those of their beginnings at the lengths where they are kept."""
    codes, lengths = codes_of(words)
    starts, h, beginnings = np.cumsum(lengths) - lengths, np.zeros(len(lengths), np.uint64), []
    own, n = np.flatnonzero(lengths > 0), 0
    while len(own):
        h[own] = stepped(h[own], codes[starts[own] + n])
        n += 1
        own = own[lengths[own] > n]
        if is_level(n):
            beginnings.append(np.unique(h[own]))
    return h, beginnings


def codes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of strings one after the other, and the strings' lengths."""
    text = "".join(strings.to_pylist())
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64), pc.utf8_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)


class Lattice:
    """The lexicon as sorted hashes of words, by length, with logarithms of their probability. `total` and `bits` are of the whole lexicon, where these words are a part."""

    def __init__(self, words: list[str] | pa.Array, counts: np.ndarray, total: float | None = None, bits: Filter | None = None, most: int | None = None) -> None:
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.string())
        self.total = total = (counts.sum() if total is None else total) + 1.0
        self.unknown = float(np.log(0.5 / total))
        hashes, beginnings = hashes_of(words)
        lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        self.most = max(1, int(lengths.max(initial=1)), most or 1)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == length)
            own = own[np.argsort(hashes[own])]
            self.by_length[length] = hashes[own], np.log(counts[own] / total)
        self.whole, self.bits = bits is None, bits or Filter(len(words))
        if self.whole and beginnings:
            self.bits.add(np.concatenate([probe(h, BEGINNING + k, self.bits.size) for h in beginnings for k in range(PROBES)]))

    def strings(self, codes: np.ndarray, ends: np.ndarray, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length by length the places `low` to `high` where a word of this length may begin, and its hash; `ends` has for each place where its run ends."""
        at, h = np.arange(low, high), np.zeros(high - low, np.uint64)
        for n in range(1, self.most + 1):
            h = stepped(h, codes[at + n - 1])
            yield n, at, h
            keep = ends[at] > at + n
            if is_level(n):
                keep[keep] = self.bits.has(h[keep], BEGINNING)
            at, h = at[keep], h[keep]
            if not len(at):
                return

    def beginning(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: int, high: int, others: tuple[np.ndarray, np.ndarray] | None) -> tuple[list, ...]:
        """Words that begin at the places `low` to `high`: place before them (beyond all where a run begins), end, length, score; by beginning, the longest first."""
        found = []
        for n, at, h in self.strings(codes, ends, low, high):
            log = np.full(len(at), self.unknown if n == 1 else -np.inf)
            for hashes, logs in ([self.by_length[n]] if n in self.by_length else []) + ([others] if others is not None and len(others[0]) else []):
                place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                log = np.maximum(log, np.where(hashes[place] == h, logs[place], -np.inf))
            own = np.flatnonzero(log > -np.inf)
            found.append((at[own], np.full(len(own), n), log[own]))
        at, n, log = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(at, kind="stable")
        at, n, log = at[order], n[order], log[order]
        return np.where(starts[at] == at, len(codes) + 1, at).tolist(), (at + n).tolist(), n.tolist(), log.tolist()

    def cut(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, others: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """For each place of the runs, whether a word of the best path begins there. `others` are sorted hashes of further words and their logarithms."""
        begins = np.zeros(len(codes), bool)
        if not len(codes):
            return begins
        first, last = np.repeat(starts, lengths), np.repeat(starts + lengths, lengths)  # of the run of each place; runs follow each other without gaps
        best, back = [-np.inf] * (len(codes) + 1) + [0.0], [0] * (len(codes) + 1)  # the last one stands before every run
        for low in range(0, len(codes), BLOCK):
            for source, end, n, log in zip(*self.beginning(codes, first, last, low, min(len(codes), low + BLOCK), others)):
                s = best[source] + log
                if s > best[end]:  # of equals the longer, which begins earlier
                    best[end] = s
                    back[end] = n
        for start, length in zip(starts.tolist(), lengths.tolist()):
            at = start + length
            while at > start:
                at -= back[at]
                begins[at] = True
        return begins

    def others(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the runs where words of the whole lexicon that are not among these may begin, and their hashes."""
        first, last = np.repeat(starts, lengths), np.repeat(starts + lengths, lengths)
        for low in range(0, len(codes), BLOCK):
            for n, at, h in self.strings(codes, last, low, min(len(codes), low + BLOCK)):
                yes = self.bits.has(h, WORD)
                yield at[yes], h[yes]


def segmented(lattice: Lattice, runs: list[str]) -> list[list[str]]:
    """The words of each run."""
    return words_of(lattice, pa.array(runs, pa.string())).to_pylist()


def words_of(lattice: Lattice, runs: pa.Array, others: tuple[np.ndarray, np.ndarray] | None = None) -> pa.Array:
    """The words of each run, as lists of slices of the runs' own bytes."""
    text = "".join(runs.to_pylist())
    codes, lengths = codes_of(runs)
    starts = np.cumsum(lengths) - lengths
    places = np.flatnonzero(lattice.cut(codes, starts[lengths > 0], lengths[lengths > 0], others))
    ends = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))])
    edges = ends[np.append(places, len(codes))].astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(edges), pa.py_buffer(text.encode())).cast(pa.string())
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(places, np.append(starts, len(codes))), pa.int32()), words)


def slices_of(runs: pa.Array) -> Iterator[slice]:
    """Runs of some SLICE_CHARS characters, or one longer one."""
    total, at = np.cumsum(pc.utf8_length(runs).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(runs):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_CHARS, side="right")))
        yield slice(at, to)
        at = to


def cut_texts(lattice: Lattice, texts: pa.Array, others: pa.Array | None = None) -> pa.Array:
    """The words of each run of texts (lists of runs), some SLICE_CHARS characters at a time. `others` has for each text further words of the lexicon that may stand in it (lists of
    hash and n): all that do, so that those of one text change no other."""
    runs, parts = texts.flatten(), [pa.array([], pa.list_(pa.string()))]
    owner = pc.list_parent_indices(texts).to_numpy()
    for own in slices_of(runs):
        further = None
        if others is not None:
            held = others.slice(int(owner[own.start]), int(owner[own.stop - 1] - owner[own.start]) + 1).flatten()
            hashes, first = np.unique(held.field("h").to_numpy().view(np.uint64), return_index=True)
            further = hashes, np.log(held.field("n").to_numpy()[first] / lattice.total)
        parts.append(words_of(lattice, runs.slice(own.start, own.stop - own.start), further))
    sizes = pc.list_value_length(texts).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.concat_arrays(parts))


def usable(lexicon: DataFrame) -> DataFrame:
    return lexicon.where("word IS NOT NULL AND word <> '' AND n > 0").groupBy("word").agg(F.sum("n").alias("n"))


def runs_of(text: Column) -> Column:
    return F.coalesce(cjk_runs(text), F.array().cast("array<string>"))


def all_words(text: Column, cut: Column) -> Column:
    return F.concat(F.flatten(cut), tokens(F.regexp_replace(F.coalesce(text, F.lit("")), CJK, " ")))


def segmenter(lexicon: DataFrame) -> Callable[[Column], Column]:
    """A function of a text column that gives its words, by the lexicon; for `terms` of an index or a search."""
    rows = usable(lexicon).limit(LEXICON_ROWS + 1).toArrow()
    if rows.num_rows > LEXICON_ROWS:
        raise ValueError(f"a lexicon of more than {LEXICON_ROWS} words; use with_words")
    lattice = lattice_of(rows)

    @F.arrow_udf(ArrayType(ArrayType(StringType())))
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield cut_texts(lattice, texts)

    return lambda text: all_words(text, cut(runs_of(text)))


def lattice_of(rows: pa.Table, *whole) -> Lattice:
    return Lattice(rows.column("word").combine_chunks(), rows.column("n").to_numpy().astype(np.float64), *whole)


def with_words(texts: DataFrame, text: str, name: str, lexicon: DataFrame) -> DataFrame:
    """texts with the words of column `text`, as `segmenter` gives them, in column `name`, by a lexicon of any size."""
    lexicon = written(usable(lexicon), "lexicon")
    told = lexicon.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("total"), F.coalesce(F.max(F.length("word")), F.lit(1)).alias("most")).first()
    if told["rows"] <= LEXICON_ROWS:
        return texts.withColumn(name, segmenter(lexicon)(F.col(text)))
    least = least_count(lexicon)
    rest = written(lexicon.where(F.col("n") < least).mapInArrow(hashed_words, "h long, n long, beginnings array<long>"), "rest")
    bits = filter_of(rest, lexicon.where(F.col("n") >= least), told["rows"])
    lattice = lattice_of(lexicon.where(F.col("n") >= least).select("word", "n").toArrow(), told["total"], bits, told["most"])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, owner = batch.column(1).flatten(), pc.list_parent_indices(batch.column(1)).to_numpy()
            for own in slices_of(runs):
                codes, lengths = codes_of(runs.slice(own.start, own.stop - own.start))
                row = np.repeat(owner[own], lengths)
                for at, h in distinct_pairs((row[at], h) for at, h in lattice.others(codes, np.cumsum(lengths) - lengths, lengths)):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(h.view(np.int64))], names=["__text", "h"])

    @F.arrow_udf(ArrayType(ArrayType(StringType())))
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for runs, others in batches:
            yield cut_texts(lattice, runs, others)

    keyed = texts.withColumn("__text", F.xxhash64(*texts.columns))  # rows of one key share the words found in any of them, which changes none
    found = keyed.select("__text", runs_of(F.col(text)).alias("runs")).mapInArrow(candidates, "__text long, h long").distinct()
    words = rest.groupBy("h").agg(F.max("n").alias("n"))
    others = found.join(words, "h").groupBy("__text").agg(F.collect_list(F.struct("h", "n")).alias("__others"))
    both = keyed.join(written(others, "others"), "__text", "left").withColumn("__others", F.coalesce("__others", F.array().cast("array<struct<h: bigint, n: bigint>>")))
    return both.withColumn(name, all_words(F.col(text), cut(runs_of(F.col(text)), F.col("__others")))).drop("__text", "__others")


def least_count(lexicon: DataFrame) -> int:
    """The least n of which, and of more, no more than LEXICON_ROWS words are."""
    counts = lexicon.groupBy("n").agg(F.count("*").alias("words"))  # fewer rows than the square root of twice all words' occurrences
    above = counts.select("n", F.sum("words").over(Window.orderBy(F.desc("n"))).alias("words"))
    found = above.where(F.col("words") <= LEXICON_ROWS).agg(F.min("n").alias("n")).first()["n"]
    return found if found is not None else lexicon.agg(F.max("n").alias("n")).first()["n"] + 1


def hashed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of words (word, n) their hashes, and once a batch those of their beginnings, in its first row."""
    for batch in batches:
        if len(batch):
            h, beginnings = hashes_of(batch.column(0))
            own = np.concatenate([np.zeros(0, np.uint64), *beginnings]).view(np.int64)
            edges = pa.array(np.concatenate([[0], np.full(len(h), len(own))]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(1), pa.ListArray.from_arrays(edges, pa.array(own))], names=["h", "n", "beginnings"])


def filter_of(rest: DataFrame, frequent: DataFrame, words: int) -> Filter:
    """The filter of the words of `rest` (h, n, beginnings) and of the beginnings of these and the frequent ones (word, n). Its bits come together by blocks; only they reach the driver."""
    size = filter_bits(words)
    beginnings = rest.select("beginnings").union(frequent.mapInArrow(hashed_words, "h long, n long, beginnings array<long>").select("beginnings"))
    keys = rest.select("h", F.lit(WORD).alias("salt")).union(beginnings.select(F.explode("beginnings").alias("h"), F.lit(BEGINNING).alias("salt"))).distinct()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, salt = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            at = np.concatenate([probe(h[salt == s], s + k, size) for s in (WORD, BEGINNING) for k in range(PROBES)])
            yield pa.RecordBatch.from_arrays([pa.array(at // BLOCK_BITS), pa.array((at % BLOCK_BITS).astype(np.int32))], names=["block", "bit"])

    def packed(found: pa.Table) -> pa.Table:
        bits = np.zeros(BLOCK_BITS, bool)
        bits[found.column("bit").to_numpy()] = True
        return pa.table({"block": found.column("block").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    rows = keys.mapInArrow(places, "block long, bit int").groupBy("block").applyInArrow(packed, "block long, bits binary").toArrow()
    held = np.zeros((size // BLOCK_BITS, BLOCK_BITS // 8), np.uint8)
    for block, bits in chain.from_iterable(zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for b in rows.to_batches()):
        held[block] = np.frombuffer(bits, np.uint8)
    return Filter(words, held.ravel())


def distinct_pairs(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row, hash), each once within some millions."""
    held = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for part in chain(parts, [None]):
        if part is not None:
            held.append(part)
        if part is None or sum(len(r) for r, _ in held) > SLICE_CHARS:
            row, h = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            keep = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])[: len(row)]
            yield row[keep], h[keep]
            held = [(row[:0], h[:0])]
