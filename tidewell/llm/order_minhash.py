"""Near-duplicate documents by order MinHash.

Items are k-mers of WORDS words in lower case, each labelled with its occurrence number in the text. Each of SKETCHES sketches hashes
the labelled k-mers anew, takes the CHOSEN least and keeps them in text order; their hash is a bucket key. Two texts share a sketch with
the probability that the same k-mers are least and stand in the same order, which falls with edits. Candidates are decided by a
banded alignment of their words: the edit similarity, 1 - edits / words of the longer text, must reach LIMIT. Before an alignment only a bound that
follows from it is asked: the words that two texts share, each as often as both have it, must be LIMIT of the longer text's. Linked texts form classes; a class's id is its least doc_id.

With edits at random places, the sketches meet a pair of 200 words at LIMIT itself in more than nine of ten cases, and nearly all pairs above; the test measures
it. Edits that leave no five words in a row alone, as one in every fifth word, leave nothing to be met by.

Equal texts are one node before anything else, so copies cost a row each. Nulls: a null text is empty, and all texts without words are one
class; rows with a null id join classes but name none unless all ids of a class are null. Texts of fewer than WORDS words have one k-mer,
the whole. Very long texts are sketched and compared whole, one at a time. Ties: equal hashes keep the text's order; of equal first ids the least digest counts.
Repeated rows get the same class. An empty table gives no rows. Columns besides doc_id and text play no part; `one_of_each` keeps them, but refuses
names that begin with `__`.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import gathered
from .common import Scratch, slices, small_side, texts_of, unreserved, written
from .linking import linked_components, of_larger
from .words import coded_words, hash_words

WORDS, SKETCHES, CHOSEN, LIMIT = 5, 64, 2, 0.8
#: One bucket in so many is compared before the others.
EARLY = 5
#: k-mers that pass the first cut of a sketch on average; of texts left with fewer than CHOSEN all pass.
PASS = 16
#: Bytes of a row (number, digest, id) in a broadcast table.
ROW_BYTES = 96


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def kmers(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the k-mers of all texts in order, k-mers of each text, word codes, words of each text)."""
    distinct, codes, counts = coded_words(texts, lower=True)
    hashes = np.append(hash_words(distinct), np.uint64(1))
    padded = np.maximum(counts, words)
    starts = np.cumsum(padded) - padded
    flat = np.full(int(padded.sum()), len(distinct), np.int64)
    flat[gathered(starts, counts)] = codes
    h = mixed(hashes)[flat]
    windows = padded - words + 1
    rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for j in range(words):
        rolled = rolled * np.uint64(0x100000001B3) + h[j : len(h) - words + 1 + j]
    return mixed(rolled[gathered(starts, windows)]), windows, codes, counts


def labelled(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes of k-mers with their occurrence numbers."""
    order = np.lexsort((h, text))
    sh, st = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (st[1:] != st[:-1])
    at = np.arange(len(h))
    number = np.zeros(len(h), np.uint64)
    number[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return np.where(number > 0, mixed(h + number * np.uint64(0xD6E8FEB86659FD93)), h)


def ordered_sketch(h: np.ndarray, text: np.ndarray, windows: np.ndarray, cut: np.ndarray, seed: int) -> np.ndarray:
    """One key for each text: hash of the CHOSEN least k-mers in text order. `cut` is the greatest hash of each k-mer that needs a look."""
    v = (h ^ np.uint64((seed + 1) * 0xA0761D6478BD642F % 2**64)) * np.uint64((2 * seed + 3) * 0x9E3779B97F4A7C15 % 2**64 | 1)
    at = np.flatnonzero(v <= cut)
    short = np.bincount(text[at], minlength=len(windows)) < np.minimum(windows, CHOSEN)
    if short.any():
        at = np.flatnonzero((v <= cut) | short[text])
    at = at[np.lexsort((v[at], text[at]))]
    own = text[at]
    first = np.searchsorted(own, own)
    at = at[np.arange(len(at)) - first < CHOSEN]
    at.sort()  # back in text order, as texts follow one another
    own = text[at]
    starts = np.searchsorted(own, np.arange(len(windows)))
    rank = (np.arange(len(at)) - starts[own]).astype(np.uint64)
    return mixed(np.add.reduceat(mixed(mixed(h[at]) ^ (rank + np.uint64(1)) * np.uint64(0x8EBC6AF09C88C6E3)), starts) + np.uint64(seed))


def sketches(texts: pa.Array) -> np.ndarray:
    """SKETCHES keys of each text."""
    h, windows, _, _ = kmers(texts)
    text = np.repeat(np.arange(len(windows)), windows)
    h = labelled(h, text)
    few = windows <= 2 * PASS
    cut = (PASS / np.maximum(windows, 2 * PASS) * 2.0**64).astype(np.uint64)
    cut[few] = np.uint64(2**64 - 1)
    cut = cut[text]
    return np.stack([ordered_sketch(h, text, windows, cut, s) for s in range(SKETCHES)], axis=1).view(np.int64)


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=1 << 20):
        keys = sketches(texts_of(batch))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), SKETCHES).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc_id", "digest", "keys"])


def edit_distance_within(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Edit distance of two sequences, or band + 1 if it is greater.

    Columns of the table are differences between rows, as bits of integers, for the 2 band + 1 rows about the diagonal; one column follows from the
    last by a few operations on whole integers. Equal beginnings and ends are left out first."""
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    begin = int(differ.argmax()) if differ.any() else n
    a, b, n = a[begin:], b[begin:], n - begin
    if n:
        differ = a[::-1][:n] != b[::-1][:n]
        end = int(differ.argmax()) if differ.any() else n
        a, b = a[: len(a) - end], b[: len(b) - end]
    n, m = len(a), len(b)
    if abs(n - m) > band:
        return band + 1
    if not n or not m:
        return max(n, m)
    band = min(band, max(n, m))
    places: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    width, out = 2 * band + 1, band + 1
    mask, top, end = (1 << width) - 1, 1 << (width - 1), band + n - m
    fewer = (1 << (band + 1)) - 1  # rows 0 and above: each has one more edit than the next
    more = mask ^ fewer
    edits = abs(n - m)
    for j, word in enumerate(b.tolist()):
        more, fewer = more >> 1 | top, fewer >> 1
        shift = j - band
        same = places.get(word, 0)
        same = (same >> shift if shift >= 0 else same << -shift) & mask
        same |= fewer
        diagonal = ((more + (same & more)) ^ more | same) & mask
        edits += 1 - (diagonal >> end & 1)
        if edits > band:
            return out
        left_more, left_fewer = fewer | mask & ~(more | diagonal), more & diagonal
        left_more = (left_more << 1 | 1) & mask
        fewer = left_more & diagonal
        more = (left_fewer << 1 | ~(left_more | diagonal)) & mask
    return edits


def word_sets(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each text: sorted hashes of its words labelled with their occurrence numbers, and the codes of its words in order."""
    distinct, codes, counts = coded_words(texts, lower=True)
    h = mixed(hash_words(distinct))[codes] if len(distinct) else np.zeros(0, np.uint64)
    h = labelled(h, np.repeat(np.arange(len(counts)), counts))
    ends = np.cumsum(counts)
    return [np.sort(h[e - n : e]) for e, n in zip(ends, counts)], [codes[e - n : e] for e, n in zip(ends, counts)]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the alignment of two texts' words finds an edit similarity of LIMIT."""
    band = int((1 - LIMIT) * max(len(a), len(b)) + 1e-9)
    return edit_distance_within(a, b, band) <= band


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Share of common words and the verdict of the alignment, for pairs of texts."""
    for batch in slices(batches, "body_b", 2 << 20):
        both = pa.concat_arrays([texts_of(batch, "body_a"), texts_of(batch, "body_b")])
        coded = both.dictionary_encode()  # a leader's text stands in many pairs
        sets, words = word_sets(coded.dictionary)
        which, n = coded.indices.to_numpy(), batch.num_rows
        similarity, same = np.zeros(n), np.zeros(n, bool)
        for k, (i, j) in enumerate(zip(which[:n].tolist(), which[n:].tolist())):
            longest = max(len(sets[i]), len(sets[j]))
            if min(len(sets[i]), len(sets[j])) >= LIMIT * longest - 1e-9 or longest == 0:
                similarity[k] = len(np.intersect1d(sets[i], sets[j], assume_unique=True)) / longest if longest else 1.0
                same[k] = similarity[k] >= LIMIT - 1e-9 and alike(words[i], words[j])
            else:
                similarity[k] = len(np.intersect1d(sets[i], sets[j], assume_unique=True)) / longest
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similarity), pa.array(same), batch.column(4)], names=["a", "b", "similarity", "same", "size"])


def labelled_words(texts: list[str]) -> tuple[list[np.ndarray], Callable[[int, int], bool]]:
    """Sorted labelled words of each text, and the verdict of the alignment on two of them."""
    sets, words = word_sets(pa.array(texts, pa.string()))
    return sets, lambda i, j: alike(words[i], words[j])


def aligned(a: str, b: str) -> bool:
    return labelled_words([a, b])[1](0, 1)


def with_digest(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("digest"), text.alias("text"))


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, class_id and component (a number of the class) of each row."""
    scratch = Scratch(docs.sparkSession, "near")
    read = with_digest(docs)
    rows = scratch.put(read.mapInArrow(sketched, "doc_id long, digest binary, keys array<long>"))
    nodes = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("keys").alias("keys")).withColumn("node", F.monotonically_increasing_id())
    nodes = scratch.put(nodes)
    keys = nodes.select("node", F.explode("keys").alias("key"))

    def bodies_of(some: DataFrame) -> DataFrame:
        some = scratch.put(nodes.select("node", "digest", "first_id").join(some, "node"))
        found = read.join(small_side(some, some.count() * ROW_BYTES), (read.digest == some.digest) & read.doc_id.eqNullSafe(some.first_id))
        found = scratch.put(found.select("node", F.col("text").alias("body")))
        times = found.groupBy("node").count().where("count > 1").limit(1).count()
        return scratch.put(found.dropDuplicates(["node"])) if times else found  # rows of equal id and text

    component = linked_components(keys, bodies_of, verified, labelled_words, of_larger, LIMIT, scratch, EARLY)
    named = nodes.select("digest", "node", "first_id").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = named.groupBy("component").agg(F.min("first_id").alias("class_id"))
    named = named.join(classes, "component").select("digest", "class_id", "component")
    out = written(rows.select("doc_id", "digest").join(named, "digest").select("doc_id", "digest", "class_id", "component"), "classes")
    scratch.drop_all()
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each class, of the class's own id; for a class without ids, one of its rows."""
    classes = near_duplicate_classes(unreserved(docs))
    own = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    heads = own.groupBy("component").agg(F.min("digest").alias("__d"), F.first("class_id").alias("__i"))
    times = own.groupBy(F.col("doc_id").alias("id"), F.col("digest").alias("d")).agg(F.count("*").alias("n"))
    heads = heads.join(times, F.col("__i").eqNullSafe(F.col("id")) & (F.col("__d") == F.col("d"))).select("__i", "__d", "n")
    heads = written(heads, "heads")
    size = heads.agg(F.count("*").alias("rows"), F.max("n").alias("n")).first()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = docs.join(small_side(heads.drop("n"), size["rows"] * ROW_BYTES), (F.unhex(F.md5(text)) == F.col("__d")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__i")))
    if (size["n"] or 0) > 1:  # rows of equal id and text
        kept = kept.dropDuplicates(["doc_id", "__d"])
    return kept.drop("__i", "__d")
