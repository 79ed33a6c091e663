"""Importance resampling to a target distribution, by suffix arrays of word ids.

Words are runs of digits, letters a-z (A-Z lowered) and characters beyond ASCII. A document's features are all its runs of one to GRAMS words,
joined by a space, hashed to BUCKETS buckets by crc32. A bucket's gain compares its share in the target texts with its share in all documents;
a document's weight is the sum of its features' gains, and its score adds Gumbel noise from a hash of its id, so the best scores
are a draw without replacement in proportion to the importance weights.

In each task, slices of texts become a string of word ids, two zeros after each text. Its suffix array (to a depth of GRAMS) puts equal
n-grams side by side: where the common prefix with the suffix before has n words or more, the n-gram goes on, so each run is one n-gram.
A run is hashed once, from the checksums of its words, which combine without the text being joined, and its bucket is scattered back to the
places where the n-gram stands. The first pass sums the buckets' counts, a table of fixed size; the second sums gains by document.

Nulls: a null text has no words; a null id hashes as an empty one and comes last among equal scores. Empty texts have weight 0 and are never
drawn, as they are short of LEAST words. Very long texts are read whole, one at a time. Ties go to the smaller id. Repeated rows each
count and each take a rank. Empty tables give no rows, and without target texts all gains compare with an even share. Columns besides doc_id and
text play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import gathered
from .common import numbered, slices, texts_of, written
from .words import coded_words

BUCKETS, GRAMS = 10_000, 3
#: Documents of fewer words are not drawn; of the others this many in a hundred are.
LEAST, PERCENT = 20, 5
#: Bytes of text of a suffix array, or a single text.
SLICE = 8 << 20
#: Bits of a word id in a packed triple.
BITS = 21
#: The polynomial of crc32, bits reversed.
POLYNOMIAL = 0xEDB88320


@cache
def word_bytes() -> np.ndarray:
    """For each byte, itself within words (A-Z lowered) and a space elsewhere."""
    out = np.full(256, 32, np.uint8)
    for first, last in ((48, 57), (97, 122), (128, 255)):
        out[first : last + 1] = np.arange(first, last + 1)
    out[65:91] = np.arange(97, 123)
    return out


@cache
def zero_bytes(n: int) -> np.ndarray:
    """Tables (4, 256) of what 2^n zero bytes make of a checksum's remainder, by its bytes."""
    if n:
        half = zero_bytes(n - 1)
        return through(half, half)
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return np.stack([table] + [np.arange(256, dtype=np.uint32) << (8 * k - 8) for k in (1, 2, 3)])


def through(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = table[0][x & 255]
    for k in (1, 2, 3):
        out = out ^ table[k][(x >> (8 * k)) & 255]
    return out


def joined(before: np.ndarray, after: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of two strings put together, from those of each and the bytes of the second."""
    out = before.copy()
    for k in range(int(lengths.max(initial=0)).bit_length()):
        some = np.flatnonzero(lengths >> k & 1)
        out[some] = through(zero_bytes(k), out[some])
    return out ^ after


class Grams:
    """Buckets of all n-grams of a slice: for each n, the bucket of the n-gram that begins at each place, and where one does."""

    def __init__(self, texts: pa.Array) -> None:
        words, codes, self.counts = coded_words(texts, lookup=word_bytes())
        padded = self.counts + GRAMS - 1
        ends = np.cumsum(padded)
        self.starts = ends - padded
        ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        ids[gathered(self.starts, self.counts)] = codes + 1
        suffixes, prefix = suffix_array(ids)
        word = words.to_pylist()
        alone = np.array([0] + [zlib.crc32(w.encode()) for w in word], np.uint32)
        spaced = np.array([0] + [zlib.crc32(b" " + w.encode()) for w in word], np.uint32)
        lengths = np.append(0, pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1) if len(word) else np.zeros(1, np.int64)
        after = np.append(ids, np.zeros(GRAMS, np.int64))
        self.bucket, self.there, hashed, wider = [], [], None, None
        for n in range(1, GRAMS + 1):
            begins = np.flatnonzero(prefix < n)
            run = np.cumsum(prefix < n) - 1  # the number of each suffix's run
            heads = suffixes[begins]
            there = (ids > 0) & (after[n - 1 : n - 1 + len(ids)] > 0)  # the zeros after a text are as many as can stand between
            if n == 1:
                hashed = alone[after[heads]]
            else:
                last = after[heads + n - 1]
                hashed = joined(hashed[wider[begins]], spaced[last], np.where(last > 0, lengths[last], 0))
            wider = run
            scattered = np.zeros(len(ids), np.int32)
            scattered[suffixes] = (hashed % np.uint32(BUCKETS)).astype(np.int32)[run]
            self.bucket.append(scattered)
            self.there.append(there)

    def bucket_counts(self) -> np.ndarray:
        return sum(np.bincount(b[t], minlength=BUCKETS) for b, t in zip(self.bucket, self.there))

    def sums(self, gain: np.ndarray) -> np.ndarray:
        """Each text's sum of gains."""
        at = np.concatenate([[0], np.cumsum(sum(np.where(t, gain[b], 0) for b, t in zip(self.bucket, self.there)))])
        return at[self.starts + self.counts] - at[self.starts]

    def features(self) -> np.ndarray:
        return sum(np.maximum(0, self.counts - n) for n in range(GRAMS))


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the GRAMS ids from there on, and how many of these each has in common with the place before it."""
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = [np.append(ids[k:], np.zeros(k, np.int64)) for k in range(GRAMS)]
    if int(ids.max()) < 1 << BITS:
        packed = keys[0] << 2 * BITS | keys[1] << BITS | keys[2]
        order = np.argsort(packed, kind="stable")
    else:
        order = np.lexsort(keys[::-1])
    prefix, same = np.zeros(len(ids), np.int64), np.ones(len(ids) - 1, bool)
    for key in keys:
        own = key[order]
        same &= own[1:] == own[:-1]
        prefix[1:] += same
    return order, prefix


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in slices(batches, most=SLICE):
        total += Grams(texts_of(batch)).bucket_counts()
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Features in each bucket, over all texts: at most BUCKETS rows reach the driver."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    out = np.zeros(BUCKETS, np.int64)
    for r in texts.mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weigher(gain: np.ndarray):
    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            g = Grams(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(g.counts), pa.array(g.features()), pa.array(g.sums(gain))], names=["doc_id", "n_words", "n_features", "weight"])

    return weighed


def resampled(docs: DataFrame, target: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null where it is not drawn) of each row of docs."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weights = read.mapInArrow(weigher(gain), "doc_id long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = written(weights.withColumn("score", F.col("weight") + noise), "scored")
    long_enough = scored.where(F.col("n_words") >= LEAST)
    most = long_enough.count() * PERCENT // 100
    ranked = numbered(long_enough, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")], "rank")
    rank = F.when(F.col("rank") <= most, F.col("rank")).alias("rank")
    short = scored.where(F.col("n_words") < LEAST).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    return ranked.select(*columns, rank).unionByName(short.select(*columns, "rank"))
