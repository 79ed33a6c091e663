"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features of a text are the n-grams of one to GRAMS letters of its words, in lower case, a word's beginning and end counting as a character; they are
hashed to buckets. Training adds up, in every task, how often each bucket stands in the training texts of each language, and Spark sums these
tables, which have a fixed size; every training text counts, whatever their number. The logarithms of the smoothed shares go to the tasks as one
matrix. Texts are scored in sparse batches: a batch's distinct words get their sums of logarithms once, and a text's score is the sum over
its words, each as often as it stands there.

A score is the posterior probability of the predicted language under the model, whose n-grams are taken as independent, so long texts come near 1.

The matrix is bounded: the number of buckets is BUCKETS, halved until the languages' matrix fits MATRIX_BYTES; more languages than fit with LEAST_BUCKETS are an
error. Nulls: a null text, or one without a letter, is `und` with score 0; texts with a null language, or a null id, train nothing. Without training texts
all are `und`. Ties go to the first language in order of code points. Very long texts are read whole. Repeated rows count and are
scored each; an empty table gives no rows. Columns besides doc_id, text and lang play no part, and lang none in a prediction.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, slices, texts_of
from .order_minhash import mixed
from .words import coded_words

GRAMS, BUCKETS, LEAST_BUCKETS = 3, 1 << 15, 1 << 10
#: Bytes of the matrix of logarithms at most.
MATRIX_BYTES = 64 << 20
#: Added to the count of every bucket of a language.
SMOOTH = 0.2
#: Bytes of text that a task scores at a time, or a single text.
SLICE = 2 << 20
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter or a mark that goes with one."""
    return np.frombuffer(bytes(unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)), np.uint8).astype(bool)


def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in lower case, and how many each has."""
    low = pc.utf8_lower(words)
    flat = np.frombuffer("".join(low.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat.astype(np.int64), pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64)


class WordGrams:
    """Bucketed n-grams of distinct words: pairs of a word's number and a bucket, and which words have a letter."""

    def __init__(self, words: pa.Array, buckets: int) -> None:
        flat, lengths = code_points(words)
        known = letters()[flat] if len(flat) else np.zeros(0, bool)
        padded = np.zeros(int((lengths + 2).sum()), np.int64)  # a zero before and after each word, and in place of what is no letter
        starts = np.cumsum(lengths + 2) - lengths - 2
        at = np.arange(len(flat)) + 2 * np.repeat(np.arange(len(lengths)), lengths) + 1
        padded[at] = np.where(known, flat, 0)
        word = np.repeat(np.arange(len(lengths)), lengths + 2)
        there = padded > 0
        self.has_letter = np.logical_or.reduceat(there, starts) if len(lengths) else np.zeros(0, bool)
        rows, columns = [], []
        for n in range(1, GRAMS + 1):
            m = len(padded) - n + 1
            if m <= 0:
                break
            inside = np.ones(m, bool)  # zeros at the ends alone
            for k in range(1, n - 1):
                inside &= there[k : k + m]
            any_letter = there[: m].copy()
            for k in range(1, n):
                any_letter |= there[k : k + m]
            inside &= any_letter & (word[:m] == word[n - 1 :])
            places = np.flatnonzero(inside)
            h = np.full(len(places), n, np.uint64)
            for k in range(n):
                h = mixed(h * np.uint64(0x100000001B3) + padded[places + k].astype(np.uint64))
            rows.append(word[places])
            columns.append((h % np.uint64(buckets)).astype(np.int64))
        self.row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.column = np.concatenate(columns) if columns else np.zeros(0, np.int64)


def counter(languages: list[str], buckets: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros((len(languages), buckets), np.int64), np.zeros(len(languages), np.int64)
        names = pa.array(languages, pa.string())
        for batch in slices(batches, most=SLICE):
            own = pc.index_in(batch.column(0), names).to_numpy(zero_copy_only=False).astype(np.int64)
            words, codes, counts = coded_words(texts_of(batch))
            g = WordGrams(words, buckets)
            language = np.repeat(own, counts)
            for k in range(len(languages)):
                times = np.bincount(codes[language == k], minlength=len(words))
                if times.any():
                    total[k] += np.bincount(g.column, times[g.row], buckets).astype(np.int64)
            texts += np.bincount(own, minlength=len(languages))
        row, column = np.nonzero(total)
        row, column, n = np.append(row, np.arange(len(languages))), np.append(column, np.full(len(languages), -1)), np.append(total[row, column], texts)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(column), pa.array(n)], names=["language", "bucket", "n"])

    return counted


class Model:
    """languages, in order of code points; logarithms of each language's share (prior) and of each bucket's share in a language (buckets x languages)."""

    def __init__(self, languages: list[str], prior: np.ndarray, logs: np.ndarray) -> None:
        self.languages, self.prior, self.logs = languages, prior, logs


def fitted(docs: DataFrame) -> Model:
    training = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), bucket_of("doc_id", 5).alias("part")).where("lang IS NOT NULL AND part > 0")
    most = MATRIX_BYTES // 4 // LEAST_BUCKETS
    languages = sorted(r["lang"] for r in training.select("lang").distinct().limit(most + 1).collect())
    if len(languages) > most:
        raise ValueError(f"more than {most} values of lang; their matrix is larger than {MATRIX_BYTES} bytes")
    buckets = BUCKETS
    while buckets * len(languages) * 4 > MATRIX_BYTES:
        buckets //= 2
    counts, texts = np.zeros((len(languages), buckets)), np.zeros(len(languages))
    if languages:
        rows = training.select("lang", "text").mapInArrow(counter(languages, buckets), "language long, bucket long, n long")
        got = rows.groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most a row a cell of the bounded matrix
        k, b, n = (got.column(i).to_numpy() for i in range(3))
        texts[k[b < 0]] = n[b < 0]
        counts[k[b >= 0], b[b >= 0]] = n[b >= 0]
    logs = np.log((counts + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * buckets))
    return Model(languages, np.log(np.maximum(texts, 1) / max(1, texts.sum())), np.ascontiguousarray(logs.T.astype(np.float32)))


def predictions(m: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of each text's language, -1 where it has no letter, and its posterior probability."""
    words, codes, counts = coded_words(texts)
    g = WordGrams(words, len(m.logs))
    by_word = np.stack([np.bincount(g.row, m.logs[g.column, k], len(words)) for k in range(len(m.languages))], axis=1) if len(words) else np.zeros((0, len(m.languages)))
    text = np.repeat(np.arange(len(counts)), counts)
    total = np.stack([np.bincount(text, by_word[codes, k], len(counts)) for k in range(len(m.languages))], axis=1) + m.prior
    there = np.bincount(text, g.has_letter[codes], len(counts)) > 0
    best = total.argmax(axis=1)
    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return np.where(there, best, -1), np.where(there, score, 0.0)


def scorer(m: Model):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*m.languages, UNKNOWN], pa.string())
        for batch in slices(batches, most=SLICE):
            best, score = predictions(m, texts_of(batch)) if m.languages else (np.full(batch.num_rows, -1), np.zeros(batch.num_rows))
            named = names.take(pa.array(np.where(best < 0, len(m.languages), best)))
            yield pa.RecordBatch.from_arrays([batch.column(0), named, pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return scored


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32 of the id modulo 5 is 0; the others train), lang_pred and score of each row."""
    m = fitted(docs)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = read.mapInArrow(scorer(m), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
