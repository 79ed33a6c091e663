"""What the two convolutional classifiers share: pooling, Adam, logistic loss, and a bounded labelled sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

#: Bounds of the labelled sample: rows of each class, and characters of a row. A longer text gives several rows, each a piece of it, which
#: together weigh as much as one text; so no text can crowd out others, and none is skipped or cut short.
SAMPLE_ROWS = 1500
PIECE_CHARS = 16_384


def pieces_of(chosen: dict[int, list[int]], told: dict[int, tuple[float, float]], chars: int):
    """The chosen pieces of each text, with label and weight; runs in tasks, so that whole long texts stay there."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [(i, k, text[k * chars : (k + 1) * chars], *told[i]) for i, text in zip(batch.column(0).to_pylist(), texts_of(batch).to_pylist()) for k in chosen[i]]
            found = [r for r in found if r[2] or r[1] == 0]  # rows of one id may differ in length
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64())
            columns = zip(*found) if found else ((),) * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["doc_id", "piece", "text", "y", "weight"])

    return cut


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int = SAMPLE_ROWS, chars: int = PIECE_CHARS) -> DataFrame | None:
    """doc_id, piece, text, y and weight of at most `rows` training rows of each class, those with the least hashes of (doc_id, piece); None without any.

    Weights of a class add up to its labelled texts, and those of a text's pieces are equal, so a text of many pieces counts once. Pieces
    are counted and drawn by ids and lengths alone, from all labelled training rows; only the drawn pieces' texts move. Of repeated rows of an id the least text counts."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & learn)
    ids = ids.groupBy("doc_id").agg(F.max("y").alias("y"))
    lengths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("size"))
    fit = lengths.groupBy("doc_id").agg(F.max("size").alias("size")).join(ids, "doc_id")
    fit = fit.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("size") / chars)).cast("long"))
    piece = fit.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    chosen: dict[int, list[int]] = {}
    told: dict[int, tuple[float, float]] = {}
    totals = {r["y"]: r["n"] for r in fit.groupBy("y").agg(F.count("*").alias("n")).collect()}
    for y in sorted(totals):
        drawn = piece.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", "piece"), "doc_id", "piece").limit(rows).select("doc_id", "piece", "pieces").collect()
        share = totals[y] / sum(1 / r["pieces"] for r in drawn)
        for r in drawn:
            chosen.setdefault(r["doc_id"], []).append(r["piece"])
            told[r["doc_id"]] = float(y), share / r["pieces"]
    if not chosen:
        return None
    texts = docs.where(F.col("doc_id").isin(list(chosen))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(pieces_of(chosen, told, chars), "doc_id long, piece long, text string, y double, weight double")
    return found.groupBy("doc_id", "piece", "y", "weight").agg(F.min("text").alias("text")).select("doc_id", "piece", "text", "y", "weight")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int = SAMPLE_ROWS, chars: int = PIECE_CHARS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and weights of `labelled_rows`, in an order that follows from the ids."""
    drawn = labelled_rows(docs, labels, label, learn, rows, chars)
    found = [] if drawn is None else sorted((tuple(r) for r in drawn.collect()), key=lambda r: (hash_order(r[0]), *r))
    return [r[2] for r in found], np.array([r[3] for r in found]), np.array([r[4] for r in found])


def hash_order(i: int) -> int:
    return (i * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64) // 7


def segment_max(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The greatest row values of each run of `lengths` >= 1 rows from `starts`, column by column."""
    edges = np.stack([starts, starts + lengths], axis=1).ravel()
    if edges[-1] == len(values):
        edges = edges[:-1]
    return np.maximum.reduceat(values, edges, axis=0)[::2]


def segment_argmax(values: np.ndarray, best: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each run and column, a row where the run's greatest value stands."""
    rows = np.arange(len(values), dtype=np.int64)[:, None]
    spread = np.full(values.shape, np.inf, values.dtype)
    where = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    spread[where] = np.repeat(best, lengths, axis=0)
    return segment_max(np.where(values == spread, rows, -1), starts, lengths)


class Adam:
    def __init__(self, parameters: dict[str, np.ndarray], rate: float = 0.01, decay: float = 0.0) -> None:
        self.p, self.rate, self.decay, self.t = parameters, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in parameters.items()}
        self.v = {k: np.zeros_like(v) for k, v in parameters.items()}

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in gradients.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            step = self.m[k] / (1 - 0.9**self.t) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-7)
            self.p[k] -= (self.rate * (step + self.decay * self.p[k])).astype(self.p[k].dtype)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def best_threshold(logits: np.ndarray, y: np.ndarray, weight: np.ndarray, fallback: float = 0.0, caution: float = 1.0) -> float:
    """The middle of the cuts of logits with the best balanced accuracy; `caution` weighs rows of label 0."""
    if min((y == 1).sum(), (y == 0).sum()) < 5:
        return fallback
    order = np.argsort(logits)
    x, up, down = logits[order], (y * weight)[order], ((1 - y) * weight)[order]
    return best_cut(x, up, down, caution)


def best_cut(x: np.ndarray, up: np.ndarray, down: np.ndarray, caution: float = 1.0) -> float:
    """The same of rising logits x with the weights of both labels."""
    below_up, below_down = np.concatenate([[0], np.cumsum(up)]), np.concatenate([[0], np.cumsum(down)])
    gain = (up.sum() - below_up) / up.sum() + caution * below_down / down.sum()
    good = np.flatnonzero(gain >= gain.max() - 1e-9)
    cut = int(good[len(good) // 2])
    low, high = x[max(0, cut - 1)], x[min(len(x) - 1, cut)]
    return float((low + high) / 2)
