"""Quality by a byte-level convolutional network in numpy.

The UTF-8 bytes of a whole document are cut into overlapping chunks. Learned filters over WINDOW bytes, every STRIDE bytes, respond by
sums of table rows (byte embedding times filter). In each chunk the greatest response of each filter is taken; the mean and the
greatest of these over the document's chunks feed a logistic layer, which gives one probability. The network is fitted on a bounded sample of labelled
training rows (convolution.SAMPLE_ROWS of each class); a fifth of it sets the shift by which 0.7 decides best.

Nulls: a null or empty text is one empty chunk. Without labels of both classes every score is 0.5. Ties: rows of the sample with equal hashes come by id; equal responses share what is learnt or leave it to the last. Repeated rows each give a row, an
empty table none; any length is covered whole. Columns besides doc_id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import gathered
from .common import bucket_of, slices, texts_of
from .convolution import Adam, best_threshold, labelled_sample, sigmoid
from .words import buffers

CHUNK, OVERLAP, WINDOW, STRIDE = 512, 64, 6, 2
EMBEDDED, FILTERS = 8, 16
EPOCHS, BATCH = 12, 32
DECIDES = 0.7
STEP = CHUNK - OVERLAP


class Chunked:
    """Chunks of all texts as rows of CHUNK byte numbers (0 after the end), and how many each text has."""

    def __init__(self, texts: pa.Array) -> None:
        self.data, offsets = buffers(texts)
        self.offsets = offsets.astype(np.int64)
        lengths = np.diff(self.offsets)
        self.counts = np.maximum(1, -(-np.maximum(lengths - OVERLAP, 1) // STEP))
        self.first = np.cumsum(self.counts) - self.counts
        number = np.arange(int(self.counts.sum())) - np.repeat(self.first, self.counts)
        self.begin = np.repeat(self.offsets[:-1], self.counts) + STEP * number
        self.length = np.minimum(CHUNK, np.repeat(self.offsets[1:], self.counts) - self.begin)

    def rows(self, which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(which), CHUNK), np.int16)
        at = gathered(self.begin[which], self.length[which])
        out.ravel()[gathered(np.arange(len(which)) * CHUNK, self.length[which])] = self.data[at].astype(np.int16) + 1
        return out


def initial(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
    return {"e": draw(257, EMBEDDED), "w": draw(WINDOW, EMBEDDED, FILTERS), "b": np.zeros(FILTERS, np.float32), "o": draw(2 * FILTERS), "c": np.zeros(1, np.float32)}


def tables(p: dict[str, np.ndarray]) -> np.ndarray:
    out = np.einsum("vd,jdf->jvf", p["e"], p["w"]).astype(np.float32)
    out[:, 0] = 0
    return out


def responses(rows: np.ndarray, looked: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """(chunks, windows, filters), none below zero."""
    n = (CHUNK - WINDOW) // STRIDE + 1
    out = looked[0][rows[:, 0 : STRIDE * n : STRIDE]]
    for j in range(1, WINDOW):
        out += looked[j][rows[:, j : j + STRIDE * n : STRIDE]]
    out += bias
    return np.maximum(out, 0, out=out)


def chunk_maxima(c: Chunked, p: dict[str, np.ndarray], looked: np.ndarray, some: int = 256) -> np.ndarray:
    n = len(c.begin)
    return np.concatenate([responses(c.rows(np.arange(at, min(n, at + some))), looked, p["b"]).max(axis=1) for at in range(0, n, some)]) if n else np.zeros((0, FILTERS), np.float32)


def document_features(best: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.add.reduceat(best, first, axis=0) / counts[:, None], np.maximum.reduceat(best, first, axis=0)], axis=1)


def logits_of(c: Chunked, p: dict[str, np.ndarray]) -> np.ndarray:
    if not len(c.counts):
        return np.zeros(0)
    return document_features(chunk_maxima(c, p, tables(p)), c.first, c.counts) @ p["o"] + p["c"][0]


def trained(texts: list[str], y: np.ndarray, weight: np.ndarray, seed: int = 11) -> dict:
    p = initial(seed)
    if len(y) < 10 or y.min() == y.max():
        p["o"][:] = 0
        return {"p": p, "shift": 0.0}
    c = Chunked(pa.array(texts, pa.string()))
    rng, adam, rows = np.random.default_rng(seed), Adam(p, 0.01, 0.0005), np.arange(len(y))
    learn = rows[rows % 5 != 0]
    balance = weight * np.where(y == 1, 0.5 / max(1e-9, weight[learn][y[learn] == 1].sum()), 0.5 / max(1e-9, weight[learn][y[learn] == 0].sum()))
    for epoch in range(EPOCHS):
        adam.rate = 0.012 * (1 - epoch / EPOCHS)
        order = rng.permutation(learn)
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            counts = c.counts[some]
            first = np.cumsum(counts) - counts
            text = np.repeat(np.arange(len(some)), counts)
            chunk = c.rows(gathered(c.first[some], counts))
            values = responses(chunk, tables(p), p["b"])
            where, best = values.argmax(axis=1), values.max(axis=1)
            x = document_features(best, first, counts)
            error = (sigmoid(x @ p["o"] + p["c"][0]) - y[some]) * balance[some]
            error = (error / balance[some].sum()).astype(np.float32)
            mean_part, max_part = error[:, None] * p["o"][None, :FILTERS], error[:, None] * p["o"][None, FILTERS:]
            top = best == x[text, FILTERS:]
            back = mean_part[text] / counts[text][:, None] + np.where(top, max_part[text] / np.maximum(1, np.add.reduceat(top, first, axis=0))[text], 0)
            back = np.where(best > 0, back, 0).astype(np.float32)
            g = {"o": x.T @ error + 0.0005 * p["o"], "c": np.array([error.sum()], np.float32), "b": back.sum(axis=0)}
            ge, gw = np.zeros_like(p["e"]), np.zeros_like(p["w"])
            for j in range(WINDOW):
                byte = chunk[np.arange(len(chunk))[:, None], where * STRIDE + j]
                e = np.where((byte > 0)[..., None], p["e"][byte], 0)
                gw[j] = np.einsum("rfd,rf->df", e, back)
                np.add.at(ge, byte.ravel(), (back[..., None] * p["w"][j].T[None]).reshape(-1, EMBEDDED))
            ge[0] = 0
            adam.step(g | {"e": ge, "w": gw})
    held = rows[rows % 5 == 0]
    logits = logits_of(c, p)
    return {"p": p, "shift": float(np.log(DECIDES / (1 - DECIDES))) - best_threshold(logits[held], y[held], weight[held])}


def scorer(model: dict):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=8 << 20):
            score = sigmoid(logits_of(Chunked(texts_of(batch)), model["p"]) + model["shift"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return scored


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32 of the id modulo 4 is 2; labels are learnt from other rows only), score and predicted."""
    part = bucket_of("doc_id", 4)
    texts, y, weight = labelled_sample(docs, labels, "quality", (part >= 0) & (part != 2))
    model = trained(texts, y, weight)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = read.mapInArrow(scorer(model), "doc_id long, score double")
    return out.select("doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= DECIDES).cast("int").alias("predicted"))
