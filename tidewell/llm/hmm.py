"""Hidden Markov language model: Baum-Welch counts summed across partitions, exact likelihood by the scaled forward recursion.

Tokens are words in lower case (A-Z only) and one end for each text. The base score is an add-half unigram model of the training texts.
The hidden Markov model has STATES states over the CLASSES most frequent training words, the end, and one class of all other words, known or
not; within that class a word has its base probability divided by the class's. So the model's tables have a fixed size, while
counts of all words stay in a distributed table, and the probability of every word is defined.

Training: every round reads all training texts. Each partition adds up expected
transition and emission counts over its sequences (texts, in segments of SEGMENT tokens; a segment that continues a text starts from the
continuing-state distribution, which is learnt too), and Spark sums them by word. Emissions are smoothed towards the base. The scores
are exact: the forward recursion runs over each whole text, without segments.

Ties: of words of equal count the first by code points stay in the classes. Nulls: a null text is empty and has the end alone; a null id is held out of neither side and trains. Repeated rows count each time. An empty table
gives no rows; without training texts every word is unknown. Columns besides doc_id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import gathered
from .common import bucket_of, slices, texts_of, written
from .words import coded_words

STATES, CLASSES, SEGMENT = 16, 60_000, 512
#: Rounds of Baum-Welch at most, and the gain of a round, in the log likelihood of a token, under which it is the last.
ROUNDS, GAIN = 6, 1e-4
#: Partitions of the texts whose expected counts one task of a round adds up before they are shuffled.
GATHER = 8
SMOOTH = 4.0
#: How much likelier the first model's states stay than go elsewhere. States that hardly stay take a dozen rounds to part from one another.
STAY = 30.0
CODED = "doc_id long, held_out boolean, n_tokens long, ids binary, top_known long, top_score double, rare array<string>, rare_times array<int>"


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the training texts; the end is counted apart."""
    lower = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.where(bucket_of("doc_id", 5) != 1).select(F.explode(F.split(lower, r"[\x20\x09-\x0D]+")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count("*").alias("c"))


class Vocabulary:
    """The CLASSES most frequent words with their counts; numbers: the words, then the end, then all other words."""

    def __init__(self, words: list[str], counts: np.ndarray, ends: int, tokens: int, types: int) -> None:
        self.words, self.counts, self.ends, self.tokens, self.types = words, counts, ends, tokens, types
        self.end, self.other, self.size = len(words), len(words) + 1, len(words) + 2
        self.below = tokens + 0.5 * (types + 1)
        base = np.append(counts, ends) + 0.5
        self.base = np.append(base, max(self.below - base.sum(), 0.5)) / self.below

    def log_base(self, c):
        return np.log10((c + 0.5) / self.below)


def encoder(v: Vocabulary):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs = pa.array(v.words, pa.string()), v.log_base(v.counts)
        end_log = float(v.log_base(v.ends))
        for batch in slices(batches, most=8 << 20):
            distinct, codes, counts = coded_words(texts_of(batch), lower=True)
            number = pc.fill_null(pc.index_in(distinct, known), -1).to_numpy().astype(np.int64) if len(v.words) else np.full(len(distinct), -1)
            ids, n = number[codes], len(counts)
            text = np.repeat(np.arange(n), counts)
            top = ids >= 0
            score = np.bincount(text[top], logs[ids[top]], n) + end_log if top.any() else np.full(n, end_log)
            pairs, times = np.unique(text[~top] * np.int64(max(1, len(distinct))) + codes[~top], return_counts=True)
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs // max(1, len(distinct)), np.arange(n + 1)).astype(np.int32)), distinct.take(pa.array(pairs % max(1, len(distinct)))))
            rare_times = pa.ListArray.from_arrays(rare.offsets, pa.array(times.astype(np.int32)))
            out = np.full(int(counts.sum()) + n, v.end, np.uint16)
            ends = np.cumsum(counts + 1)
            out[gathered(ends - counts - 1, counts)] = np.where(top, ids, v.other)
            binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate([[0], 2 * ends]).astype(np.int32)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts + 1), binary, pa.array(np.bincount(text[top], minlength=n) + (v.ends > 0)), pa.array(score), rare, rare_times], names=[c.split()[0] for c in CODED.split(", ")])

    return encoded


class Model:
    """start, continued: initial state distributions; a: transitions; b: emissions, one row a word."""

    def __init__(self, start, continued, a, b) -> None:
        self.start, self.continued, self.a, self.b = (x.astype(np.float32) for x in (start, continued, a, b))


def first_model(v: Vocabulary, seed: int = 5) -> Model:
    """Each word leans to one state at random; states tend to stay."""
    rng = np.random.default_rng(seed)
    lean = np.full((v.size, STATES), 0.3)
    lean[np.arange(v.size), rng.integers(STATES, size=v.size)] += 3.0
    b = lean * v.base[:, None]
    a = np.full((STATES, STATES), 1.0) + rng.random((STATES, STATES)) + STAY * np.eye(STATES)
    even = np.full(STATES, 1 / STATES)
    return Model(even, even, a / a.sum(axis=1, keepdims=True), b / b.sum(axis=0))


def expected_counts(m: Model, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Sums over sequences of initial, continuing, transition and (per token) state posteriors, and of log likelihoods; sequences ordered by length, longest first."""
    n, longest = len(starts), int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # sequences longer than t
    alphas, scales = [], []
    alpha = np.where(first[:, None], m.start, m.continued)
    for t in range(longest):
        k = active[t]
        alpha = (alpha[:k] if t == 0 else alpha[:k] @ m.a) * m.b[flat[starts[:k] + t]]
        scale = alpha.sum(axis=1, keepdims=True) + np.float32(1e-30)
        alpha = alpha / scale
        alphas.append(alpha)
        scales.append(scale)
    likelihood = float(sum(np.log(s, dtype=np.float64).sum() for s in scales))
    moves = np.zeros((STATES, STATES))
    posterior = np.zeros((len(flat), STATES), np.float32)
    beta = np.zeros((0, STATES), np.float32)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        if t == longest - 1:
            beta = np.ones((k, STATES), np.float32)
        else:
            later = active[t + 1]
            ahead = m.b[flat[starts[:later] + t + 1]] * beta / scales[t + 1]
            moves += alphas[t][:later].T @ ahead
            beta = np.concatenate([ahead @ m.a.T, np.ones((k - later, STATES), np.float32)])
        gamma = alphas[t] * beta
        posterior[starts[:k] + t] = gamma / (gamma.sum(axis=1, keepdims=True) + np.float32(1e-30))
    opening = posterior[starts]
    return opening[first].sum(axis=0), opening[~first].sum(axis=0), moves * m.a, posterior, flat, likelihood


def counter(m: Model, v: Vocabulary):
    """One pass of expected counts over a partition: rows of (word, state counts); word -1-i is transition row i, -100 and -101 the openings, -102 has the
    log likelihood and the tokens."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit = np.zeros((v.size, STATES))
        moves, start, continued, told = np.zeros((STATES, STATES)), np.zeros(STATES), np.zeros(STATES), np.zeros(STATES)
        for batch in slices(batches, "ids", 2 << 20):
            column = batch.column(0)
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 2
            flat = np.frombuffer(column.buffers()[2], np.uint16)[offsets[0] : offsets[-1]]
            total = np.diff(offsets)
            pieces = -(-total // SEGMENT)
            row = np.repeat(np.arange(len(total)), pieces)
            part = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts = (offsets[:-1] - offsets[0])[row] + part * SEGMENT
            lengths = np.minimum(SEGMENT, total[row] - part * SEGMENT)
            order = np.argsort(-lengths, kind="stable")
            for at in range(0, len(order), 1024):
                some = order[at : at + 1024]
                own = np.cumsum(lengths[some]) - lengths[some]
                tokens = flat[gathered(starts[some], lengths[some])]
                s, c, t, posterior, ids, likelihood = expected_counts(m, tokens, own, lengths[some], part[some] == 0)
                told[:2] += likelihood, len(tokens)
                start += s
                continued += c
                moves += t
                for k in range(STATES):
                    emit[:, k] += np.bincount(ids, posterior[:, k], v.size)
        seen = np.flatnonzero(emit.any(axis=1))
        words = np.concatenate([seen, -1 - np.arange(STATES), [-100, -101, -102]]).astype(np.int64)
        values = np.concatenate([emit[seen], moves, start[None], continued[None], told[None]])
        yield pa.RecordBatch.from_arrays([pa.array(words), *[pa.array(values[:, k].astype(np.float32)) for k in range(STATES)]], names=["word", *[f"s{k}" for k in range(STATES)]])

    return counted


def next_model(m: Model, v: Vocabulary, training: DataFrame) -> tuple[Model, float]:
    """One round of Baum-Welch over the training texts, and the log likelihood of a token under the model before it."""
    rows = training.mapInArrow(counter(m, v), "word long, " + ", ".join(f"s{k} float" for k in range(STATES)))
    summed = rows.groupBy("word").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(STATES)])
    got = np.array([list(r) for r in summed.collect()]).reshape(-1, STATES + 1)  # a row a word of the bounded vocabulary
    words, values = got[:, 0].astype(int), got[:, 1:]
    emit, moves, start, continued, told = np.zeros((v.size, STATES)), np.zeros((STATES, STATES)), np.zeros(STATES), np.zeros(STATES), np.zeros(2)
    emit[words[words >= 0]] = values[words >= 0]
    for word, value in zip(words, values):
        if word == -100:
            start += value
        elif word == -101:
            continued += value
        elif word == -102:
            told += value[:2]
        elif word < 0:
            moves[-1 - word] += value
    moves += 0.1
    emit += SMOOTH * v.base[:, None] * STATES
    begun = [x + 0.1 for x in (start, continued)]
    return Model(*[x / x.sum() for x in begun], moves / moves.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)), told[0] / max(1.0, told[1])


def trained(v: Vocabulary, training: DataFrame, rounds: int = ROUNDS, gain: float = GAIN) -> tuple[Model, list[float]]:
    """The model after at most `rounds` rounds, fewer once a round gains less than `gain` a token; and the log likelihood of a token before each round."""
    m, told = first_model(v), []
    for _ in range(rounds):
        m, likelihood = next_model(m, v, training)
        told.append(likelihood)
        if len(told) > 1 and told[-1] - told[-2] < gain:
            break
    return m, told


def forward(m: Model, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of each whole sequence, by the scaled forward recursion; longest first."""
    a, b = m.a.astype(np.float64), m.b.astype(np.float64)
    out, longest = np.zeros(len(starts)), int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")
    alpha, log = np.broadcast_to(m.start.astype(np.float64), (len(starts), STATES)), np.ones(len(starts))
    for t in range(longest):
        k = active[t]
        alpha = (alpha[:k] if t == 0 else alpha[:k] @ a) * b[flat[starts[:k] + t]]
        scale = alpha.sum(axis=1)
        alpha = alpha / scale[:, None]
        log[:k] *= scale
        if t % 16 == 15 or t == longest - 1 or active[t + 1] < k:
            out[:k] += np.log10(log[:k])
            log[:k] = 1
    return out


def scorer(m: Model):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids", 16 << 20):
            column = batch.column(1)
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 2
            flat = np.frombuffer(column.buffers()[2], np.uint16)[offsets[0] : offsets[-1]]
            lengths, order = np.diff(offsets), np.argsort(-np.diff(offsets), kind="stable")
            score = np.zeros(len(lengths))
            score[order] = forward(m, flat, (offsets[:-1] - offsets[0])[order], lengths[order])
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(score)], names=["row", *batch.schema.names[2:], "class_score"])

    return scored


def score_texts(docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    counts = written(word_counts(docs), "words")
    ends = docs.where(bucket_of("doc_id", 5) != 1).count()
    all_words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = [(r["word"], r["c"]) for r in counts.orderBy(F.desc("c"), "word").limit(classes).collect()]
    v = Vocabulary([w for w, _ in top], np.array([c for _, c in top], np.float64), ends, all_words["n"] + ends, all_words["v"] + (ends > 0))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (bucket_of("doc_id", 5) == 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    coded = read.mapInArrow(encoder(v), CODED).withColumn("row", F.monotonically_increasing_id())
    coded = written(coded, "coded")
    training = coded.where(~F.col("held_out")).select("ids")
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, training.rdd.getNumPartitions() // GATHER)
    training = training.coalesce(tasks)
    m, _ = trained(v, training, rounds)
    rare = coded.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.rare_times").alias("times"))
    scarce = counts.where(F.col("c") <= (int(top[-1][1]) if top else 0))  # words of the classes never come up in `rare`
    log = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / v.below)
    rare = rare.join(scarce, "word", "left").groupBy("row").agg(F.sum("times").alias("rare_n"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"), F.sum(F.col("times") * log).alias("rare_score"))
    whole = coded.select("row", "ids", "doc_id", "held_out", "n_tokens", "top_known", "top_score").mapInArrow(scorer(m), "row long, doc_id long, held_out boolean, n_tokens long, top_known long, top_score double, class_score double")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = whole.join(rare, "row", "left")
    within = zero("rare_score") - zero("rare_n") * float(np.log10(v.base[-1]))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("top_known") + zero("rare_known")).alias("n_known"), F.lit(int(v.tokens)).cast("long").alias("train_tokens"), (F.col("top_score") + zero("rare_score")).alias("base_score"), (F.col("class_score") + within).alias("score"))
