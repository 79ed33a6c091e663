"""Toxicity by a convolutional text classifier, trained in numpy.

Words, in lower case and without punctuation at their ends, and their beginnings are hashed to rows of an embedding table; filters over one, two and three words slide
over the whole text; the greatest response of each filter feeds a logistic layer. A window's response is a sum of rows of small
tables (embedding times filter), so scoring looks tables up. It is fitted to all labelled training rows but every fifth by a hash: it begins where a fit to some of them
(convolution.SAMPLE_ROWS of each class) ends, then each task goes on with all rows of its part, and the parts' moves are averaged, each parameter's by the texts that moved it.
Which buckets speak is counted over all these texts. The fifth left out, all of it, sets the threshold of each language. The language is told from the text's own common words, never from a column, and
the threshold moves the score, so that 0.5 decides for every language. A language with fewer than five of those rows of either class takes the threshold of all.
How rows are dealt to tasks has a part in the model, as in every fit by averaged parts; equal files give equal scores.

Nulls: a null or empty text has the score of no words. Without labels of both classes every score is 0.5 below half (0.25).
Ties: rows of the sample with equal hashes come by id; equal responses share what is learnt or leave it to the last. Repeated rows each give a row, and are each learnt from, an empty table none; a text of any length is pooled whole. Columns besides doc_id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import gathered
from .common import bucket_of, slices, small_side, texts_of, written
from .convolution import PIECE_CHARS, SAMPLE_ROWS, Adam, best_cut, best_threshold, labelled_sample, segment_argmax, segment_max, sigmoid
from .divergence import COMMON_WORDS
from .words import coded_words, hash_words

BUCKETS, WIDTH, FILTERS, SIZES = 1 << 20, 12, 8, (1, 2, 3)
#: Buckets found in fewer of the learning texts stay silent: what one text alone says is noise.
LEAST_TEXTS = 4
#: Lengths of the words' beginnings that have embeddings of their own.
BEGINNINGS = (3, 4, 5, 6, 7)
PAD = 3
EPOCHS, BATCH = 14, 64
#: Places of a step over all rows at most, but for a single piece; its rate; and the unit in which moves are added up, whole numbers so that their order does not matter.
PLACES, RATE, UNIT = 200_000, 0.005, 2.0**-24
#: Logits are counted in bins of this width for the thresholds.
BIN = 1 / 64
DENSE = ("b", "o", "c", *(f"w{n}" for n in SIZES))
PUNCTUATION = ".,;:!?\"'()[]{}*#$%&|<>-"
LANGUAGES = sorted(COMMON_WORDS)


class Encoded:
    """Words of many texts, each text followed by PAD zeros; the embedding rows (or, without `rows`, buckets) of each distinct word, that
    is of the word itself and of its beginnings of several lengths; and how often each text has common words of each language."""

    def __init__(self, texts: pa.Array, rows: np.ndarray | None = None) -> None:
        words, codes, counts = coded_words(texts, lower=True)
        bare = pc.utf8_trim(words, characters=PUNCTUATION)
        parts = [bare] + [pc.if_else(pc.greater(pc.utf8_length(bare), n), pc.utf8_slice_codeunits(bare, 0, n), "") for n in BEGINNINGS]
        self.subs = np.zeros((len(words) + 1, len(parts)), np.int32)
        for k, part in enumerate(parts):
            coded = part.dictionary_encode()
            bucket = (hash_words(coded.dictionary, k) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
            bucket[pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False).astype(bool)] = 0
            self.subs[1:, k] = (bucket if rows is None else rows[bucket])[coded.indices.to_numpy()]
        self.counts, self.starts = counts, np.cumsum(counts + PAD) - counts - PAD
        self.ids = np.zeros(int((counts + PAD).sum()), np.int32)
        self.ids[gathered(self.starts, counts)] = codes + 1
        text = np.repeat(np.arange(len(counts)), counts)
        self.language = np.zeros((len(counts), len(LANGUAGES)))
        for k, code in enumerate(LANGUAGES):
            flags = pc.is_in(bare, pa.array(COMMON_WORDS[code])).to_numpy(zero_copy_only=False)
            self.language[:, k] = np.bincount(text, flags[codes].astype(np.float64), len(counts))

    def languages(self) -> np.ndarray:
        """The language with most common words; the number of languages where there are none."""
        return np.where(self.language.max(axis=1, initial=0) > 0, self.language.argmax(axis=1), len(LANGUAGES))


def initial(seed: int, words: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.standard_normal(s) * 0.25).astype(np.float32)
    return {"e": draw(words, WIDTH), "b": np.zeros(FILTERS * len(SIZES), np.float32), "o": draw(FILTERS * len(SIZES)), "c": np.zeros(1, np.float32)} | {f"w{n}": draw(n, WIDTH, FILTERS) for n in SIZES}


def tables(p: dict[str, np.ndarray]) -> list[list[np.ndarray]]:
    """For each size and place in the window: response of each embedding row; row 0 is silent."""
    out = [[p["e"] @ p[f"w{n}"][j] for j in range(n)] for n in SIZES]
    for places in out:
        for t in places:
            t[0] = 0
    return out


def by_word(looked: list[list[np.ndarray]], subs: np.ndarray) -> list[list[np.ndarray]]:
    """The same for words: sums over their embedding rows."""
    return [[sum(t[subs[:, k]] for k in range(subs.shape[1])) for t in places] for places in looked]


def responses(ids: np.ndarray, looked: list[list[np.ndarray]], bias: np.ndarray) -> np.ndarray:
    """Filter responses at each place of the padded ids."""
    out = np.zeros((len(ids), FILTERS * len(SIZES)), np.float32)
    for k, places in enumerate(looked):
        part = out[:, k * FILTERS : (k + 1) * FILTERS]
        for j, t in enumerate(places):
            part[: len(ids) - j] += t[ids[j:]]
    out += bias
    return np.maximum(out, 0, out=out)


def logits_of(e: Encoded, p: dict[str, np.ndarray], looked: list[list[np.ndarray]], most: int = 400_000) -> np.ndarray:
    """Logit of each text; long texts go through in overlapping runs of `most` places, whose maxima are joined."""
    looked = by_word(looked, e.subs)
    out, at, n = np.zeros(len(e.counts)), 0, len(e.counts)
    while at < n:
        to = max(at + 1, int(np.searchsorted(e.starts, e.starts[at] + most)))
        begin = int(e.starts[at])
        end = int(e.starts[to - 1] + e.counts[to - 1] + PAD)
        if to == at + 1 and end - begin > 2 * most:
            pooled = np.max([responses(e.ids[x : min(end, x + most + PAD)], looked, p["b"])[:most].max(axis=0) for x in range(begin, end - 2, most)], axis=0)[None]
        else:
            pooled = segment_max(responses(e.ids[begin:end], looked, p["b"]), e.starts[at:to] - begin, e.counts[at:to] + 1)
        out[at:to] = pooled @ p["o"] + p["c"][0]
        at = to
    return out


def bucket_texts(e: Encoded) -> np.ndarray:
    """In how many texts each bucket is found; the silent one counts none."""
    text = np.repeat(np.arange(len(e.counts)), e.counts)
    pairs = np.unique(text * np.int64(len(e.subs)) + e.ids[gathered(e.starts, e.counts)])
    text, subs = pairs // len(e.subs), e.subs[pairs % len(e.subs)].astype(np.int64)
    pairs = np.unique((text[:, None] * BUCKETS + subs).ravel())
    found = np.bincount(pairs % BUCKETS, minlength=BUCKETS)
    found[0] = 0
    return found


def active_rows(e: Encoded) -> np.ndarray:
    """For each bucket its row of the embedding table, 0 for those of fewer than LEAST_TEXTS texts."""
    often = np.flatnonzero(bucket_texts(e) >= LEAST_TEXTS)
    rows = np.zeros(BUCKETS, np.int32)
    rows[often] = np.arange(1, len(often) + 1)
    return rows


def gradients(p: dict[str, np.ndarray], e: Encoded, some: np.ndarray, y: np.ndarray, balance: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The embedding rows that the texts `some` use, and the gradients of their loss, of the embeddings for these rows alone."""
    lengths = e.counts[some] + PAD
    ids = e.ids[gathered(e.starts[some], lengths)]
    starts = np.cumsum(lengths) - lengths
    distinct, ids = np.unique(ids, return_inverse=True)
    used = np.unique(np.append(e.subs[distinct].ravel(), 0))  # row 0 stays the silent one
    subs, p = np.searchsorted(used, e.subs[distinct]), p | {"e": p["e"][used]}
    values = responses(ids, by_word(tables(p), subs), p["b"])
    pooled = segment_max(values, starts, e.counts[some] + 1)
    where = segment_argmax(values, pooled, starts, e.counts[some] + 1)
    error = (sigmoid(pooled @ p["o"] + p["c"][0]) - y[some]) * balance[some]
    error = (error / balance[some].sum()).astype(np.float32)
    back = np.where(pooled > 0, error[:, None] * p["o"][None], 0)
    g = {"o": pooled.T @ error + 0.0005 * p["o"], "c": np.array([error.sum()], np.float32), "b": back.sum(axis=0)}
    ge = np.zeros_like(p["e"])
    for k, n in enumerate(SIZES):
        w, own = np.zeros_like(p[f"w{n}"]), slice(k * FILTERS, (k + 1) * FILTERS)
        for j in range(n):
            rows_at = subs[ids[np.minimum(where[:, own] + j, len(ids) - 1)]]
            x = np.where((rows_at > 0)[..., None], p["e"][rows_at], 0).sum(axis=2)
            w[j] = np.einsum("rfd,rf->df", x, back[:, own])
            down = back[:, own][..., None] * p[f"w{n}"][j].T[None]
            for k in range(subs.shape[1]):
                np.add.at(ge, rows_at[..., k].ravel(), down.reshape(-1, WIDTH))
        g[f"w{n}"] = w
    ge[0] = 0
    return used, g | {"e": ge}


def trained(texts: list[str], y: np.ndarray, weight: np.ndarray, seed: int = 7) -> dict:
    """Parameters, and the thresholds of languages from every fifth row."""
    if len(y) < 10 or y.min() == y.max():
        p = initial(seed, 1)
        p["o"][:], p["c"][0] = 0, -1.0986
        return {"p": p, "rows": np.zeros(BUCKETS, np.int32), "thresholds": np.zeros(len(LANGUAGES) + 1)}
    rows = np.arange(len(y))
    learn = rows[rows % 5 != 0]
    active = active_rows(Encoded(pa.array([texts[i] for i in learn], pa.string())))
    e = Encoded(pa.array(texts, pa.string()), active)
    p = initial(seed, int(active.max()) + 1)
    rng, adam = np.random.default_rng(seed), Adam(p, 0.01, 0.002)
    balance = weight * np.where(y == 1, 0.5 / max(1e-9, weight[learn][y[learn] == 1].sum()), 0.5 / max(1e-9, weight[learn][y[learn] == 0].sum()))
    for epoch in range(EPOCHS):
        adam.rate = 0.01 * (1 - epoch / EPOCHS)
        order = rng.permutation(learn)
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            own, g = gradients(p, e, some, y, balance)
            ge = np.zeros_like(p["e"])
            ge[own] = g["e"]
            adam.step(g | {"e": ge})
    held = rows[rows % 5 == 0]
    logits, languages = logits_of(e, p, tables(p)), e.languages()
    overall = best_threshold(logits[held], y[held], weight[held], caution=2.0)
    return {"p": p, "rows": active, "thresholds": np.array([best_threshold(logits[own], y[own], weight[own], overall, caution=2.0) for own in (held[languages[held] == k] for k in range(len(LANGUAGES) + 1))])}


def in_pieces(texts: list[str], y: np.ndarray, chars: int = PIECE_CHARS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All pieces of the texts, with label and weight; those of a text weigh as much as one text."""
    cut = [[t[at : at + chars] for at in range(0, max(1, len(t)), chars)] for t in texts]
    n = np.array([len(c) for c in cut], np.int64)
    return [piece for c in cut for piece in c], np.repeat(y, n), np.repeat(1 / np.maximum(n, 1), n)


def moved(model: dict, totals: np.ndarray):
    """Steps over all rows (text, y) of a part, from `model`; what each embedding row, by bucket, and each other parameter moved, times the pieces that moved it: rows of
    WIDTH numbers, of n pieces, the other parameters below bucket 0. `totals` are the rows of both classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = {k: v.copy() for k, v in model["p"].items()}
        p["e"] = np.zeros((BUCKETS, WIDTH), np.float32)
        active = np.flatnonzero(model["rows"])
        p["e"][active] = model["p"]["e"][model["rows"][active]]
        seen, squares, dense, n = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.float32), {k: np.zeros_like(p[k]) for k in DENSE}, 0
        for batch in slices(batches, most=4 << 20):
            texts, y, weight = in_pieces(texts_of(batch).to_pylist(), batch.column(1).to_numpy())
            balance, e = weight * 0.5 / totals[y], Encoded(pa.array(texts, pa.string()))
            seen += bucket_texts(e)
            n += len(texts)
            ends, at = np.cumsum(e.counts + PAD), 0
            while at < len(texts):
                to = max(at + 1, min(at + BATCH, int(np.searchsorted(ends, ends[at] - e.counts[at] - PAD + PLACES, side="right"))))
                own, g = gradients(p, e, np.arange(at, to), y, balance)
                squares[own] += (g["e"] ** 2).mean(axis=1)
                p["e"][own] -= RATE * g["e"] / (np.sqrt(squares[own]) + 1e-7)[:, None]
                for k in DENSE:
                    dense[k] += g[k] ** 2
                    p[k] -= RATE * g[k] / (np.sqrt(dense[k]) + 1e-7)
                at = to
        if not n:
            return
        used = np.flatnonzero(seen)
        move = p["e"][used].astype(np.float64)
        known = model["rows"][used]
        move -= np.where(known[:, None] > 0, model["p"]["e"][known], 0)
        other = flat(p) - flat(model["p"])
        keys, times = np.concatenate([used, -1 - np.arange(len(other))]), np.concatenate([seen[used], np.full(len(other), n)])
        moves = np.rint(np.concatenate([move, other]) * times[:, None] / UNIT).astype(np.int64)
        for at in range(0, len(keys), 1 << 16):
            own = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(keys[own]), pa.array(times[own]), *(pa.array(moves[own, j]) for j in range(WIDTH))], names=["bucket", "n", *MOVES])

    return run


MOVES = [f"m{j}" for j in range(WIDTH)]


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    """All parameters but the embeddings as rows of WIDTH numbers."""
    values = np.concatenate([p[k].ravel() for k in DENSE]).astype(np.float64)
    return np.append(values, np.zeros(-len(values) % WIDTH)).reshape(-1, WIDTH)


def fitted(model: dict, rows: DataFrame, totals: np.ndarray) -> dict:
    """The model after all rows (text, y): parts move on their own, moves are averaged. The driver gets a row for each bucket that speaks, BUCKETS at most."""
    parts = rows.mapInArrow(moved(model, totals), f"bucket long, n long, {', '.join(f'{m} long' for m in MOVES)}")
    means = [(F.sum(m) / F.sum("n") * UNIT).cast("float").alias(m) for m in MOVES]
    found = parts.groupBy("bucket").agg(F.sum("n").alias("n"), *means).where((F.col("bucket") < 0) | (F.col("n") >= LEAST_TEXTS)).drop("n").toArrow().sort_by("bucket")
    bucket, move = found.column("bucket").to_numpy(), np.stack([found.column(m).to_numpy() for m in MOVES], axis=1)
    values, p, at = (flat(model["p"]) + move[bucket < 0][::-1]).ravel(), {}, 0
    for k in DENSE:
        shape = model["p"][k].shape
        p[k] = values[at : at + int(np.prod(shape))].reshape(shape).astype(np.float32)
        at += int(np.prod(shape))
    speaks = bucket[bucket >= 0]
    known, rows_of = model["rows"][speaks], np.zeros(BUCKETS, np.int32)
    rows_of[speaks] = np.arange(1, len(speaks) + 1)
    e = move[bucket >= 0] + np.where(known[:, None] > 0, model["p"]["e"][known], 0)
    return model | {"p": p | {"e": np.concatenate([np.zeros((1, WIDTH)), e]).astype(np.float32)}, "rows": rows_of}


def thresholds(told: DataFrame, fallback: np.ndarray) -> np.ndarray:
    """Of each language, and of texts without one, the threshold by all rows (logit, language, y), counted in bins."""
    counts = told.groupBy("language", F.round(F.col("logit") / BIN).cast("long").alias("bin")).agg(F.sum("y").alias("up"), F.sum(1 - F.col("y")).alias("down")).toArrow().sort_by("bin")
    language, at, up, down = (counts.column(c).to_numpy() for c in ("language", "bin", "up", "down"))

    def cut(own: np.ndarray, otherwise: float) -> float:
        x, where = np.unique(at[own], return_inverse=True)
        ups, downs = np.bincount(where, up[own], len(x)), np.bincount(where, down[own], len(x))
        return otherwise if min(ups.sum(), downs.sum()) < 5 else best_cut(x * BIN, ups, downs, caution=2.0)

    every = np.ones(len(at), bool)
    return np.array([cut(language == k, cut(every, fallback[k])) for k in range(len(LANGUAGES) + 1)])


def scorer(model: dict):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=8 << 20):
            e = Encoded(texts_of(batch), model["rows"])
            used = np.unique(np.append(e.subs.ravel(), 0))  # tables of the rows that these words need
            e.subs = np.searchsorted(used, e.subs)
            logit = logits_of(e, model["p"], tables(model["p"] | {"e": model["p"]["e"][used]}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(logit), pa.array(e.languages().astype(np.int32))], names=["doc_id", "logit", "language"])

    return scored


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out (crc32 of the id modulo 5 is 0; labels are learnt from other rows only), score and predicted."""
    fifth = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(5)) == 0  # of the learning rows, for the thresholds
    learn = bucket_of("doc_id", 5) > 0
    texts, y, weight = labelled_sample(docs, labels, "toxic", learn & ~fifth, sample)
    model = trained(texts, y, weight)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where(F.col("y").isin(0, 1) & learn).groupBy("doc_id").agg(F.max("y").alias("y"))
    kinds = {(r["fifth"], r["y"]): r["n"] for r in ids.groupBy(fifth.alias("fifth"), "y").agg(F.count("*").alias("n")).collect()}
    size = sum(kinds.values()) * 32
    both = (len(y) >= 10) and y.min() != y.max()
    if both:
        known = read.where(learn & ~fifth).join(small_side(ids.where(~fifth), size), "doc_id")
        model = fitted(model, known.select("text", "y"), np.array([kinds[False, 0], kinds[False, 1]], np.float64))
    scored = written(read.mapInArrow(scorer(model), "doc_id long, logit double, language int"), "logits")
    cuts = thresholds(scored.join(small_side(ids.where(fifth), size), "doc_id"), model["thresholds"]) if both else model["thresholds"]
    score = 1 / (1 + F.exp(F.get(F.array(*map(F.lit, cuts.tolist())), F.col("language")) - F.col("logit")))
    out = scored.select("doc_id", score.alias("score"))
    return out.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
