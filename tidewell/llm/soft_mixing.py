"""Mixing to target weights with soft memberships.

A classifier fitted on the labelled table gives each document a probability of each domain (clean, low quality, toxic). The expected
tokens of a domain are the sum over documents of rate x tokens x probability. Rates between 0 and MAX_RATE are fitted by projected-gradient least
squares: from 1, each step moves every rate against the gradient of the sum over domains of (total - target)^2 / target (for a target of 0, over
the domain's own tokens), and back into its bounds. The gradient of a document follows from its probabilities and one number a domain, so a step sends a few numbers to the tasks
and a few sums back; every REPLAY steps the rates are written and lineage ends.

The targets: weights say the proportions of the domains. The first domain keeps all its expected tokens, and the others get their proportions
of that; where one has less, its documents get rates above 1, that is, copies, MAX_RATE at most. Weights that no such rates meet (a domain that is
too scarce, in no text, or too mixed with others) end at the least squares: the result has targets and totals reached, and a warning names the domains.

A document's copies are the whole part of its rate, and one more for some: along the order of length and hash within each likeliest domain,
fractions are added up and a copy falls wherever the sum passes a whole number, counted from the beginning that brings the domain's tokens
nearest to the expected. So the copies' totals keep to the fit's, and no document is dropped or copied but by its rate.

Tokens are words here (runs between white space), one more for each text. The classifier is a softmax regression in numpy over hashed words and
a few character shares, fitted on a bounded sample of labelled rows (convolution.SAMPLE_ROWS a class of each label).

Nulls: a null or empty text has one token and the probabilities of no words. Very long texts are read whole. Ties: a document with both labels bad is
toxic; of equal probabilities the first domain is the likeliest. Without labelled rows all rates are 1. Repeated rows (equal id and text) have equal rates and
copies. An empty table gives no rows. Further columns are untouched; columns whose names begin with `__` are an error in `mixed_documents`.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, small_side, texts_of, unreserved, written
from .convolution import Adam, hash_order, labelled_rows
from .words import buffers, coded_words, hash_words

DOMAINS = ("clean", "low", "toxic")
#: Target weights of the domains.
WEIGHTS = {"clean": 0.90, "low": 0.05, "toxic": 0.05}
FEATURES = 1 << 18
SHARES = 8
EPOCHS = 8
#: Bytes of a row in the broadcast table of copies.
KEY_BYTES = 64
#: No document comes more often than this: beyond about four repetitions, copies teach a model little.
MAX_RATE = 4.0
#: Steps at most, of which the fit takes a few; the miss of a domain's target, as a share of it, that is close enough; and the gain of a step, as a
#: share of the loss, under which it is at its least.
STEPS, CLOSE, STILL = 80, 1e-3, 1e-4
#: Steps after which the rates are written.
REPLAY = 12
#: A step may raise the loss above the last one, but not above the greatest of so many.
LOOK_BACK = 4
#: A whole copy in the units that fractions are added up in, as integers.
UNIT = 1 << 30
#: Beginnings of the running sum that are tried, for the one whose copies come nearest to the expected tokens.
BEGINS = 32
#: A domain with less than this share of all tokens is in no text.
ABSENT = 1e-9


class Features:
    """Hashed distinct words of each text with log counts, and shares of character kinds and of distinct words."""

    def __init__(self, texts: pa.Array) -> None:
        words, codes, counts = coded_words(texts, lower=True)
        n = len(counts)
        bare = pc.utf8_trim(words, characters=".,;:!?\"'()[]{}*#$%&|<>-")
        bucket = (hash_words(bare) % np.uint64(FEATURES)).astype(np.int64)
        text = np.repeat(np.arange(n), counts)
        pairs, times = np.unique(text * np.int64(FEATURES) + bucket[codes], return_counts=True)
        self.tokens = counts + 1
        self.row, self.column = pairs // FEATURES, pairs % FEATURES
        self.value = (1 + np.log(times)) / np.sqrt(np.maximum(1, np.bincount(self.row, minlength=n)))[self.row]
        data, offsets = buffers(texts)
        starts, sizes = offsets[:-1].astype(np.int64), np.maximum(1, np.diff(offsets))
        upto = lambda flag: (lambda c: (c[offsets[1:]] - c[offsets[:-1]]) / sizes)(np.concatenate([[0], np.cumsum(flag)]))
        upper, symbol = (data >= 65) & (data <= 90), np.isin(data, np.frombuffer(b"#*$%&|<>!@^~=_", np.uint8))
        digit, space, high = (data >= 48) & (data <= 57), data == 32, data >= 128
        distinct = np.bincount(self.row, minlength=n) / np.maximum(1, counts)
        self.shares = np.stack([4 * upto(upper), 8 * upto(symbol), 4 * upto(digit), upto(space), upto(high), distinct * np.minimum(1, counts / 100), np.log1p(sizes) / 10, np.ones(len(starts))], axis=1)

    @classmethod
    def of_many(cls, texts: list[str], at_once: int = 256) -> Features:
        """The same, a few texts at a time, so that their words don't stand in memory together."""
        parts = [cls(pa.array(texts[at : at + at_once], pa.string())) for at in range(0, len(texts), at_once)]
        out = cls.__new__(cls)
        out.row = np.concatenate([f.row + at_once * k for k, f in enumerate(parts)])
        out.column, out.value, out.tokens, out.shares = (np.concatenate([getattr(f, c) for f in parts]) for c in ("column", "value", "tokens", "shares"))
        return out

    def logits(self, w: np.ndarray, dense: np.ndarray) -> np.ndarray:
        out = self.shares @ dense
        for d in range(out.shape[1]):
            out[:, d] += np.bincount(self.row, w[self.column, d] * self.value, len(out))
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fitted(texts: list[str], domain: np.ndarray, weight: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    w, dense = np.zeros((FEATURES, len(DOMAINS)), np.float32), np.zeros((SHARES, len(DOMAINS)), np.float32)
    if not len(texts):
        dense[-1, 0] = 100  # the constant feature: all is of the first domain
        return w, dense
    f = Features.of_many(texts)
    seen = np.bincount(f.column, minlength=FEATURES)
    active = np.unique(f.column[seen[f.column] >= 4])
    place = np.full(FEATURES, -1)
    place[active] = np.arange(len(active))
    use = place[f.column] >= 0
    p = {"w": np.zeros((len(active), len(DOMAINS))), "d": dense.astype(np.float64)}
    adam, rng, wish = Adam(p, 0.1, 0.0005), np.random.default_rng(seed), np.eye(len(DOMAINS))[domain]
    row, column, value = f.row[use], place[f.column[use]], f.value[use]
    part = rng.integers(8, size=len(domain))
    for epoch in range(EPOCHS):
        adam.rate = 0.1 * (1 - epoch / EPOCHS)
        for k in range(8):
            own = part[row] == k
            r, c, v = row[own], column[own], value[own]
            logits = f.shares @ p["d"]
            for d in range(len(DOMAINS)):
                logits[:, d] += np.bincount(r, p["w"][c, d] * v, len(logits))
            error = np.where(part == k, weight, 0)[:, None] * (softmax(logits) - wish) / max(1, (part == k).sum())
            g = np.stack([np.bincount(c, error[r, d] * v, len(active)) for d in range(len(DOMAINS))], axis=1)
            adam.step({"w": g, "d": f.shares.T @ error})
    w[active] = p["w"]
    return w, p["d"].astype(np.float32)


def membership(w: np.ndarray, dense: np.ndarray):
    active = np.flatnonzero(w.any(axis=1))
    values = w[active]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros((FEATURES, len(DOMAINS)), np.float32)
        whole[active] = values
        for batch in slices(batches, "__text", 8 << 20):
            f = Features(texts_of(batch, "__text"))
            p = softmax(f.logits(whole, dense))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(f.tokens.astype(np.float64)), *[pa.array(p[:, d]) for d in range(len(DOMAINS))]], names=["__id", "__doc", "n", *[f"p_{d}" for d in DOMAINS]])

    return scored


def domain_rows(docs: DataFrame, labels: DataFrame) -> DataFrame | None:
    """doc_id, piece, text, domain and weight of the bounded labelled sample: toxic before low before clean."""
    low = F.when((F.col("toxic") == 0) & (F.col("quality") == 0), 1).when((F.col("toxic") == 0) & (F.col("quality") == 1), 0)
    parts = []
    for name, rule in (("toxic", F.when(F.col("toxic") == 1, 1)), ("low", low)):
        rows = labelled_rows(docs, labels.select("doc_id", rule.alias("y")), "y", F.lit(True))
        if rows is not None:
            code = F.when(F.col("y") == 1, DOMAINS.index(name)).otherwise(DOMAINS.index("clean"))
            parts.append(rows.select("doc_id", "piece", "text", code.cast("long").alias("domain"), "weight"))
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0] if parts else None


FITTED = "row long, " + ", ".join(f"w_{d} double" for d in DOMAINS)


def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The classifier's weights that are not 0, by row of the table of words, then those of the dense features. One task has the whole sample."""
    rows = sorted((tuple(r.values()) for batch in batches for r in batch.to_pylist()), key=lambda r: (hash_order(r[0]), *r))
    order = np.random.default_rng(1).permutation(len(rows))
    weights = np.array([rows[i][4] for i in order])
    w, dense = fitted([rows[i][2] for i in order], np.array([rows[i][3] for i in order], int), weights / weights.mean() if len(rows) else weights)
    active = np.flatnonzero(w.any(axis=1))
    values = np.concatenate([w[active], dense]).astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([active, FEATURES + np.arange(SHARES)])), *[pa.array(values[:, d]) for d in range(len(DOMAINS))]], names=[c.split()[0] for c in FITTED.split(", ")])


def classifier(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weights of words and of dense features, fitted in one task, so that the driver holds no text."""
    rows = domain_rows(docs, labels)
    if rows is None:
        return fitted([], np.zeros(0, int), np.zeros(0))
    got = rows.repartition(1).mapInArrow(fitting, FITTED).toArrow()
    at, values = got.column("row").to_numpy(), np.stack([got.column(f"w_{d}").to_numpy() for d in DOMAINS], axis=1).astype(np.float32)
    w = np.zeros((FEATURES, len(DOMAINS)), np.float32)
    w[at[at < FEATURES]] = values[at < FEATURES]
    return w, values[at >= FEATURES][np.argsort(at[at >= FEATURES])]


def targets(supply: dict[str, float], weights: dict[str, float], n: float) -> dict[str, float]:
    """Totals in the proportions of the weights, at which the first domain of any weight keeps its own. A domain that no text has (less than ABSENT
    of all tokens) can't be had by any rates; it keeps what it has, and the others share the whole."""
    there = [d for d in DOMAINS if weights[d] > 0 and supply[d] > ABSENT * n]
    if not there:
        return dict(supply)
    whole = supply[there[0]] / weights[there[0]]
    return {d: weights[d] * whole if d in there or weights[d] <= 0 else supply[d] for d in DOMAINS}


def stepped(rate: Column, slope: Column) -> Column:
    """A rate after one step: against slope . p, back into 0 to MAX_RATE."""
    move = sum((slope[k] * F.col(f"p_{d}") for k, d in enumerate(DOMAINS)), F.lit(0.0))
    return F.least(F.lit(MAX_RATE), F.greatest(F.lit(0.0), rate - move))


def with_steps(stood: DataFrame, past: list[list[float]], last: list[float]) -> DataFrame:
    """stood (with rate) and its rates after the past steps (before) and one more (after). Steps come as a table of one row, so that all of them are one plan and one
    generated code, whatever their number."""
    row = pa.table({"__past": pa.array([past], pa.list_(pa.list_(pa.float64()))), "__last": pa.array([last], pa.list_(pa.float64()))})
    both = stood.crossJoin(F.broadcast(stood.sparkSession.createDataFrame(row)))
    both = both.withColumn("before", F.aggregate("__past", F.col("rate"), lambda rate, slope: stepped(rate, slope)))
    return both.withColumn("after", stepped(F.col("before"), F.col("__last"))).drop("__past", "__last")


def after_steps(stood: DataFrame, past: list[list[float]]) -> DataFrame:
    return with_steps(stood, past[:-1], past[-1]).drop("rate", "before").withColumnRenamed("after", "rate") if past else stood


def fitted_rates(members: DataFrame, weights: dict[str, float] = WEIGHTS) -> tuple[DataFrame, dict[str, float], dict[str, float]]:
    """members with rate, the targets and the totals reached. `members` is read once a step.

    Projected gradient with spectral step lengths: in the metric of tokens, the length is the last move's square over its change of the gradient, the
    first one the inverse of the loss's greatest curvature. A step that raises the loss above the last LOOK_BACK losses is taken again, shorter."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    p = lambda i: F.col(f"p_{DOMAINS[i]}")
    k = range(len(DOMAINS))
    pairs = [(i, j) for i in k for j in k]
    first = members.agg(total("n"), *[total(F.col("n") * p(i)) for i in k], *[total(F.col("n") * p(i) * p(j)) for i, j in pairs]).first()
    n, reached, gram = first[0], np.array(first[1 : 1 + len(DOMAINS)]), np.array(first[1 + len(DOMAINS) :]).reshape(len(DOMAINS), -1)
    target = targets(dict(zip(DOMAINS, reached.tolist())), weights, n)
    wish = np.array([target[d] for d in DOMAINS])
    scale = np.maximum(np.where(wish > 0, wish, reached), max(ABSENT * n, 1.0))
    loss = lambda reached: float(((reached - wish) ** 2 / scale).sum() / 2)
    stood, past = members.withColumn("rate", F.lit(1.0)), []
    curvature = np.linalg.eigvalsh(gram / np.sqrt(scale[:, None] * scale[None])).max()
    length, losses, still = 1 / max(curvature, 1e-12), [loss(reached)], 0
    for _ in range(STEPS):
        if (np.abs(reached - wish) <= CLOSE * scale).all():
            break
        slope = (reached - wish) / scale
        for _ in range(8):
            last = (length * slope).tolist()
            moved = F.col("after") - F.col("before")
            sums = with_steps(stood, past, last).agg(*[total(F.col("n") * F.col("after") * p(i)) for i in k], total(F.col("n") * moved * moved)).first()
            there, square = np.array(sums[: len(DOMAINS)]), sums[len(DOMAINS)]
            if loss(there) <= max(losses[-LOOK_BACK:]):
                break
            length /= 4
        still = still + 1 if losses[-1] - loss(there) <= STILL * losses[-1] else 0
        bent = float(((there - reached) ** 2 / scale).sum())
        length = square / bent if bent > 0 else length
        past, reached = [*past, last], there
        losses.append(loss(there))
        if square <= 1e-12 * max(n, 1.0) or still >= LOOK_BACK:
            break
        if len(past) == REPLAY:
            stood, past = written(after_steps(stood, past), "rates"), []
    return after_steps(stood, past), target, dict(zip(DOMAINS, reached.tolist()))


def memberships(docs: DataFrame, labels: DataFrame) -> DataFrame:
    w, dense = classifier(docs, labels)
    text = F.col("text").cast("string")
    read = docs.select(F.col("doc_id").cast("long").alias("__id"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("__doc"), text.alias("__text"))
    return written(read.mapInArrow(membership(w, dense), "__id long, __doc long, n double, " + ", ".join(f"p_{d} double" for d in DOMAINS)), "members")


def with_copies(rated: DataFrame) -> DataFrame:
    """rated, one row for each id and text, with copies, drawn along the order of length and hash within each likeliest domain."""
    best = F.greatest(*[F.col(f"p_{d}") for d in DOMAINS])
    domain = F.coalesce(*[F.when(F.col(f"p_{d}") == best, F.lit(i)) for i, d in enumerate(DOMAINS)])
    units = F.round((F.col("rate") - F.floor("rate")) * UNIT).cast("long")
    once = rated.dropDuplicates(["__id", "__doc"]).withColumn("__domain", domain).withColumn("__units", units)
    order = ["__domain", "n", "__doc", "__id"]
    ordered = written(once.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    parts = ordered.groupBy("__domain", "__part").agg(F.sum("__units").alias("__sum"))  # a row for each task and domain
    before = Window.partitionBy("__domain").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(parts.select("__domain", "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base")), "bases")
    own = Window.partitionBy("__domain", "__part").orderBy("n", "__doc", "__id").rowsBetween(Window.unboundedPreceding, 0)
    joined = ordered.join(small_side(bases, bases.count() * KEY_BYTES), ["__domain", "__part"])
    upto = F.col("__base") + F.sum("__units").over(own)
    summed = written(joined.withColumn("__upto", upto), "summed")

    def passed(begin: Column) -> Column:
        """Whole numbers between the sum before a row and the sum with it, counted from `begin`."""
        return F.call_function("div", F.col("__upto") + begin, F.lit(UNIT)) - F.call_function("div", F.col("__upto") - F.col("__units") + begin, F.lit(UNIT))

    begins = [k * UNIT // BEGINS for k in range(BEGINS)]
    miss = [F.abs(F.sum(F.col("n") * (passed(F.lit(b)) - F.col("__units") / UNIT))).alias(str(b)) for b in begins]
    least = {r["__domain"]: min(begins, key=lambda b: r[str(b)]) for r in summed.groupBy("__domain").agg(*miss).collect()}  # a row a domain
    begin = F.coalesce(*[F.when(F.col("__domain") == d, F.lit(b)) for d, b in least.items()], F.lit(0))
    drawn = summed.withColumn("copies", (F.floor("rate") + passed(begin)).cast("long"))
    return drawn.drop("__domain", "__part", "__base", "__units", "__upto")


def document_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """doc_id, __doc, n_tokens, the domain probabilities, rate and copies of each row; and, in every row alike, each domain's target and the total that
    the rates reach."""
    members = memberships(docs, labels)
    rated, target, reached = fitted_rates(members, weights)
    missed = {d: (target[d], reached[d]) for d in DOMAINS if abs(reached[d] - target[d]) > 2 * CLOSE * max(target[d], 1.0)}
    absent = [d for d in DOMAINS if weights[d] > 0 and reached[d] < ABSENT * sum(reached.values())]
    if sum(reached.values()) > 0 and (missed or absent):
        warnings.warn(f"no rates up to {MAX_RATE} meet the weights {weights}; targets and totals reached: {missed}; in no text: {absent}", stacklevel=2)
    drawn = with_copies(rated).select(F.col("__id").alias("__i"), F.col("__doc").alias("__d"), "rate", "copies")
    rows = members.join(drawn, (F.col("__doc") == F.col("__d")) & F.col("__id").eqNullSafe(F.col("__i")))
    totals = [F.lit(float(x[d])).alias(f"{name}_{d}") for name, x in (("target", target), ("reached", reached)) for d in DOMAINS]
    return rows.select(F.col("__id").alias("doc_id"), "__doc", F.col("n").cast("long").alias("n_tokens"), *[f"p_{d}" for d in DOMAINS], "rate", "copies", *totals)


def mixed_documents(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The rows of docs, each as often as its copies say."""
    docs = unreserved(docs)
    rates = document_rates(docs, labels, weights).select(F.col("doc_id").alias("__i"), F.col("__doc").alias("__d"), F.col("copies").alias("__copies"))
    rates = written(rates.where("__copies <> 1").distinct(), "rates")
    rows = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__doc", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    joined = rows.join(small_side(rates, rates.count() * KEY_BYTES), (F.col("__doc") == F.col("__d")) & F.col("__id").eqNullSafe(F.col("__i")), "left")
    once = joined.withColumn("__copies", F.coalesce("__copies", F.lit(1).cast("long"))).where("__copies > 0")
    return once.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)
