"""Pairs of near vectors without comparing all: signs of random projections in bands, exact products of those that share a band.

Equal vectors are one before anything else: the row of the least id stands for them, and `members` says for whom. Two unit vectors at an angle of a agree in the sign of a random
projection with probability 1 - a / pi, and meet in one of BANDS bands of BITS signs with 1 - (1 - (1 - a / pi)^BITS)^BANDS: at a cosine of 0.95 in 9,995 of 10,000 cases, at
0.99 in all but one of 10^11. So few pairs are missed above 0.95, and more below; `retrieval.similar_pairs` compares all.

A row travels once for each band in which it is not alone, so the shuffle grows with the rows. A band's bucket with more than TILE members, as of a hot topic, is dealt to tiles, and
every two tiles meet in a task as matrices: only pairs found become rows. Null vectors, and those that hold null or non-finite components, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small, written
from .fusion import DIGITS
from .retrieval import rows_of
from .vector_index import clean

BITS, BANDS, TILE = 12, 24, 1024
PAIRS = "id long, other_id long, score double"


def members(vectors: DataFrame) -> DataFrame:
    """id, head of vectors (id, embedding): the least id of an equal vector."""
    rows = clean(vectors, "id", "embedding")
    heads = rows.groupBy("embedding").agg(F.min("id").alias("head"))
    return rows.join(heads, "embedding").select("id", "head")


def banded(dims: int, seed: int = 7):
    """Rows of (band and its signs, id) for each vector."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).standard_normal((dims, BITS * BANDS))
        for batch in batches:
            x, ids = rows_of(batch.column(1)), batch.column(0).to_numpy()
            if not len(x):
                continue
            signs = (x @ planes > 0).reshape(len(x), BANDS, BITS)
            keys = signs @ (1 << np.arange(BITS)) + (np.arange(BANDS) << BITS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids, BANDS))], names=["bucket", "id"])

    return keyed


def compared(least: float):
    """The pairs of two tiles of a bucket that reach `least`."""

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        own, other = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        same = not len(other)
        a, x = np.stack(own["v"].to_numpy()), own["id"].to_numpy()
        b, y = (a, x) if same else (np.stack(other["v"].to_numpy()), other["id"].to_numpy())
        score = np.round(a @ b.T, DIGITS)
        r, c = np.nonzero(score >= least)
        keep = x[r] < y[c] if same else np.ones(len(r), bool)
        r, c = r[keep], c[keep]
        return pd.DataFrame({"id": np.minimum(x[r], y[c]), "other_id": np.maximum(x[r], y[c]), "score": score[r, c]})

    return products


def near_pairs(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """id < other_id, score of pairs of different unit vectors (id, embedding) with an inner product of `least` or more, each once; ids are heads of `members`."""
    rows = clean(vectors, "id", "embedding")
    heads = written(rows.groupBy("embedding").agg(F.min("id").alias("id")).select("id", "embedding"), "heads")
    dims = heads.agg(F.max(F.size("embedding"))).first()[0] or 1
    keys = written(heads.mapInArrow(banded(dims), "bucket long, id long"), "bands")
    sizes = keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    held = keys.join(small(sizes), "bucket").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    # a tile meets itself and each other tile of its bucket: (i, j), i <= j, side 1 being j where it differs from i
    meets = held.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    meets = meets.select("bucket", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), (F.col("tile") > F.col("with")).cast("int").alias("side"), "id")
    full = meets.join(heads.select("id", F.col("embedding").alias("v")), "id")
    return full.groupBy("bucket", "i", "j").applyInPandas(safe(compared(least)), PAIRS).groupBy("id", "other_id").agg(F.max("score").alias("score"))


def safe(products):
    """Nothing for a pair of tiles of which one is empty."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["i"].iloc[0] != pdf["j"].iloc[0] and pdf["side"].nunique() < 2:
            return pd.DataFrame({"id": [], "other_id": [], "score": []})
        return products(pdf)

    return run
