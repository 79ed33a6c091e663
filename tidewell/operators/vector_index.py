"""A stored vector index: inverted lists by centroid, searched exactly by bounds or in the lists nearest to a query.

`build` fits centroids on a bounded sample (SAMPLE rows of the least hashes), deals every vector to the nearest, and stores each list as blocks of up to BLOCK vectors: a
row with ids, a matrix, a centre and a radius, below ``blocks/list=<n>``. A hot list has many blocks and no larger ones.

A search first asks, for each query, the blocks of the `probes` lists whose centroids have the greatest inner product with it. In exact mode, the k-th score found so
goes round once more: every block whose bound, q . centre + |q| radius, reaches it is opened, and no other, so the result equals that of all
vectors. Queries are rows, in blocks as well, and meet blocks by their number in a shuffle, so neither side need be small; k rows a query and block come back.

Scores are rounded to DIGITS places, equal ones go to the smaller id. Vectors that are null or hold null or non-finite components are left out, as are such queries. All
have as many components as the first centroid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import new_path, written
from .fusion import DIGITS, best
from .retrieval import rows_of

SAMPLE, BLOCK, PROBES = 20_000, 4096, 8
#: Queries in a row of the search, and blocks' bounds that it meets at a time.
ASKING, BOUNDS = 512, 4096
#: Rows of megabytes in an Arrow batch.
TILES = 4
BLOCKS = "block long, list int, n int, dims int, ids binary, matrix binary, centre binary, radius double"
FOUND = "qid long, id long, score double"


def clean(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    x = F.col(vector).cast("array<double>")
    good = F.col(id_column).isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(good).select(F.col(id_column).cast("long").alias(id_column), x.alias(vector))


def centroids(sample: np.ndarray, n: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """k-means of a sample."""
    c = sample[np.random.default_rng(seed).permutation(len(sample))[:n]]
    for _ in range(rounds):
        near = (sample @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        c = np.array([sample[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
    return c


def dealer(c: np.ndarray):
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch.column(1))
            near = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=["id", "embedding", "list"])

    return dealt


def packer(dims: int):
    """Blocks of a partition that is sorted by list."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, task, held = 0, TaskContext.get().partitionId(), pa.table({"id": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.float64())), "list": pa.array([], pa.int32())})

        def block(rows: pa.Table) -> pa.RecordBatch:
            x, ids = rows_of(rows.column("embedding").combine_chunks()), rows.column("id").to_numpy()
            centre = x.mean(axis=0)
            radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())
            values = [(task << 32) + number, rows.column("list")[0].as_py(), len(ids), dims, ids.tobytes(), x.tobytes(), centre.tobytes(), radius]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch]).cast(held.schema)])
            while held.num_rows:
                lists = held.column("list").to_numpy()
                end = int(np.searchsorted(lists, lists[0], side="right"))
                if end == len(lists) and end < BLOCK:
                    break  # the list may go on in the next batch
                end = min(end, BLOCK)
                yield block(held.slice(0, end))
                held, number = held.slice(end), number + 1
        if held.num_rows:
            yield block(held)

    return packed


def asker(dims: int, probes: int | None, c: np.ndarray):
    """Blocks of queries against a block of bounds: for each block that some query has to open, those queries. With `probes`, a block is opened for the queries to whose
    lists it belongs; without, for those whose k-th score its bound reaches and that have not opened it."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q = np.array(r["q"], np.float64).reshape(-1, dims)
                lists, near = np.array([b["list"] for b in r["bounds"]]), None
                first = np.argsort(-(q @ c.T), axis=1, kind="stable")[:, : probes or PROBES]
                near = (lists[None, :, None] == first[:, None, :]).any(axis=2)
                if probes is None:
                    centre, radius = np.array([np.frombuffer(b["centre"], np.float64) for b in r["bounds"]]), np.array([b["radius"] for b in r["bounds"]])
                    size = np.sqrt((q * q).sum(axis=1))[:, None]
                    reach = q @ centre.T + size * radius + 1e-9 * (1 + size * (radius + np.sqrt((centre**2).sum(axis=1))))
                    due = ~near & (np.round(reach, DIGITS) >= np.array(r["floor"])[:, None])
                else:
                    due = near
                for k in np.flatnonzero(due.any(axis=0)):
                    some = np.flatnonzero(due[:, k])
                    arrays = [pa.array([r["bounds"][k]["block"]]), pa.array([r["bounds"][k]["list"]], pa.int32()), pa.array([[r["qids"][i] for i in some]], pa.list_(pa.int64())), pa.array([q[some].tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["block", "list", "qids", "queries"])

    return asked


def opener(k: int):
    """The k best of each query in a block."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["matrix"], np.float64).reshape(-1, r["dims"])
                score = np.round(np.frombuffer(r["queries"], np.float64).reshape(-1, r["dims"]) @ x.T, DIGITS)
                q, i = np.nonzero(score >= (np.partition(score, -k, axis=1)[:, -k, None] if score.shape[1] > k else -np.inf))
                order = np.lexsort((ids[i], -score[q, i], q))
                q, i = q[order], i[order]
                own = np.arange(len(q)) - np.searchsorted(q, q) < k  # of equal last scores the smallest ids
                yield pa.RecordBatch.from_arrays([pa.array(np.array(r["qids"], np.int64)[q[own]]), pa.array(ids[i[own]]), pa.array(score[q[own], i[own]])], names=["qid", "id", "score"])

    return opened


class VectorIndex:
    """The index at `path`, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def build(self, vectors: DataFrame, lists: int = 64) -> VectorIndex:
        """Store the vectors (id, embedding). The index can be read once this has ended."""
        rows = clean(vectors, "id", "embedding")
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow()
        x = rows_of(sample.column(0).combine_chunks())
        c = centroids(x, min(lists, max(1, len(x)))) if len(x) else np.zeros((1, 1))
        dealt = rows.mapInArrow(dealer(c), "id long, embedding array<double>, list int").repartitionByRange("list", F.xxhash64("id")).sortWithinPartitions("list", F.xxhash64("id"))
        few_at_once(self.spark, lambda: dealt.mapInArrow(packer(c.shape[1]), BLOCKS).write.mode("overwrite").partitionBy("list").parquet(f"{self.path}/blocks"), 10_000)
        stored = self.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "list int, centroid array<double>")
        stored.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids")
        return self

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(BLOCKS).parquet(f"{self.path}/blocks")

    def lists_of(self, sent: DataFrame) -> DataFrame:
        """The blocks of the lists that are asked, whose numbers prune the read."""
        return self.blocks().where(F.col("list").isin([r["list"] for r in sent.select("list").distinct().collect()]))  # as many as lists, at most

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """qid, id, score, rank of the k best of each query (qid, q): of `probes` lists, or without, exactly."""
        c = np.array([r["centroid"] for r in self.spark.read.parquet(f"{self.path}/centroids").orderBy("list").collect()])  # as many as lists
        bounds = self.blocks().select("block", "list", "centre", "radius")
        numbered = bounds.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(max(1, -(-self.blocks().count() // BOUNDS)))).cast("int"))
        parts = written(numbered.groupBy("part").agg(F.collect_list(F.struct("block", "list", "centre", "radius")).alias("bounds")), "bounds")
        asked = clean(queries, "qid", "q").dropDuplicates(["qid"])
        asked = written(asked.withColumn("chunk", F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-asked.count() // ASKING))))), "queries")
        near = self.opened(asked.withColumn("floor", F.lit(float("-inf"))), parts, c, k, probes or PROBES, "near")
        if probes is not None:
            return best(near, k)
        floors = best(near, k).groupBy("qid").agg(F.when(F.count("*") == k, F.min("score")).otherwise(float("-inf")).alias("floor"))
        rest = asked.join(floors, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        return best(near.unionByName(self.opened(rest, parts, c, k, None, "rest")), k)

    def opened(self, asked: DataFrame, parts: DataFrame, c: np.ndarray, k: int, probes: int | None, name: str) -> DataFrame:
        chunks = asked.groupBy("chunk").agg(F.collect_list(F.struct("qid", "q", "floor")).alias("r"))  # about ASKING rows
        chunks = chunks.select(F.col("r.qid").alias("qids"), F.flatten("r.q").alias("q"), F.col("r.floor").alias("floor"))
        most = parts.agg(F.max("part")).first()[0] or 0
        meets = chunks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(most)))).join(parts, "part").drop("part")
        sent = few_at_once(self.spark, lambda: written(meets.select("qids", "q", "floor", "bounds").mapInArrow(asker(c.shape[1], probes, c), "block long, list int, qids array<long>, queries binary"), f"{name}-sent"))
        tiles = sent.drop("list").join(self.lists_of(sent).select("block", "dims", "ids", "matrix"), "block").drop("block")
        return few_at_once(self.spark, lambda: written(tiles.mapInArrow(opener(k), FOUND), name))


def few_at_once(spark: SparkSession, run, rows: int = TILES):
    """run() with so many rows in an Arrow batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        return run()
    finally:
        spark.conf.set(key, before)


def scratch_index(spark: SparkSession) -> VectorIndex:
    """A new index in the application's shared folder."""
    return VectorIndex(spark, new_path(spark, "vectors"))
