"""Exact top-k inner products by block-at-a-time pruning.

Vectors become integers, floor(64 x). A component is a term, with its sign. Documents are put in an order that keeps like vectors near (the
nearest of a few centroids of a bounded sample, then the id), and runs of BLOCK documents of that order are blocks, each with the greatest and
least value of every term. A query's bound for a block is the sum over terms of its weight times the greatest (for a negative weight, the least) value.

First each query is scored against the documents of its own superblock (up to SUPER documents), which gives a k-th score to beat. Then every chunk of
queries meets the extrema of every superblock, and the queries whose bound for it reaches their k-th score go there, the others not: so superblocks are pruned
before anything is shipped. There, per query, blocks are ordered by bound and scored through their forward index (the matrix of their
documents) in waves of 1, 2, 4, ... blocks, until the bounds left fall below the k-th score. Equal scores go to the smaller id, so bounds equal to the k-th
score are still opened. Results are exact for any data; the order of documents only decides how much is skipped.

Queries are the rows whose id is divisible by EVERY, against all rows: query chunks times superblocks, in blocks, with one shuffle of each.

Nulls: vectors null, or with null or non-finite components, and rows with a null id take no part. Missing components of shorter vectors are 0. Of repeated query ids the
least vector asks; repeated candidates each count. Rows with the query's id are its own. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import written

SCALE, EVERY, K = 64, 20, 20
BLOCK, SUPER = 64, 1 << 14
SAMPLE, CENTROIDS = 2000, 48
#: Superblocks whose extrema stand in a row of their table, and queries that go to one of them in a row.
EXTREMA, ASKING = 1024, 1024
#: Tiles that a Python task holds at a time.
TILES = 4


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the integer vector."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def size_of(v: DataFrame) -> tuple[int, int]:
    """Rows, and components of the longest vector."""
    told = v.agg(F.count("*").alias("rows"), F.max(F.size("v")).alias("dims")).first()
    return told["rows"], max(1, told["dims"] or 1)


def sampled(v: DataFrame, rows: int) -> DataFrame:
    """vec_id, v: about 2 SAMPLE different ones of so many rows, by a hash, before they are ordered. So few rows reach the driver, where an order alone would send SAMPLE rows from each task."""
    share = min(1.0, 2 * SAMPLE / max(1, rows))
    return v.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 40)) < int(share * (1 << 40))).select("vec_id", "v").distinct()


def centroids(v: DataFrame, rows: int, dims: int, seed: int = 1) -> np.ndarray:
    """k-means of a bounded sample of the rows, the least hashed ids of it."""
    rows = [r["v"] for r in sampled(v, rows).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]
    x = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    if not len(x):
        return np.zeros((1, dims))
    c = x[np.random.default_rng(seed).permutation(len(x))[:CENTROIDS]]
    for _ in range(8):
        near = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        c = np.array([x[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
    return c


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    out = np.zeros((len(lengths), dims), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def nearest(c: np.ndarray):
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), c.shape[1])
            near = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=["vec_id", "v", "asks", "c"])

    return assigned


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b^T exactly: in doubles while sums stay below 2^53, else in integers."""
    if np.abs(a).max(initial=0) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray) -> None:
        self.k, self.floor = k, floor.copy()
        self.q, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.n = n

    def add(self, q: list[np.ndarray], score: list[np.ndarray], ids: list[np.ndarray]) -> None:
        q, score, ids = np.concatenate([self.q, *q]), np.concatenate([self.score, *score]), np.concatenate([self.id, *ids])
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        own = rank < self.k
        self.q, self.score, self.id = q[own], score[own], ids[own]
        last = rank == self.k - 1
        np.maximum.at(self.floor, q[last], score[last])


def searched(queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, docs: np.ndarray, ids: np.ndarray, k: int, block: int = BLOCK) -> tuple[Best, int]:
    """The k best documents of each query that may still enter its list, and how many blocks were scored for a query."""
    if not len(docs) or not len(queries):
        return Best(len(queries), k, floor), 0
    starts = np.arange(0, len(docs), block)
    greatest, least = np.maximum.reduceat(docs, starts), np.minimum.reduceat(docs, starts)
    bounds = products(np.maximum(queries, 0), greatest) + products(np.minimum(queries, 0), least)
    order = np.argsort(-bounds, axis=1, kind="stable")
    best, at, wave, opened = Best(len(queries), k, floor), 0, 1, 0
    while at < len(starts):
        some = order[:, at : at + wave]
        due = np.take_along_axis(bounds, some, axis=1) >= best.floor[:, None]
        if not due.any():
            break
        rows, columns = np.nonzero(due)
        blocks = some[rows, columns]
        opened += len(blocks)
        found: tuple[list, list, list] = ([], [], [])
        by_block = np.argsort(blocks, kind="stable")
        edges = np.flatnonzero(np.diff(blocks[by_block], prepend=-1))
        for own in np.split(by_block, edges[1:]):
            b, q = blocks[own[0]], rows[own]
            member = ids[starts[b] : starts[b] + block]
            score = products(queries[q], docs[starts[b] : starts[b] + block])
            x, y = np.nonzero((score >= best.floor[q][:, None]) & (member[None] != query_ids[q][:, None]))
            for part, values in zip(found, (q[x], score[x, y], member[y])):
                part.append(values)
        best.add(*found)
        at, wave = at + wave, wave * 2
    return best, opened


SUPERS = "part long, n int, ids binary, docs binary, dims int, query_ids binary, queries binary, floors binary"


def packer(dims: int, k: int):
    """Superblocks of a sorted partition, each with the queries that stand among its rows and their k-th scores within it."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, rows, asking, held = TaskContext.get().partitionId() << 32, [], [], [], 0

        def out() -> pa.RecordBatch:
            own, x, asks = np.concatenate(ids), np.concatenate(rows), np.concatenate(asking)
            query_ids, queries, own, x = own[asks], x[asks], own[~asks], x[~asks]
            floor = np.full(len(query_ids), np.iinfo(np.int64).min)
            best, _ = searched(queries, query_ids, floor, x, own, k)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([len(own)], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in (own, x)], pa.array([dims], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in (query_ids, queries, best.floor)]], names=[c.split()[0] for c in SUPERS.split(", ")])

        for batch in batches:
            own, x, asks = batch.column(0).to_numpy(), matrix(batch.column(1), dims), batch.column(2).to_numpy(zero_copy_only=False)
            while len(own):
                take = min(SUPER - held, len(own))
                ids.append(own[:take])
                rows.append(x[:take])
                asking.append(asks[:take])
                own, x, asks, held = own[take:], x[take:], asks[take:], held + take
                if held == SUPER:
                    yield out()
                    part, ids, rows, asking, held = part + 1, [], [], [], 0
        if held:
            yield out()

    return packed


def tile_search(k: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                docs, queries = (np.frombuffer(r[c], np.int64).reshape(-1, r["dims"]) for c in ("docs", "queries"))
                ids, query_ids, floor = (np.frombuffer(r[c], np.int64) for c in ("ids", "query_ids", "floors"))
                best, _ = searched(queries, query_ids, floor, docs, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[best.q]), pa.array(best.id), pa.array(best.score)], names=["query_id", "vec_id", "score"])

    return found


def extrema(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The greatest and least value of every term in each superblock."""
    for batch in batches:
        for r in batch.to_pylist():
            x = np.frombuffer(r["docs"], np.int64).reshape(-1, r["dims"])
            yield pa.RecordBatch.from_arrays([pa.array([r["part"]]), pa.array([x.max(axis=0).tobytes()], pa.binary()), pa.array([x.min(axis=0).tobytes()], pa.binary())], names=["part", "greatest", "least"])


def sender(dims: int):
    """Chunks of queries beside extrema: for each superblock that some may enter, these queries."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                queries = np.frombuffer(r["queries"], np.int64).reshape(-1, dims)
                ids, floor = (np.frombuffer(r[c], np.int64) for c in ("query_ids", "floors"))
                greatest, least = (np.array([np.frombuffer(b[c], np.int64) for b in r["supers"]]) for c in ("greatest", "least"))
                for at in range(0, len(ids), ASKING):
                    q = queries[at : at + ASKING]
                    due = products(np.maximum(q, 0), greatest) + products(np.minimum(q, 0), least) >= floor[at : at + ASKING, None]
                    for k in np.flatnonzero(due.any(axis=0)):
                        own = at + np.flatnonzero(due[:, k])
                        arrays = [pa.array([a.tobytes()], pa.binary()) for a in (ids[own], queries[own], floor[own])]
                        yield pa.RecordBatch.from_arrays([pa.array([r["supers"][k]["part"]]), *arrays], names=["part", "query_ids", "queries", "floors"])

    return sent


def met(sent: DataFrame, parts: DataFrame) -> DataFrame:
    """sent with the part that each row names. Both grow with the input, and their files are many times smaller than their rows: by its estimate Spark would broadcast them, through the driver."""
    return sent.hint("merge").join(parts.hint("merge"), "part")


def few_at_once(df: DataFrame, task, schema: str, name: str) -> DataFrame:
    """df.mapInArrow(task), written, with TILES rows of megabytes in an Arrow batch, and in a batch of the reader of Parquet, which takes 4,096 rows else."""
    conf, keys = df.sparkSession.conf, ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {key: conf.get(key) for key in keys}
    for key in keys:
        conf.set(key, str(TILES))
    try:
        return written(df.mapInArrow(task, schema), name)
    finally:
        for key in keys:
            conf.set(key, before[key])


def sent_queries(supers: DataFrame, dims: int) -> DataFrame:
    """part, query_ids, queries, floors: the queries of each superblock that may find a document in another, or in their own."""
    bounds = few_at_once(supers.where("n > 0").select("part", "docs", "dims"), extrema, "part long, greatest binary, least binary", "extrema")
    numbers = written(bounds.select("part").withColumn("block", F.floor((F.row_number().over(Window.orderBy("part")) - 1) / EXTREMA).cast("int")), "numbers")  # a row a superblock
    blocks = written(bounds.join(numbers, "part").groupBy("block").agg(F.collect_list(F.struct("part", "greatest", "least")).alias("supers")), "blocks")
    most = blocks.agg(F.max("block")).first()[0] or 0
    chunks = supers.where(F.octet_length("query_ids") > 0).select("query_ids", "queries", "floors", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("block"))
    return few_at_once(chunks.join(blocks, "block").drop("block"), sender(dims), "part long, query_ids binary, queries binary, floors binary", "sent")


def top_k(vectors: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank from 1, vec_id and score of the k best of each query."""
    v = integers(vectors)
    size, dims = size_of(v)
    queries = v.where(F.col("vec_id") % EVERY == 0).groupBy("vec_id").agg(F.min("v").alias("v"))  # of repeated ids the least vector
    rows = v.withColumn("asks", F.lit(False)).unionByName(queries.withColumn("asks", F.lit(True)))
    ordered = rows.mapInArrow(nearest(centroids(v, size, dims)), "vec_id long, v array<long>, asks boolean, c int").repartitionByRange("c", "vec_id").sortWithinPartitions("c", "vec_id")
    supers = written(ordered.mapInArrow(packer(dims, k), SUPERS), "supers")
    tiles = met(sent_queries(supers, dims), supers.select("part", "ids", "docs", "dims"))
    near = few_at_once(tiles.select("query_ids", "queries", "floors", "ids", "docs", "dims"), tile_search(k), "query_id long, vec_id long, score long", "tiles")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
