"""Hard-negative mining by ball trees, with branch and bound on inner products from above and below.

Vectors become integers, floor(SCALE x). Rows are put in an order that keeps like vectors near (the nearest of a few centroids of a bounded sample, then
the id) and cut, task by task, into parts of up to SUPER rows, each with a ball tree: every node holds the rows between two halves of its
parent, split along the line of far rows, with a centre and a radius. For a query q the inner products of a node's rows lie within
q . centre +- |q| radius. A node is left out if all its rows have the wrong label, if its interval lies outside the scores looked for, or if
its upper end is strictly beneath the query's k-th score so far.

Two searches follow each other. First the POSITIVES best rows of each anchor's own label; each anchor first asks the part where it stands, whose k-th
score then prunes the others. Then, for each anchor and positive of score s, the NEGATIVES best rows of other labels with scores from LOW/100 of s to s.
Queries travel in chunks; a chunk goes only to parts whose root some of its queries may enter, and only with these. Results of the
parts meet by anchor, at most a few rows a part. Rounding of centres and radii only widens the intervals; scores are exact.

Anchors are the rows whose id is divisible by EVERY, against all rows. A positive of negative score has no negatives, as LOW/100 of it is greater than itself.

Nulls: rows with a null id, label or vector, or a null or non-finite component take no part. Missing components of shorter vectors are 0. Equal scores go to
the smaller id, then the smaller label. Of repeated anchor ids the least vector, then label, asks, once; rows of an anchor's id are never its
partners; repeated partners each count. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .topk_blocks import Best, centroids, few_at_once, matrix, met, products, size_of

SCALE, EVERY, POSITIVES, NEGATIVES, LOW = 256, 100, 5, 5, 80
#: Every so manyth id has its label moved on, by one of so many.
MOVED, LABELS = 7, 10
LEAF, SUPER = 32, 1 << 13
#: Roots of parts in a row of their table.
ROOTS = 2048
#: Queries in a row that is sent to a part.
ASKING = 1024
NONE = np.iinfo(np.int64).min


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and v, the integer vector."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    label = F.when(F.col("vec_id") % MOVED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).cast("long")
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), whole.alias("v"))


def levels_of(rows: int, leaf: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, rows) / leaf))))


class Tree:
    """A ball tree over rows x with ids and labels. Nodes are numbered level by level; the last level's are the leaves."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> None:
        levels = levels_of(len(ids), leaf)
        order, edges = np.arange(len(ids)), np.array([0, len(ids)])
        for _ in range(levels):
            middles = (edges[:-1] + edges[1:]) // 2
            for begin, middle, end in zip(edges[:-1], middles, edges[1:]):
                own = order[begin:end]
                if len(own) > 1:
                    order[begin:end] = own[np.argpartition(along(x[own]), middle - begin)]
            edges = np.sort(np.concatenate([edges, middles]))
        self.ids, self.labels, self.x, self.levels = ids[order], labels[order], x[order], levels
        self.finish()

    def finish(self) -> None:
        """Edges, centres, radii and common labels of all nodes, from the rows in order; nothing without rows, where no search begins."""
        if not len(self.ids):
            return
        edges = [np.array([0, len(self.ids)])]
        for _ in range(self.levels):
            edges.append(np.sort(np.concatenate([edges[-1], (edges[-1][:-1] + edges[-1][1:]) // 2])))
        self.edges, self.centres, self.radii, self.mixed, self.first = edges, [], [], [], []
        values = self.x.astype(np.float64)
        sums = np.concatenate([np.zeros((1, self.x.shape[1])), np.cumsum(values, axis=0)])
        changes = np.concatenate([[0, 0], np.cumsum(self.labels[1:] != self.labels[:-1])])[: len(self.ids) + 1]
        for e in edges:
            n = np.diff(e)
            centre = (sums[e[1:]] - sums[e[:-1]]) / np.maximum(n, 1)[:, None]
            away = np.sqrt(((values - np.repeat(centre, n, axis=0)) ** 2).sum(axis=1))
            radius = np.array([away[a:b].max(initial=0) for a, b in zip(e[:-1], e[1:])])
            last = np.maximum(e[1:], 1)
            self.centres.append(centre)
            self.radii.append(radius)
            self.mixed.append(changes[last] > changes[np.minimum(e[:-1] + 1, len(changes) - 1)])
            self.first.append(self.labels[np.minimum(e[:-1], len(self.ids) - 1)])


def along(x: np.ndarray) -> np.ndarray:
    """Places of rows along the line between two far ones."""
    values = x.astype(np.float64)
    far = values[((values - values.mean(axis=0)) ** 2).sum(axis=1).argmax()]
    other = values[((values - far) ** 2).sum(axis=1).argmax()]
    return values @ (other - far)


def interval(q: np.ndarray, size: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner products of queries (size: their lengths) with rows of balls, widened by more than rounding can take."""
    middle = q.astype(np.float64) @ centre.T
    reach = size[:, None] * radius[None]
    slack = 1e-9 * (size[:, None] * (np.sqrt((centre**2).sum(axis=1))[None] + radius[None]) + 1)
    return middle - reach - slack, middle + reach + slack


class Queries:
    """Queries of a chunk: ids and labels of the anchors, vectors, the scores looked for (low and high, both included) and k-th scores to beat."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, floor: np.ndarray, high: np.ndarray | None = None) -> None:
        self.ids, self.labels, self.x, self.floor, self.high = ids, labels, x, floor, high
        self.size = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))

    def may_enter(self, low: np.ndarray, up: np.ndarray, mixed: np.ndarray, first: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Whether each query may find a row in nodes of these intervals; one row a query, or one entry a pair."""
        shape = (slice(None), None) if low.ndim == 2 else (slice(None),)
        fit = (first == self.labels[shape]) if self.high is None else (first != self.labels[shape])
        out = (mixed | fit) & (up >= floor[shape])
        if self.high is not None:
            out &= (100 * up >= LOW * self.high[shape]) & (low <= self.high[shape])
        return out

    def taken(self, some: np.ndarray) -> Queries:
        return Queries(self.ids[some], self.labels[some], self.x[some], self.floor[some], None if self.high is None else self.high[some])

    def right(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Which of these rows (a column each) the queries q look for, of their scores (a row a query)."""
        same = labels[None] == self.labels[q][:, None]
        if self.high is None:
            return same & (ids[None] != self.ids[q][:, None])
        high = self.high[q][:, None]
        return ~same & (ids[None] != self.ids[q][:, None]) & (100 * score >= LOW * high) & (score <= high)


def searched(tree: Tree, queries: Queries, k: int) -> tuple[Best, int]:
    """The k best rows of each query that may still enter its list, and how many leaves were scored for a query."""
    best, opened = Best(len(queries.ids), k, queries.floor), 0
    if not len(tree.ids) or not len(queries.ids):
        return best, opened
    rows, nodes = np.arange(len(queries.ids)), np.zeros(len(queries.ids), np.int64)

    def score(rows: np.ndarray, leaves: np.ndarray) -> None:
        found: tuple[list, list, list] = ([], [], [])
        by_leaf = np.argsort(leaves, kind="stable")
        for own in np.split(by_leaf, np.flatnonzero(np.diff(leaves[by_leaf])) + 1):
            begin, end = tree.edges[-1][leaves[own[0]]], tree.edges[-1][leaves[own[0]] + 1]
            q = rows[own]
            scores = products(queries.x[q], tree.x[begin:end])
            x, y = np.nonzero(queries.right(q, scores, tree.ids[begin:end], tree.labels[begin:end]) & (scores >= best.floor[q][:, None]))
            for part, values in zip(found, (q[x], scores[x, y], tree.ids[begin:end][y])):
                part.append(values)
        best.add(*found)

    for level in range(tree.levels + 1):
        low, up = interval(queries.x, queries.size, tree.centres[level], tree.radii[level])
        low, up = low[rows, nodes], up[rows, nodes]
        pairs = queries_of(queries, rows)
        due = pairs.may_enter(low, up, tree.mixed[level][nodes], tree.first[level][nodes], best.floor[rows])
        rows, nodes, up = rows[due], nodes[due], up[due]
        if level < tree.levels:
            rows, nodes = np.repeat(rows, 2), np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel()
    order = np.lexsort((-up, rows))  # the best leaves of each query first, in waves of 1, 2, 4, ...
    rows, nodes, up = rows[order], nodes[order], up[order]
    rank, at, wave = np.arange(len(rows)) - np.searchsorted(rows, rows), 0, 1
    while at < (rank.max() + 1 if len(rank) else 0):
        due = np.flatnonzero((rank >= at) & (rank < at + wave) & (up >= best.floor[rows]))
        if len(due):
            opened += len(due)
            score(rows[due], nodes[due])
        at, wave = at + wave, wave * 2
    return best, opened


def queries_of(queries: Queries, rows: np.ndarray) -> Queries:
    """A view of the queries, one entry a pair, without vectors."""
    out = Queries.__new__(Queries)
    out.labels, out.high = queries.labels[rows], None if queries.high is None else queries.high[rows]
    return out


PARTS = "part long, n int, dims int, ids binary, labels binary, docs binary, query_ids array<long>, query_labels array<long>, queries binary, floors array<long>"


def nearest(c: np.ndarray):
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2), c.shape[1])
            near = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=["vec_id", "label", "v", "asks", "c"])

    return assigned


def listed(values: np.ndarray) -> pa.Array:
    return pa.array([values.tolist()], pa.list_(pa.int64()))


def packer(dims: int):
    """Parts of a sorted partition, rows in the order of the part's tree, with the anchors that stand among them and their k-th scores there."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, columns, number = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            ids, labels, x, asks = (np.concatenate(c) for c in zip(*columns))
            tree = Tree(ids[~asks], labels[~asks], x[~asks])
            queries = Queries(ids[asks], labels[asks], x[asks], np.full(int(asks.sum()), NONE))
            best, _ = searched(tree, queries, POSITIVES)
            arrays = [pa.array([(task << 32) + number]), pa.array([len(tree.ids)], pa.int32()), pa.array([dims], pa.int32())]
            arrays += [pa.array([a.tobytes()], pa.binary()) for a in (tree.ids, tree.labels, tree.x)]
            arrays += [listed(queries.ids), listed(queries.labels), pa.array([queries.x.tobytes()], pa.binary()), listed(best.floor)]
            return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in PARTS.split(", ")])

        for batch in batches:
            own = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), dims), batch.column(3).to_numpy(zero_copy_only=False)
            while len(own[0]):
                take = min(SUPER - held, len(own[0]))
                columns.append(tuple(c[:take] for c in own))
                own, held = tuple(c[take:] for c in own), held + take
                if held == SUPER:
                    yield out()
                    columns, held, number = [], 0, number + 1
        if held:
            yield out()

    return packed


def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The root of each part: centre, radius, one of its labels and whether there are others."""
    for batch in batches:
        for r in batch.to_pylist():
            x, labels = np.frombuffer(r["docs"], np.int64).reshape(-1, r["dims"]).astype(np.float64), np.frombuffer(r["labels"], np.int64)
            if not len(x):
                continue
            centre = x.mean(axis=0)
            arrays = [pa.array([r["part"]]), pa.array([centre.tolist()]), pa.array([float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())])]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([int(labels[0])]), pa.array([bool((labels != labels[0]).any())])], names=["part", "centre", "radius", "first", "mixed"])


CHUNK = "query_ids array<long>, query_labels array<long>, queries binary, floors array<long>, highs array<long>, partners array<long>"


def queries_in(r: dict, dims: int) -> Queries:
    x = np.frombuffer(r["queries"], np.int64).reshape(-1, dims)
    high = None if r["highs"] is None else np.array(r["highs"], np.int64)
    return Queries(np.array(r["query_ids"], np.int64), np.array(r["query_labels"], np.int64), x, np.array(r["floors"], np.int64), high)


def sender(dims: int):
    """Chunks of queries against a block of roots: for each part that some may enter, these queries."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                whole = queries_in(r, dims)
                centre, radius, mixed, first = (np.array([b[c] for b in r["roots"]]) for c in ("centre", "radius", "mixed", "first"))
                for at in range(0, len(whole.ids), ASKING):
                    q = whole.taken(np.arange(at, min(at + ASKING, len(whole.ids))))
                    low, up = interval(q.x, q.size, centre, radius)
                    due = q.may_enter(low, up, mixed[None], first[None], q.floor)
                    for k in np.flatnonzero(due.any(axis=0)):
                        some = np.flatnonzero(due[:, k])
                        own, partners = q.taken(some), None if r["partners"] is None else [r["partners"][at + i] for i in some]
                        lists = [own.ids.tolist(), own.labels.tolist(), own.floor.tolist(), None if own.high is None else own.high.tolist(), partners]
                        lists = [pa.array([x], pa.list_(pa.int64())) for x in lists]
                        arrays = [pa.array([r["roots"][k]["part"]]), lists[0], lists[1], pa.array([own.x.tobytes()], pa.binary()), *lists[2:]]
                        yield pa.RecordBatch.from_arrays(arrays, names=["part", "query_ids", "query_labels", "queries", "floors", "highs", "partners"])

    return sent


def planted(r: dict) -> Tree:
    """The tree of a part, whose rows stand in its order."""
    tree = Tree.__new__(Tree)
    tree.ids, tree.labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
    tree.x, tree.levels = np.frombuffer(r["docs"], np.int64).reshape(-1, r["dims"]), levels_of(len(tree.ids), LEAF)
    tree.finish()
    return tree


def tile_search(k: int):
    """Chunks of queries beside a part: the k best of each query in it."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q = queries_in(r, r["dims"])
                best, _ = searched(planted(r), q, k)
                partner = pa.nulls(len(best.q), pa.int64()) if r["partners"] is None else pa.array(np.array(r["partners"], np.int64)[best.q])
                high = pa.nulls(len(best.q), pa.int64()) if q.high is None else pa.array(q.high[best.q])
                yield pa.RecordBatch.from_arrays([pa.array(q.ids[best.q]), partner, high, pa.array(best.id), pa.array(best.score)], names=["anchor_id", "partner", "high", "vec_id", "score"])

    return found


def asked(chunks: DataFrame, parts: DataFrame, roots: DataFrame, dims: int, k: int, name: str) -> DataFrame:
    """The rows found for the queries of chunks in the parts that they may enter."""
    blocks = roots.agg(F.max("block").alias("b")).first()["b"]
    chunks = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks or 0))))
    sent = chunks.join(roots, "block").drop("block")
    sent = few_at_once(sent, sender(dims), "part long, " + CHUNK, f"{name}-sent")
    tiles = met(sent, parts.select("part", "dims", "ids", "labels", "docs"))
    return few_at_once(tiles, tile_search(k), "anchor_id long, partner long, high long, vec_id long, score long", name)


def homed(pairs: DataFrame, parts: DataFrame, dims: int) -> DataFrame:
    columns = ["part", "query_ids", "query_labels", "queries", "dims", "ids", "labels", "docs"]
    return few_at_once(met(pairs, parts.select(*columns)), chunk_of_pairs(dims), CHUNK, "pairs")


def best_of(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank from 1, negative_id, positive_score and negative_score."""
    v = usable(vectors)
    size, dims = size_of(v)
    asks = v.where(F.col("vec_id") % EVERY == 0).groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("a")).select("vec_id", F.col("a.label").alias("label"), F.col("a.v").alias("v"))
    rows = v.withColumn("asks", F.lit(False)).unionByName(asks.withColumn("asks", F.lit(True)))
    ordered = rows.mapInArrow(nearest(centroids(v, size, dims)), "vec_id long, label long, v array<long>, asks boolean, c int").repartitionByRange("c", "vec_id").sortWithinPartitions("c", "vec_id")
    parts = written(ordered.mapInArrow(packer(dims), PARTS), "parts")
    numbered = Window.orderBy("part")  # a row a part
    roots = few_at_once(parts.where("n > 0").select("part", "dims", "labels", "docs"), rooted, "part long, centre array<double>, radius double, first long, mixed boolean", "roots")
    places = written(roots.select("part").withColumn("block", F.floor((F.row_number().over(numbered) - 1) / ROOTS).cast("int")), "places")
    roots = written(roots.join(places, "part").groupBy("block").agg(F.collect_list(F.struct("part", "centre", "radius", "first", "mixed")).alias("roots")), "blocks")
    none = F.lit(None).cast("array<long>")
    chunks = parts.where(F.size("query_ids") > 0).select("part", "query_ids", "query_labels", "queries", "floors")
    own = asked(chunks.drop("part").withColumn("highs", none).withColumn("partners", none), parts, roots, dims, POSITIVES, "positives")
    positives = best_of(own, ["anchor_id"], POSITIVES).where("score >= 0").groupBy("anchor_id", F.col("vec_id").alias("partner"), F.col("score").alias("high")).agg(F.min("rank").alias("rank"))
    home = chunks.select("part", F.posexplode("query_ids").alias("place", "anchor_id"))
    pairs = positives.join(home, "anchor_id").groupBy("part").agg(F.sort_array(F.collect_list(F.struct("place", "rank", "partner", "high"))).alias("pairs"))  # of a part's anchors
    found = asked(homed(pairs, parts, dims), parts, roots, dims, NEGATIVES, "negatives")
    out = best_of(found, ["anchor_id", "partner", "high"], NEGATIVES)
    return out.select("anchor_id", F.col("partner").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("high").alias("positive_score"), F.col("score").alias("negative_score"))


def chunk_of_pairs(dims: int):
    """Chunks of queries for a part's anchors and their positives, with their k-th scores in that part."""

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                tree, vectors = planted(r), np.frombuffer(r["queries"], np.int64).reshape(-1, dims)
                ids, labels = np.array(r["query_ids"], np.int64), np.array(r["query_labels"], np.int64)
                for at in range(0, len(r["pairs"]), ASKING):
                    pairs = r["pairs"][at : at + ASKING]
                    place, high = (np.array([p[c] for p in pairs], np.int64) for c in ("place", "high"))
                    q = Queries(ids[place], labels[place], vectors[place], np.full(len(place), NONE), high)
                    best, _ = searched(tree, q, NEGATIVES)
                    lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (q.ids, q.labels, best.floor, high)]
                    arrays = [*lists[:2], pa.array([q.x.tobytes()], pa.binary()), *lists[2:], pa.array([[p["partner"] for p in pairs]], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in CHUNK.split(", ")])

    return chunked
