"""Links between near-equal items from shared keys, without a row for each pair of a bucket.

Items with a common key form a bucket; of buckets with the same members one stays. A bucket's leader is its member with most company (the
sum of the sizes of its buckets), which in a family of copies is near the middle; every other member is compared with it exactly, so a bucket
of n copies costs n comparisons. The links found are joined to components. Buckets whose members are all in one component are done.

The members of the other buckets are compared in full, one of at most BLOCK members and BLOCK_BYTES bytes at once. In larger ones, those of the bucket's
largest component are not compared among themselves. Similarities must come
from a metric (1 - similarity), so members whose similarities to the leader differ by more than 1 - limit cannot match: members are dealt by
that similarity into bins of BIN, and a bin by hashes into blocks of about BLOCK members or BLOCK_BYTES bytes. Two blocks whose bins may match are a tile.
A tile counts common elements by a product of small matrices and gives only the links that join components. So no link is lost, no task
holds more than a few blocks, and a block, not a member, is the row that meets others. A block is found by counting and hashing alone; no bucket is
ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_side
from .components import connected_components

BLOCK, BLOCK_BYTES, BIN = 1024, 8 << 20, 0.04
#: Tiles, of two blocks each, that a Python task holds at a time.
TILES = 8
#: Pairs of texts that it holds at a time.
PAIRS = 1024
#: Columns of the incidence matrix that are multiplied at a time.
COLUMNS = 4096
#: Elements in this many sets of a tile or more count as frequent.
OFTEN = 16
#: Members of a tile up to which its sets meet pair by pair, and characters of tiles that are split into elements together.
FEW, TOGETHER = 5, 1 << 18
SLIM = 1e-9
#: Bytes of a row of two numbers in a broadcast table.
PAIR_BYTES = 40


def compared(pairs: DataFrame, bodies: DataFrame, verify: Callable) -> DataFrame:
    """(a, b, similarity, same, size of b's body) of pairs; `bodies` has node and body, `verify` maps Arrow batches of a, b, body_a, body_b, size."""
    left = bodies.select(F.col("node").alias("b"), F.col("body").alias("body_b"))
    right = bodies.select(F.col("node").alias("a"), F.col("body").alias("body_a"))
    joined = pairs.join(left, "b").join(right, "a").select("a", "b", "body_a", "body_b", F.octet_length("body_b").cast("long").alias("size"))
    return joined.mapInArrow(verify, "a long, b long, similarity double, same boolean, size long")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements sets i < j share, above the diagonal: elements in many sets by a product of incidence matrices, the others pair by pair."""
    n = len(sets)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, row = values[order], np.repeat(np.arange(n), [len(s) for s in sets])[order]
    times = np.diff(np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))) if len(values) else np.zeros(0, np.int64)
    out = np.zeros((n, n), np.float32)
    often = times >= OFTEN
    width, per = int(often.sum()), np.repeat(often, times)
    hot_row, hot_column = row[per], np.repeat(np.arange(width), times[often])
    for at in range(0, width, COLUMNS):
        low, high = np.searchsorted(hot_column, (at, at + COLUMNS))
        x = np.zeros((n, min(COLUMNS, width - at)), np.float32)
        x[hot_row[low:high], hot_column[low:high] - at] = 1
        out += x @ x.T
    starts = np.cumsum(times) - times
    for size in range(2, OFTEN):
        first = starts[times == size]
        if len(first):
            i, j = np.triu_indices(size, 1)
            pairs = row[first[:, None] + i] * n + row[first[:, None] + j]
            out += np.bincount(pairs.ravel(), minlength=n * n).reshape(n, n)
    return np.triu(out, 1)


def jaccard(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common elements over all elements of two sets."""
    return common / np.maximum(a + b - common, 1)


def of_larger(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common elements over those of the larger set; 1 minus this is a metric too."""
    return common / np.maximum(np.maximum(a, b), 1)


def common_of(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many elements sets a[k] and b[k] share, for each k; the elements of a set are distinct."""
    out = np.zeros(len(a), np.int64)
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        both = np.concatenate((sets[i], sets[j]))
        both.sort()
        out[k] = np.count_nonzero(both[1:] == both[:-1])
    return out


def alike_pairs(components: list[int], sets: list[np.ndarray], measure: Callable, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the members of different components whose similarity reaches the limit, the likest first."""
    sizes, own = np.array([len(s) for s in sets]), np.array(components)
    a, b = np.nonzero(np.triu(own[:, None] != own[None], 1))
    if len(sets) <= FEW:
        common = common_of(sets, a, b)
    else:
        common = common_counts(sets)[a, b]
    similarity = measure(common, sizes[a], sizes[b])
    near = np.flatnonzero(similarity >= limit - SLIM)
    near = near[np.argsort(-similarity[near], kind="stable")]
    return a[near], b[near]


def joining_links(components: list[int], sets: list[np.ndarray], confirm: Callable, measure: Callable, limit: float) -> list[tuple[int, int]]:
    """Pairs of components with members that match, as many as join them, the likest first. confirm decides on two places."""
    parent = {c: c for c in components}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    links = []
    for i, j in zip(*(x.tolist() for x in alike_pairs(components, sets, measure, limit))):
        if root(components[i]) != root(components[j]) and confirm(i, j):
            parent[root(components[i])] = root(components[j])
            links.append((components[i], components[j]))
    return links


def tile_links(elements: Callable, measure: Callable, limit: float) -> Callable:
    """Over tiles, rows of the members (component, body) of one block, and of another, or null for a block with itself. Small tiles are split into elements together."""

    def linked(tiles: list[list[dict]]) -> list[tuple[int, int]]:
        place: dict[str, int] = {}
        at = [[place.setdefault(m["body"] or "", len(place)) for m in members] for members in tiles]
        sets, confirm = elements(list(place))
        links: list[tuple[int, int]] = []
        for members, own in zip(tiles, at):
            links += joining_links([m["component"] for m in members], [sets[k] for k in own], lambda i, j, own=own: confirm(own[i], own[j]), measure, limit)
        return links

    def rows(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, size = [], 0  # small tiles wait for others, also of later batches
        for batch in batches:
            for one, other in zip(batch.column(0), batch.column(1)):
                members = one.as_py() + (other.as_py() or [])
                if len({m["component"] for m in members}) > 1:
                    tiles.append(members)
                    size += sum(len(m["body"] or "") for m in members)
                if size > TOGETHER:
                    yield rows(linked(tiles))
                    tiles, size = [], 0
        if tiles:
            yield rows(linked(tiles))

    return found


def shared_keys(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, node, n) of the keys that two or more nodes have, one key for each set of nodes; n is their number. The rows are shuffled once, for the counts and for the members."""
    dealt = keys.where("key IS NOT NULL").repartition("key")
    marks = dealt.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("n > 1")
    marks = marks.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")  # grow with the input: a shuffle, whatever their number
    return scratch.put(dealt.join(marks.hint("shuffle_hash"), "key").select("key", "node", "n"))


def in_small_batches(scratch: Scratch, df: DataFrame, rows: int) -> DataFrame:
    """df, whose Python tasks hold so many rows at a time, as a table."""
    conf, key = scratch.spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(rows))
    try:
        return scratch.put(df)
    finally:
        conf.set(key, before)


def with_leaders(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, a, b, n): each member b of a bucket beside its leader a, the member with most company."""
    company = members.withColumn("company", F.sum("n").over(Window.partitionBy("node")))  # a node has as many rows as keys
    leaders = scratch.put(company.groupBy("key").agg(F.max(F.struct("company", (-F.col("node")).alias("minus"))).alias("lead")).select("key", (-F.col("lead.minus")).alias("a")))
    led = scratch.put(members.join(small_side(leaders, leaders.count() * PAIR_BYTES), "key").select("key", "a", F.col("node").alias("b"), "n"))
    scratch.drop(leaders)
    return led


def told_of(led: DataFrame, bodies: DataFrame, verify: Callable, scratch: Scratch) -> DataFrame:
    """What `verify` tells of the members and their leaders."""
    return in_small_batches(scratch, compared(led.where("a <> b").select("a", "b").distinct(), bodies, verify), PAIRS)


def linked_components(
    keys: DataFrame, bodies_of: Callable[[DataFrame], DataFrame], verify: Callable, elements: Callable, measure: Callable, limit: float, scratch: Scratch, early: int = 0
) -> DataFrame:
    """(node, component) of the nodes that match others; the component is its least node. `keys` has key and node; bodies_of(nodes) gives node and body of the
    nodes that share a key; verify compares pairs (Arrow) and tells their similarity by `measure`; elements gives the sorted elements of each text, and a function that decides on
    the places of two texts whose elements are alike enough.

    With `early`, one bucket in so many, by its key, is compared with its leader and joined first. Buckets whose members are all in one component by then are done, which
    for a family of copies are nearly all; the others go on, those first ones too."""
    members = shared_keys(keys, scratch)
    bodies = bodies_of(members.select("node").distinct())
    known = None
    if early:
        led = with_leaders(members.where(F.pmod("key", F.lit(early)) == 0), scratch)
        told = told_of(led, bodies, verify, scratch)
        joined = connected_components(told.where("same").select("a", "b"), scratch)
        known = joined.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        scratch.drop(led, told)
        own = F.coalesce("component", "node")
        open_keys = members.join(joined, "node", "left").groupBy("key").agg(F.min(own).alias("least"), F.max(own).alias("most")).where("least <> most").select("key")
        rest = scratch.put(members.join(open_keys, "key", "left_semi"))
        scratch.drop(members)
        members = rest
    led = with_leaders(members, scratch)
    scratch.drop(members)
    told = told_of(led, bodies, verify, scratch)
    links = told.where("same").select("a", "b")
    links = links if known is None else scratch.put(links.union(known))
    component = connected_components(links, scratch)
    placed = led.where("n > 2").join(told.drop("same"), ["a", "b"], "left").join(component.withColumnRenamed("node", "b"), "b", "left")
    placed = scratch.put(placed.select("key", F.col("b").alias("node"), F.coalesce("component", "b").alias("component"), F.floor(F.coalesce("similarity", F.lit(1.0)) / BIN).alias("bin"), F.coalesce("size", F.lit(0)).alias("size")))
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    parts = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    slight = (F.col("n") <= BLOCK) & (F.col("size") <= BLOCK_BYTES)
    mixed = scratch.put(parts.where("parts > 1").select("key", F.col("most.component").alias("main"), slight.alias("slight")))
    scratch.drop(led)
    if left := mixed.count():
        placed = placed.join(small_side(mixed, left * PAIR_BYTES), "key").withColumn("kind", F.when(~F.col("slight") & (F.col("component") == F.col("main")), 1).otherwise(0))
        placed = placed.withColumn("bin", F.when(F.col("slight"), 0).otherwise(F.col("bin")))
        counts = placed.groupBy("key", "bin", "kind").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_BYTES)).alias("blocks"))
        counts = scratch.put(counts)
        number = lambda sub: ((F.col("bin") * 2 + F.col("kind")) * F.lit(1 << 32) + sub)
        blocks = counts.select("key", "bin", "kind", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("sub")).select("key", "bin", "kind", number(F.col("sub")).alias("block"))
        first, second = (blocks.select("key", F.col("bin").alias(f"bin_{c}"), F.col("kind").alias(f"kind_{c}"), F.col("block").alias(c)) for c in "ij")
        near = (F.abs(F.col("bin_i") - F.col("bin_j")) - 1) * BIN <= 1 - limit + SLIM
        tiles = first.join(second, "key").where((F.col("i") < F.col("j")) & (F.col("kind_i") + F.col("kind_j") < 2) & near).select("key", "i", "j")
        sub = F.pmod(F.xxhash64("node"), F.col("blocks"))
        dealt = placed.join(counts, ["key", "bin", "kind"]).select("key", "node", "component", number(sub).alias("block")).join(bodies, "node")
        packed = scratch.put(dealt.groupBy("key", "block").agg(F.collect_list(F.struct("component", "body")).alias("members")))  # about BLOCK members at most
        one, other = (packed.select("key", F.col("block").alias(c), F.col("members").alias(f"members_{c}")) for c in "ij")
        own = F.shiftright("block", 32).bitwiseAND(F.lit(1)) == 0  # the block's kind: those of the main component are not compared among themselves
        whole = packed.where(own).select(F.col("members").alias("members_i"), F.lit(None).cast(packed.schema["members"].dataType).alias("members_j"))
        pairs = tiles.join(one, ["key", "i"]).join(other, ["key", "j"]).select("members_i", "members_j")
        links = in_small_batches(scratch, whole.union(pairs).mapInArrow(tile_links(elements, measure, limit), "a long, b long"), TILES)
        joined = connected_components(links, scratch)
        alone = joined.select("node").join(component, "node", "left_anti").select("node", F.col("node").alias("component"))
        onward = joined.select(F.col("node").alias("component"), F.col("component").alias("on"))
        component = scratch.put(component.unionByName(alone).join(onward, "component", "left").select("node", F.coalesce("on", "component").alias("component")))
    return component
