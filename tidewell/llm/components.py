"""Distributed union-find over links between nodes, by contraction.

Nodes are taken in the order of a hash that maps no two longs to one, so that their order is random. In each round every node points to the least of itself and its
neighbours and from there one step on (pointer jumping); links are then rewritten to what their ends point to, those within one node go, and
equal ones are merged. A star is done after two rounds, and a chain loses two thirds of its nodes or so in each; only
nodes still linked take part. At the end the rounds' pointers are followed one after another.

Links are counted in each round. A round's tables have a task for TASK_ROWS rows at most, not one for each partition of a shuffle, and its pointers are broadcast up to
POINTER_BYTES: what is left after a round or two is small, and the driver would keep and report far more tasks than rows ask for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_side

#: Rows for which a table of a round has a task, bytes of a row of two numbers in a broadcast table, and bytes up to which pointers are broadcast.
TASK_ROWS, ROW_BYTES, POINTER_BYTES = 1 << 15, 40, 2 << 20


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """df of so many rows at most in no more tasks than they ask for."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def connected_components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for every node of links (a, b); the component is its least node. Links of a node with itself are left out.

    A hub's links are combined before the shuffle by the minimum, and joins on a hub may be split, as one side is unique."""
    scratch = scratch or Scratch(links.sparkSession, "components")
    links = scratch.put(links.where("a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).distinct())
    left = links.count()
    nodes = 2 * left  # at most
    rounds: list[DataFrame] = []
    while left:
        ends = 2 * left
        pointing = lambda df: small_side(df, ends * ROW_BYTES, POINTER_BYTES)  # noqa: E731, B023
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("at")).agg(F.min_by("b", F.xxhash64("b")).alias("b"))
        near = scratch.put(few_tasks(near.select("at", F.when(F.xxhash64("b") < F.xxhash64("at"), F.col("b")).otherwise(F.col("at")).alias("to")), ends))
        ahead = near.select(F.col("at").alias("to"), F.col("to").alias("root"))
        rounds.append(scratch.put(few_tasks(near.join(pointing(ahead), "to").select("at", "root"), ends)))
        of_a, of_b = (pointing(rounds[-1].select(F.col("at").alias(c), F.col("root").alias(f"root_{c}"))) for c in "ab")
        shorter = links.join(of_a, "a").join(of_b, "b").where("root_a <> root_b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b"))
        shorter = scratch.put(few_tasks(shorter.distinct(), left))
        scratch.drop(links, near)
        links, left = shorter, shorter.count()
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = rounds[0].select(F.col("at").alias("node"), F.col("root").alias("at"))  # the first round has all nodes
    for pointers in rounds[1:]:
        onward = pointers.select(F.col("at"), F.col("root").alias("on"))
        labels = labels.join(onward, "at", "left").select("node", F.coalesce("on", "at").alias("at"))
    labels = scratch.put(few_tasks(labels, nodes))
    least = small_side(labels.groupBy("at").agg(F.min("node").alias("component")), nodes * ROW_BYTES, POINTER_BYTES)
    out = scratch.put(few_tasks(labels.join(least, "at").select("node", "component"), nodes))
    scratch.drop(links, labels, *rounds)
    return out
