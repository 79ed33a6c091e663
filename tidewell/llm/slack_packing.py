"""Packing into sequences of at most `capacity` tokens by minimum bin slack.

Documents become pieces: a longer document is cut into pieces of exactly the capacity, but for its first, which takes the rest. Pieces
of full length fill a sequence each. For the others, only the number of pieces of each length below the capacity matters, a table of
at most capacity - 1 numbers. On it the driver repeats: seed a bin with the longest length left, find by a bitset subset-sum
dynamic program over the available lengths the fullest combination that fits beside it, and remove that combination as often as all
its lengths still allow. Each step uses up a length or brings it below its share, so the plan is short whatever the input's size.

Pieces then find their places with joins alone: each gets its rank among those of its length (a count for each task and length plus a
rank within the task), and the plan tells which ranks of a length go to which sequence and offset.

Nulls: a null text is an empty document, one end id long. Ties: of pieces of equal length those of earlier tasks, then of smaller doc_id and piece come first; of equal
combinations the one with the longest lengths. Repeated rows are packed each time. Very long documents give many pieces. An
empty table gives no rows. Columns besides doc_id and text play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import bpe
from .common import slices, texts_of, written

END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int"


def piece_cutter(tokenizer_path: str, capacity: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for batch in slices(batches, most=8 << 20):
            ids, lengths = bpe.encode(texts_of(batch), tokenizer_path)
            ends = np.cumsum(lengths + 1)
            out = np.full(int(ends[-1]), end_id, "<u4")
            out[bpe.gathered(ends - lengths - 1, lengths)] = ids
            total = lengths + 1
            counts = -(-total // capacity)
            row = np.repeat(np.arange(len(total)), counts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            first = total - (counts - 1) * capacity
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[row], capacity)
            begin = (ends - total)[row] + start
            view = memoryview(out.tobytes())
            sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(np.full(len(row), task, np.int32))], names=["doc_id", "piece", "start", "length", "ids_crc32", "task"])

    return cut


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document, with the task that cut them."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(piece_cutter(tokenizer_path, capacity, end_id), PIECES)


def fullest(room: int, counts: dict[int, int]) -> dict[int, int]:
    """The combination of available lengths that fills `room` best: subset sums as bits of an integer, longest lengths first."""
    mask = (1 << (room + 1)) - 1
    sums, steps, lengths = 1, [], []
    for length in sorted((x for x in counts if counts[x] and x <= room), reverse=True):
        steps.append(sums)
        lengths.append(length)
        shifted = sums
        for _ in range(min(counts[length], room // length)):
            shifted = (shifted << length) & mask
            if not shifted:
                break
            sums |= shifted
        if sums >> room & 1:
            break
    left, chosen = sums.bit_length() - 1, {}
    for length, before in zip(reversed(lengths), reversed(steps)):
        n = 0
        while not before >> (left - n * length) & 1:
            n += 1
        if n:
            chosen[length] = n
            left -= n * length
    return chosen


def bin_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how many bins, how many pieces of each length in such a bin), over all pieces counted."""
    left, plan = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        seed = max(left)
        rest = dict(left)
        rest[seed] -= 1
        combination = fullest(capacity - seed, rest)
        combination[seed] = combination.get(seed, 0) + 1
        times = min(left[k] // n for k, n in combination.items())
        plan.append((times, combination))
        for k, n in combination.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plan


def places(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, list[int], list[int], list[int], list[int]]]:
    """For each length: the first ranks of its runs, and of each run its first sequence, pieces a sequence and first offset."""
    by_length: dict[int, list[list[int]]] = {}
    sequence = 0
    for times, combination in plan:
        offset = 0
        for length in sorted(combination, reverse=True):
            runs = by_length.setdefault(length, [[], [], [], [], [0]])
            for row, value in zip(runs, (runs[4][0], sequence, combination[length], offset)):
                row.append(value)
            runs[4][0] += times * combination[length]
            offset += length * combination[length]
        sequence += times
    return [(length, *runs[:4]) for length, runs in by_length.items()]


def packed(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Each piece with sequence_id and offset; `pieces` has a length and the task that made the row, and is read twice."""
    counted = written(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    by_length = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = places(bin_plan(by_length, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    columns = [c for c in pieces.columns if c != "task"]
    ranked = pieces.withColumn("local", F.row_number().over(Window.partitionBy("task", "length").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(base, ["task", "length"]).withColumn("rank", F.col("base") + F.col("local"))
    ranked = ranked.select(*columns, F.col("rank").alias("__rank"))
    schema = StructType([*ranked.schema.fields[:-1], StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(placer(runs), schema)


def placer(runs: list[tuple[int, list[int], list[int], list[int], list[int]]]):
    """Sequence and offset of pieces by length and rank (the last column), by bisection in the runs of their length; the plan's size is that of the bins' kinds, whatever the input's."""
    by_length = {length: tuple(np.array(x, np.int64) for x in rest) for length, *rest in runs}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(batch.schema.get_field_index("length")).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                firsts, sequences, shares, offsets = by_length[int(k)]
                own = np.flatnonzero(length == k)
                run = np.searchsorted(firsts, rank[own], side="right") - 1
                within, share = rank[own] - firsts[run], shares[run]
                sequence[own], offset[own] = sequences[run] + within // share, offsets[run] + k * (within % share)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return placed


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = END_ID) -> DataFrame:
    return packed(written(pieces_of(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
