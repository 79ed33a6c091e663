"""The reading order of a page's blocks, by recursive cuts along white space.

A region is cut into columns where white space runs through all of it from top to bottom. Where none does, the widest blocks are set aside, step by step, until one does between two of them: those
are headings, wide figures and footers, and cut the region into bands, each read on its own, from top to bottom. Without columns a region is cut between lines of blocks. What cannot be cut is
read by top and left edge. A page's blocks are a bounded group, read in one function; pages are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space that parts columns, and rows, at least, in the units of the blocks; widths that are tried for the blocks set aside.
COLUMN_GAP, ROW_GAP, WIDTHS = 5.0, 0.0, 16


def cut(low: np.ndarray, high: np.ndarray, gap: float) -> list[np.ndarray]:
    """Groups of intervals, each more than `gap` away from the next."""
    order = np.argsort(low, kind="stable")
    reach = np.maximum.accumulate(high[order])
    edges = np.flatnonzero(low[order][1:] > reach[:-1] + gap) + 1
    return np.split(order, edges)


def ordered(box: np.ndarray, own: np.ndarray) -> list[int]:
    """Numbers of the blocks `own` of boxes (x0, y0, x1, y1) in reading order."""
    if len(own) <= 1:
        return own.tolist()
    x0, y0, x1, y1 = box[own].T
    columns = cut(x0, x1, COLUMN_GAP)
    if len(columns) > 1:
        return [i for c in columns for i in ordered(box, own[c])]
    widths = np.unique(x1 - x0)[::-1]
    for most in widths[np.unique(np.linspace(0, len(widths) - 1, min(WIDTHS, len(widths))).astype(int))]:
        wide = x1 - x0 >= most
        if wide.all():
            break
        parts = bands(y0, y1, wide)
        if any(len(cut(x0[b], x1[b], COLUMN_GAP)) > 1 for b in parts):
            return [i for b in parts for i in ordered(box, own[b])]
    rows = cut(y0, y1, ROW_GAP)
    if len(rows) > 1:
        return [i for r in rows for i in ordered(box, own[r])]
    return own[np.lexsort((x0, y0))].tolist()


def bands(y0: np.ndarray, y1: np.ndarray, wide: np.ndarray) -> list[np.ndarray]:
    """The wide blocks by their top edge, and between them the others, by the middle of their height."""
    separators = np.flatnonzero(wide)[np.argsort(y0[wide], kind="stable")]
    others = np.flatnonzero(~wide)
    after = np.searchsorted((y0 + y1)[separators], (y0 + y1)[others], side="right")
    out = []
    for k in range(len(separators) + 1):
        if (own := others[after == k]).size:
            out.append(own)
        if k < len(separators):
            out.append(separators[k : k + 1])
    return out


def reading_order(blocks: DataFrame, *page: str) -> DataFrame:
    """page, block and place (from 1) of blocks (page, block, x0, y0, x1, y1); blocks without a full box come last, by number. A page is a row of lists, so a task works
    through batches of pages."""
    kinds = dict(blocks.dtypes)
    sides = ("x0", "y0", "x1", "y1")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(page))
            rows, numbers = lists.flatten(), pc.list_parent_indices(lists)
            sort = pc.sort_indices(pa.table({"page": numbers, "block": rows.field("block")}), [("page", "ascending"), ("block", "ascending")])
            box = np.stack([rows.field(c).take(sort).to_numpy(zero_copy_only=False).astype(np.float64) for c in sides], axis=1).reshape(-1, 4)
            whole = ~np.isnan(box).any(axis=1)
            order, places, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
            for n in pc.list_value_length(lists).to_pylist():
                own = whole[at : at + n]
                order.append(at + np.array(ordered(box[at : at + n], np.flatnonzero(own)) + np.flatnonzero(~own).tolist(), np.int64))
                places.append(np.arange(1, n + 1))
                at += n
            taken = sort.take(pa.array(np.concatenate(order)))
            pages = numbers.take(taken)
            columns = [*(batch.column(k).take(pages) for k in range(len(page))), rows.field("block").take(taken), pa.array(np.concatenate(places))]
            yield pa.RecordBatch.from_arrays(columns, names=[*page, "block", "place"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in (*page, "block")) + ", place long"
    boxes = F.struct("block", *[F.col(c).cast("double").alias(c) for c in sides])
    return blocks.groupBy(*page).agg(F.collect_list(boxes).alias("boxes")).mapInArrow(placed, schema)
