"""The order of pages with columns, headings, figures and footers."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.sources import layout


def column(x, w, y, heights, gap=2):
    out = []
    for h in heights:
        out.append((x, y, x + w, y + h))
        y += h + gap
    return out


def order_of(spark, boxes):
    shuffled = list(enumerate(boxes))
    random.Random(1).shuffle(shuffled)
    df = spark.createDataFrame([("a", n, *map(float, b)) for n, (_, b) in enumerate(shuffled)], "page string, block long, x0 double, y0 double, x1 double, y1 double")
    rows = layout.reading_order(df, "page").orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(1, len(boxes) + 1))
    return [shuffled[r["block"]][0] for r in rows]


def heading(y, h=12):
    return [(0, y, 300, y + h)]


PAGES = {
    "three columns under a heading": heading(0) + column(0, 90, 20, [10, 30, 12, 8]) + column(105, 90, 20, [40, 10, 10]) + column(210, 90, 20, [5, 5, 5, 50]),
    "aligned rows of columns": heading(0) + column(0, 90, 20, [10] * 5) + column(105, 90, 20, [10] * 5) + column(210, 90, 20, [10] * 5),
    "headings and a footer": heading(0) + column(0, 140, 20, [10, 10]) + column(160, 140, 20, [25]) + heading(60) + column(0, 90, 80, [10]) + column(105, 90, 80, [10, 4]) + column(210, 90, 80, [9]) + heading(120, 5),
    "a wide figure in two columns": column(0, 140, 0, [10, 10]) + column(160, 140, 0, [22]) + [(0, 30, 300, 80)] + column(0, 140, 90, [10]) + column(160, 140, 90, [10, 10]),
    "one column": column(0, 200, 0, [10, 20, 5, 9]),
    "columns in a column": column(0, 140, 0, [10]) + column(0, 60, 20, [5, 5]) + column(75, 60, 20, [5, 5]) + column(160, 140, 0, [40]),
    "overlapping blocks": [(0, 0, 50, 10), (2, 4, 60, 14), (1, 8, 55, 20)],
    "one block": [(0, 0, 1, 1)],
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_pages(spark, name):
    assert order_of(spark, PAGES[name]) == list(range(len(PAGES[name])))


def test_odd_blocks(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 9.0, 5.0, 12.0), (1, 2, None, 0.0, 5.0, 3.0), (1, 3, 0.0, 0.0, 5.0, 3.0), (2, 1, 0.0, 0.0, 1.0, 1.0)], "page int, block int, x0 double, y0 double, x1 double, y1 double")
    assert {(r["page"], r["place"]): r["block"] for r in layout.reading_order(df, "page").collect()} == {(1, 1): 3, (1, 2): 1, (1, 3): 2, (2, 1): 1}
    assert layout.reading_order(df.where(F.lit(False)), "page").count() == 0


def test_pages_are_read_in_batches_not_group_by_group(spark):
    rows = [(p, b, x, y, x + 10, y + 5) for p in range(4) for b, x, y in [(9, 0.0, 20.0), (3, 0.0, 0.0), (5, 50.0, 0.0), (5, 50.0, 10.0)]] + [(7, 2, None, 0.0, 1.0, 1.0), (7, 1, None, 0.0, 1.0, 1.0), (7, None, 0.0, 0.0, 1.0, 1.0)]
    found = layout.reading_order(spark.createDataFrame(rows, "page int, block int, x0 double, y0 double, x1 double, y1 double"), "page")
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    got = sorted((r["page"], r["place"], r["block"]) for r in found.collect())
    assert got == [(p, k + 1, b) for p in range(4) for k, b in enumerate((3, 9, 5, 5))] + [(7, 1, None), (7, 2, 1), (7, 3, 2)]
