"""What op1 and op11 send through the driver: a bounded sample, and no table that grows with the input."""

import re

import numpy as np
import pytest

from tidewell.llm import ball_tree as bt
from tidewell.llm import topk_blocks as tb


def vectors(spark, n, parts):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in x], int(i % 3)) for i, x in enumerate(rng.normal(size=(n, 4)))]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(parts)


def test_the_sample_does_not_grow_with_tasks(spark, monkeypatch):
    monkeypatch.setattr(tb, "SAMPLE", 20)
    for v in (tb.integers(vectors(spark, 4000, 40)), bt.usable(vectors(spark, 4000, 40))):
        size, dims = tb.size_of(v)
        assert (size, dims) == (4000, 4) and 10 <= tb.sampled(v, size).count() <= 80
    same = tb.integers(spark.range(2000).selectExpr("7L AS vec_id", "array(1.0D, 2.0D) AS embedding"))
    assert tb.sampled(same, 2000).count() <= 1


@pytest.mark.parametrize("module, run", [(tb, lambda df: tb.top_k(df)), (bt, lambda df: bt.hard_negatives(df))])
def test_no_part_is_broadcast(spark, monkeypatch, module, run):
    plans, keep = [], module.few_at_once

    def seen(df, task, schema, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, task, schema, name)

    monkeypatch.setattr(module, "few_at_once", seen)
    run(vectors(spark, 1000, 4)).collect()
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "4096"
    with_parts = [p for p in plans if "Join" in p and "docs" in p]
    assert [re.search(r"\w+Join", p)[0] for p in with_parts] == ["SortMergeJoin"] * (1 if module is tb else 3)


def test_few_large_rows_are_read_at_a_time(spark, tmp_path, monkeypatch):
    """Rows of megabytes, small in their files, would fill a task by thousands."""
    sizes, write = [], tb.written
    monkeypatch.setattr(tb, "written", lambda df, name: sizes.append(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) or write(df, name))
    spark.range(100).write.parquet(f"{tmp_path}/rows")
    out = tb.few_at_once(spark.read.parquet(f"{tmp_path}/rows"), lambda batches: batches, "id long", "rows")
    assert out.count() == 100 and sizes == [str(tb.TILES)]
