"""Token ids in ORC: stripes of run-length encoded integers, row indexes, and Bloom filters on document ids.

Documents are range-partitioned and sorted by id, encoded, and written one file a partition. ORC's writer cuts a file into stripes,
stores integers run-length encoded, keeps the least and greatest id of each stripe and row group, and a Bloom filter of the ids. A
reader asks Spark's ORC source with a filter on doc_id, and stripes or row groups that cannot hold the id are skipped; without a
filter, a file is split by stripes over tasks.

Nulls: a null text is an empty document, which holds the end id alone; a null id sorts first. Repeated rows are written each time; rows
of one id are ordered by a hash of their text, and such ties may fall in neighbouring files. Very long texts are encoded whole, one at a
time, as one row. An empty table gives no rows. Only
doc_id and text are read; further columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import new_path, slices, texts_of

END_ID = 2
SCHEMA = "doc_id long, part int, local_start long, n_tokens long, tokens array<int>"
OPTIONS = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.stripe.size": str(16 << 20), "orc.row.index.stride": "2000", "orc.create.index": "true"}


def encoder(tokenizer_path: str, end_id: int):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in slices(batches, most=8 << 20):
            ids, lengths = bpe.encode(texts_of(batch), tokenizer_path)
            ends = np.cumsum(lengths + 1)
            out = np.full(int(ends[-1]), end_id, np.int32)
            out[bpe.gathered(ends - lengths - 1, lengths)] = ids
            offsets = np.concatenate([[0], ends])
            n = len(lengths)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(start + offsets[:-1]), pa.array(lengths + 1), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))], names=["doc_id", "part", "local_start", "n_tokens", "tokens"])
            start += int(offsets[-1])

    return encoded


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Encode whole texts and write them in ascending order of doc_id to ORC files at `path`."""
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = ranged.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ranged.mapInArrow(encoder(tokenizer_path, end_id), SCHEMA).write.options(**OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files; filters on doc_id reach the stripes' metadata."""
    return spark.read.schema(SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """Documents of a few ids, by stripe statistics and Bloom filters."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(ids))


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(batch.schema.get_field_index("tokens"))
        flat, offsets = lists.flatten().to_numpy().astype("<u4"), lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        view = memoryview(flat.tobytes())
        sums = [zlib.crc32(view[4 * int(a) : 4 * int(b)]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.int64())], names=[*batch.schema.names[:-1], "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, all from the files.

    The files' totals, one number a file, give where each file starts."""
    rows = read_tokens(spark, path)
    totals = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts, at = [], 0
    for part, n in totals:
        starts.append((part, at))
        at += n
    bases = spark.createDataFrame(starts, "part int, base long")
    summed = rows.select("doc_id", "part", "local_start", "n_tokens", "tokens").mapInArrow(digests, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return summed.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def tokens_written_and_read(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    path = path or new_path(spark, "orc-tokens")
    write_tokens(docs, path, tokenizer_path)
    return token_index(spark, path)
