"""What the operators of this subpackage share: the shared folder, cut lineage, and null-safe inputs."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a Python task holds at a time; longer documents are processed one by one.
SLICE_BYTES = 16 << 20
#: Bytes in memory up to which a table is broadcast; beyond, the same join shuffles.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only a local session may do without, with a temporary one."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidewell-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """The rows of df, written as Parquet at path and read again: lineage ends there, and lost executors cost no recomputation."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a compressed Parquet table in the shared folder."""
    return stored(df, new_path(df.sparkSession, name))


class Scratch:
    """Tables of one run below one folder of the shared folder, each deleted once nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder, self.paths, self.n = spark, new_path(spark, name), {}, 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        table = stored(df, path := f"{self.folder}/{self.n}")
        self.paths[id(table)] = table, path  # the table is held, so its id stays its own
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that were put; others are left alone."""
        for table in tables:
            if found := self.paths.pop(id(table), None):
                delete(self.spark, found[1])

    def drop_all(self) -> None:
        self.paths.clear()
        delete(self.spark, self.folder)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def unreserved(docs: DataFrame) -> DataFrame:
    """docs, if it has no column whose name begins with `__`, as the operators' own do; else an error."""
    if clash := [c for c in docs.columns if c.startswith("__")]:
        raise ValueError(f"columns whose names begin with __ are reserved: {clash}")
    return docs


def small_side(df: DataFrame, size: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint where the counted bytes allow it; else the join shuffles."""
    return F.broadcast(df) if size <= limit else df


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a number from 1 for each row in `order`, in column `name`: rows are dealt by ranges, numbered in each task, and raised by the counts of the
    tasks before, which are a row each."""
    dealt = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    parts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(parts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base")), "bases")
    own = Window.partitionBy("__part").orderBy(*order)
    out = dealt.join(small_side(bases, bases.count() * 64), "__part").withColumn(name, (F.col("__base") + F.row_number().over(own)).cast("long"))
    return out.drop("__part", "__base")


def bucket_of(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id gives -1, no bucket."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1).cast("long"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds at most about `most` bytes of text, or a single row."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column as strings, null as empty."""
    import pyarrow.compute as pc

    return pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.string()), "")
