"""A session with the settings that the operators are written for."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes, as the optimizer estimates them, up to which a side may be broadcast; beyond it the join shuffles, unless adaptive execution finds it smaller.
BROADCAST_BYTES = 16 << 20


def session(master: str | None = None, partitions: int | None = None) -> SparkSession:
    """UTC, adaptive execution and Arrow; partitions only where the default of 200 is wrong, as in local tests."""
    builder = SparkSession.builder.appName("tidewell").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a result's size, from the sizes of its files; nothing runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, of: DataFrame | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if the estimated bytes are within the limit: of df, or of `of`, where df has no more rows than that and of its kind."""
    return F.broadcast(df) if planned_bytes(df if of is None else of) <= limit else df


#: Bytes, as the optimizer estimates them, under which an input is dealt over all cores before work on its texts, and of a part of a larger one that is dealt.
SPREAD_BYTES, PART_BYTES = 512 << 20, 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it is small or few of its tasks hold its rows: a row group is one task, however large it is and however much work its texts are. Rows of a larger
    input are counted by task, for which no column that nothing asks for is read; one whose tasks are even stays where it is.

    What a later filter asks for is worked out before the rows are dealt, as the optimizer moves filters down; so filters on the results of such work belong behind it."""
    cores, size = df.sparkSession.sparkContext.defaultParallelism, planned_bytes(df)
    if size > SPREAD_BYTES:
        rows = [r["n"] for r in df.select(F.spark_partition_id().alias("part")).groupBy("part").agg(F.count("*").alias("n")).collect()]  # a row a task
        if not rows or 2 * max(rows) * cores <= 3 * sum(rows):
            return df
    return df.repartition(max(cores, -(-size // PART_BYTES)))


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``, which driver and executors share; only a local session may do without, with a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidewell-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tidewell-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: what several branches read is worked out once, and lost executors cost no more than reading it."""
    return stored(df, new_path(df.sparkSession, name))


def stored(df: DataFrame, path: str) -> DataFrame:
    """df as a Parquet table at `path`, read again."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cleared(spark: SparkSession) -> None:
    """Delete the application's folder, once nothing reads its tables any more."""
    delete(spark, shared_folder(spark))
