"""Sinks that a repeated batch leaves as they are, and the repair of rows that failed.

A batch's rows lie below ``rows/sink_batch=<id>``, written whole; its line below ``ledger/sink_batch=<id>`` comes last and commits it. A batch that is in the ledger is not written again; one that
was cut short before is written over. Readers take the rows of committed batches alone, so each batch counts exactly once, however often it is tried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class LedgerSink:
    """A sink at `path`, a folder that driver and executors share, for rows of the schema; use `write` with foreachBatch. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def committed(self, batch: int) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/ledger/sink_batch={batch}/_SUCCESS")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def exists(self) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/ledger")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def write(self, rows: DataFrame, batch: int) -> None:
        if self.committed(batch):
            return
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/sink_batch={batch}")
        line = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/sink_batch={batch}").agg(F.count("*").alias("n"))
        line.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/sink_batch={batch}")

    def ledger(self) -> DataFrame:
        """sink_batch, n, at of each committed batch."""
        if not self.exists():
            return self.spark.createDataFrame([], "sink_batch long, n long, at timestamp")
        return self.spark.read.schema("n long, at timestamp, sink_batch long").option("basePath", f"{self.path}/ledger").parquet(f"{self.path}/ledger/sink_batch=*").select("sink_batch", "n", "at")

    def rows(self) -> DataFrame:
        """The rows of committed batches, with sink_batch."""
        if not self.exists():
            return self.spark.createDataFrame([], f"{self.schema}, sink_batch long")
        rows = self.spark.read.schema(f"{self.schema}, sink_batch long").option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows/sink_batch=*")
        return rows.join(F.broadcast(self.ledger().select("sink_batch")), "sink_batch", "left_semi").select(*rows.columns)  # a row a batch; prunes partitions


#: Tries of a row at most, and rows of a round.
MOST_TRIES, ROUND_ROWS = 6, 50
OUTCOMES = "id long, tries int, outcome string"


class RepairQueue:
    """Rows (id, ...) that failed, tried again round by round, a round at most once whatever fails between.

    `failures` is a sink of the rows; outcomes of rounds go to a second one, and a row's state is its last outcome: pending or `retry` until it is `done`, or `dead` after
    `most` tries."""

    def __init__(self, failures: LedgerSink, most: int = MOST_TRIES, rows: int = ROUND_ROWS) -> None:
        self.failures, self.most, self.n_rows = failures, most, rows
        self.outcomes = LedgerSink(failures.spark, f"{failures.path}/outcomes", OUTCOMES)

    def states(self) -> DataFrame:
        """The rows that failed, each id once, with tries so far and outcome (pending before the first)."""
        newest = Window.partitionBy("id").orderBy(F.desc("sink_batch"))
        failed = self.failures.rows().withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n", "sink_batch")
        last = self.outcomes.rows().groupBy("id").agg(F.max_by(F.struct("tries", "outcome"), "tries").alias("last"))
        out = failed.join(last, "id", "left")
        return out.select(*failed.columns, F.coalesce("last.tries", F.lit(0)).alias("tries"), F.coalesce("last.outcome", F.lit("pending")).alias("outcome"))

    def due(self) -> DataFrame:
        """The rows of the next round: those of the least ids that are neither done nor dead."""
        return self.states().where(F.col("outcome").isin("pending", "retry")).orderBy("id").limit(self.n_rows)

    def round(self, repair: Callable[[DataFrame], DataFrame]) -> int:
        """One round: `repair` gets the due rows and gives (id) of those that succeeded. The round's number; -1 if nothing is due.

        A round's outcome is one committed batch. If it is lost before, the next call tries the same rows again under the same number."""
        number = (self.outcomes.ledger().agg(F.max("sink_batch")).first()[0] or 0) + 1
        due = self.due()
        if due.isEmpty():
            return -1
        good = repair(due.drop("tries", "outcome")).select("id").distinct().withColumn("good", F.lit(True))
        tries = (F.col("tries") + 1).cast("int")
        outcome = F.when(F.col("good"), "done").when(tries >= self.most, "dead").otherwise("retry")
        self.outcomes.write(due.join(good, "id", "left").select("id", tries.alias("tries"), outcome.alias("outcome")), number)
        return number
