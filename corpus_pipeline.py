"""The corpus pipeline: quality rules, line deduplication, near-duplicate documents, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame; all but the last return the
columns of documents. An empty table gives an empty one, further columns go along, and columns whose names begin with `__` are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import divergence, fuzzy_lines, order_minhash, slack_packing, soft_mixing
from tidewell.llm.common import new_path
from tidewell.llm.queries import table, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Verdicts follow the rows by id and a hash of the text, so rows of one id may differ."""
    return divergence.kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are near-equal to an earlier one: texts may become empty, null ones stay null; of repeated rows the first keeps its lines."""
    return fuzzy_lines.drop_lines_only(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that of its least id (of repeated rows of it, one): null and empty texts are one class, a class without ids keeps one of its rows."""
    return order_minhash.one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their copies say, 0 to 4 times; null and empty texts count as one token, repeated rows have equal copies, and without labels all stay once."""
    return soft_mixing.mixed_documents(docs, table(spark, sf_dir, "labels"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document; null and empty texts are one end id, repeated rows and copies are packed each time."""
    return slack_packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
#: SQL expresses neither the union-find nor the trained mixing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = new_path(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
