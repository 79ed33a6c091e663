import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[2])
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)
if ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[2]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


SF = "/root/testdata/sf0.001"


@pytest.fixture
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, key string, node long"


@pytest.fixture
def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, copies, and extra columns with clashing names."""
    long = " ".join(f"word{i % 997} and" for i in range(6000))
    text = "The quick brown fox jumps over the lazy dog, and then it runs back to the quiet old farm.\nIt sleeps there until the morning comes again."
    rows = [(1, text, "en"), (2, text, "en"), (2, text, "en"), (3, None, "en"), (4, "", None), (5, "   \n\t ", "xx"), (6, long, "en"), (None, "no id at all here", "fr"), (7, None, None), (8, "é" * 50, "de"), (9, text + " More.", None), (10, "a\x00b \x1c c", "es")]
    return spark.createDataFrame([(i, t, lang, None, 0, 1, "k", 5) for i, t, lang in rows], DOCS)


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], DOCS)
