"""Classifiers over vectors with Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """Adds a weight by which all classes weigh alike."""
    counts = rows.groupBy(label).agg(F.count("*").alias("__n"))
    totals = counts.agg(F.sum("__n").alias("__all"), F.count("*").alias("__classes"))
    weights = counts.crossJoin(F.broadcast(totals)).select(label, (F.col("__all") / (F.col("__classes") * F.col("__n"))).alias("weight"))  # a row a class
    return rows.join(weights, label)


def fitted_and_held_out(rows: DataFrame, key: str, vector: str, label: str, iterations: int = 50) -> DataFrame:
    """key, label, prediction and confidence of the held-out fifth (by a hash of the key)."""
    held = F.pmod(F.xxhash64(key, F.lit(42)), F.lit(5)) == 0
    data = rows.select(key, F.col(label).cast("double").alias("y"), array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("x"), held.alias("held"))
    learn = balanced(data.where(~F.col("held")), "y")
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", maxIter=iterations, predictionCol="prediction", probabilityCol="probability").fit(learn)
    out = model.transform(data.where("held"))
    return out.select(key, F.col("y").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"), F.round(F.array_max(vector_to_array("probability")), 4).alias("confidence"))


#: Keywords whose presence overrides a classifier, and the least confidence it needs.
def routed(rule: F.Column, inherited: F.Column, predicted: F.Column, confidence: F.Column, least: float = 0.6) -> F.Column:
    """Intent of a query: a rule first, then what a short query inherits, then a sure classifier, else unknown."""
    return F.coalesce(rule, inherited, F.when(confidence >= least, predicted), F.lit("unknown"))
