"""A classifier of intents: stratified split, fitting, saving and loading, and the routing that falls back to prototypes."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def featured(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """vectors with a number column label and a feature column, as the model takes them."""
    return vectors.withColumn(label, F.col(label).cast("double")).withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def stratified(rows: DataFrame, key: str, label: str, held: float = 0.2) -> DataFrame:
    """rows with held: whether a row is in the held-out share of its label, in the order of a hash of its key."""
    place = F.percent_rank().over(Window.partitionBy(label).orderBy(F.xxhash64(key), key))
    return rows.withColumn("held", place < held)


def fit(train: DataFrame, label: str = "label") -> LogisticRegressionModel:
    return LogisticRegression(maxIter=50, labelCol=label, predictionCol="p").fit(train)


def save(model: LogisticRegressionModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> LogisticRegressionModel:
    return LogisticRegressionModel.load(path)


def predicted(model: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    """rows with predicted, the model's label."""
    return model.transform(rows).withColumn("predicted", F.col("p").cast("int")).drop("p", "rawPrediction", "probability", "features")


def route(model: LogisticRegressionModel | None, rows: DataFrame, names: Column, prototype: Column) -> DataFrame:
    """rows with intent: by the model where there is one, else what prototype says."""
    if model is None:
        return rows.withColumn("intent", prototype)
    return predicted(model, rows).withColumn("intent", F.coalesce(F.get(names, F.col("predicted")), F.lit("mixed")))
