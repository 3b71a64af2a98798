"""Metric counts over a stream of result files: pairs arrive, totals stand at any time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import scored

SCHEMA = "metric string, neuron_id bigint, TP bigint, FP bigint, FN bigint"


def results(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)


def totals(rows: DataFrame) -> DataFrame:
    """Micro scores of each metric; for a stream, in complete mode."""
    total = rows.groupBy("metric").agg(F.count("*").alias("n_pairs"), *(F.sum(c).alias(c) for c in ("TP", "FP", "FN")))
    return scored(total, "TP", "FP", "FN").withColumnRenamed("f1", "f1_score")
