"""Sources and sinks: tables through Spark's readers, and model artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.sources.artifacts import load_model, save_model

__all__ = ["load_model", "read_table", "save_model"]


def read_table(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """Any table that Spark reads; filters and columns reach the scan as usual."""
    return spark.read.format(format).options(**options).load(path)
