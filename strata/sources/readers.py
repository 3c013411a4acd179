"""Readers of plain files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """CSV with a header line; types are inferred unless a schema is given."""
    reader = spark.read.options(**{"header": True, **options})
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def generate_series(spark: SparkSession, first: int, last: int, step: int = 1) -> DataFrame:
    """first, first + step, ... up to and with last, as column generate_series."""
    return spark.range(first, last + (1 if step > 0 else -1), step).withColumnRenamed("id", "generate_series")
