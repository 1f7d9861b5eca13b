"""Readers of stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``root``, read lazily."""
    return spark.read.parquet(f"{root}/{name}.parquet")
