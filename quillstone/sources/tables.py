"""Reading the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``root``; columns and filters chosen later reach the scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")
