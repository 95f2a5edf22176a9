"""Scans of the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table; columns and filters reach the scan through Catalyst."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
