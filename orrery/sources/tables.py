"""Tables of a data folder, one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``; columns are pruned and filters pushed down by the reader."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
