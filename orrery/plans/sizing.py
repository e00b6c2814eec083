"""Numbers from which partition counts are chosen."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession


def cores(spark: SparkSession) -> int:
    """Task slots of the session."""
    return max(1, spark.sparkContext.defaultParallelism)


def heavy_partitions(spark: SparkSession, units: float = 0.0, waves: int = 8) -> int:
    """Partitions of a shuffle whose few rows each stand for much computation (blocks, shards).

    Given explicitly to ``repartition`` so that adaptive execution doesn't merge them for being small in bytes.
    """
    return int(max(2 * cores(spark), min(waves * cores(spark), math.ceil(units or waves * cores(spark))), math.ceil(units / 64)))
