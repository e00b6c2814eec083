"""Saved layouts and caches of costly results, as Parquet under a caller's folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_layout(layout: DataFrame, path: str) -> None:
    layout.select("id", "features").write.mode("overwrite").parquet(path)


def load_layout(spark: SparkSession, path: str) -> DataFrame:
    """id, features of a saved layout, to start another fit from."""
    return spark.read.parquet(path).select("id", F.col("features").cast("array<double>").alias("features"))


def content_key(df: DataFrame, *parts: object) -> str:
    """A name for a table's content and the parameters: rows and the sum of row hashes, whatever their order."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    tail = "-".join(str(p) for p in parts)
    return f"{r.n}-{r.h or 0}-{tail}".replace("/", "_")


def cached_at(df: DataFrame, folder: str, parts: tuple, make: Callable[[], DataFrame], force: bool = False) -> tuple[DataFrame, str, bool]:
    """(table, path, whether it was there): the table ``make()`` of ``df`` and ``parts``, read from ``folder`` if it was written
    before (unless forced)."""
    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/{content_key(df, *parts)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = not force and done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)
    if not there:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), path, there


def cached(df: DataFrame, folder: str, parts: tuple, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table of :func:`cached_at`."""
    return cached_at(df, folder, parts, make, force)[0]
