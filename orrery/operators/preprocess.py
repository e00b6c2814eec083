"""Feature tables (id, features array<double>): coercion, checks, standardizing and row scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import vectors as V


def features(df: DataFrame, id_col: str, vector: str | Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """id, features array<double> (and ``keep``) from a vector column or several numeric columns."""
    v = V.as_double(F.col(vector)) if isinstance(vector, str) else F.array(*[F.col(c).cast("double") for c in vector])
    return df.select(F.col(id_col).cast("bigint").alias("id"), v.alias("features"), *keep)


def finite_report(df: DataFrame) -> DataFrame:
    """One row: rows, dims, and whether all rows are finite and of one length. An empty table is finite with 0 dims."""
    n = F.size("features")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.max(n), F.lit(0)).cast("bigint").alias("n_dims"), F.coalesce(F.bool_and(V.all_finite(F.col("features"))), F.lit(True)).alias("all_finite"), F.coalesce(F.max(n) == F.min(n), F.lit(True)).alias("one_length"))


def validated(df: DataFrame, least_rows: int = 2) -> DataFrame:
    """``df`` if it has rows enough, one vector length and only finite values; else ValueError."""
    r = finite_report(df).first()
    if r.n_rows < least_rows or r.n_dims < 1:
        raise ValueError(f"need at least {least_rows} rows and 1 column")
    if not r.all_finite or not r.one_length:
        raise ValueError("features must be finite and of one length")
    return df


def column_moments(df: DataFrame) -> DataFrame:
    """pos (from 0), mean, sd of each feature; sd with n - 1, and 1 where it is 0 or undefined."""
    long = df.select(F.posexplode("features").alias("pos", "x"))
    sd = F.stddev_samp("x")
    return long.groupBy("pos").agg(F.avg("x").alias("mean"), F.when(F.coalesce(sd, F.lit(0.0)) > 0, sd).otherwise(1.0).alias("sd"))


def standardized(df: DataFrame) -> DataFrame:
    """``df`` with features (x - mean) / sd. The moments are one row, cross-joined as a broadcast of fixed width."""
    lists = column_moments(df).agg(F.sort_array(F.collect_list(F.struct("pos", "mean", "sd"))).alias("_m"))
    z = F.zip_with("features", "_m", lambda x, m: (x - m["mean"]) / m["sd"])
    return df.crossJoin(F.broadcast(lists)).withColumn("features", z).drop("_m")


def rows_for(df: DataFrame, metric: str) -> DataFrame:
    """Rows whose squared Euclidean distance serves the metric: unit length for cosine, centred too for correlation."""
    v = F.col("features")
    if metric == "cosine":
        return df.withColumn("features", V.normalized(v))
    if metric == "correlation":
        return df.withColumn("_c", V.centred(v)).withColumn("features", V.normalized(F.col("_c"))).drop("_c")
    if metric in ("euclidean", "inner_product"):
        return df
    raise ValueError(f"unknown metric {metric!r}")


def auto_k(n: int) -> int:
    """Neighbours when none are asked for: 15 below 500 rows, 30 below 10000, else 50; at most n - 1."""
    return max(1, min(15 if n < 500 else 30 if n < 10_000 else 50, n - 1))


def prepared(df: DataFrame, standardize: bool = False, pca_dims: int | None = None, seed: int = 4) -> DataFrame:
    """Checked features, standardized if asked for, then reduced if 1 <= min(pca_dims, n - 1, p) < p."""
    r = finite_report(validated(df)).first()
    out = standardized(df) if standardize else df
    if pca_dims is not None:
        dims = min(pca_dims, r.n_rows - 1, r.n_dims)
        if 1 <= dims < r.n_dims:
            from orrery.operators.pca import fit_pca

            return fit_pca(out, dims, seed=seed).transform(out)
    return out
