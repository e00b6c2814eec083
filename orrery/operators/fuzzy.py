"""Neighbour graphs for UMAP: local scales, membership strengths, unions, schedules and the distance profile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import kernels

# --- fixed values of the method ----------------------------------------------------------------------------------
LEAST_SHARE = 1e-3
TINY = 1e-12
LEAST_WEIGHT = 1e-6
# ----------------------------------------------------------------------------------------------------------------


def smooth_knn(knn: DataFrame) -> DataFrame:
    """src_id, rho, sigma of each row of a neighbour table.

    rho is the least positive distance (else 0). sigma solves sum(d <= rho ? 1 : exp(-(d - rho) / sigma)) = log2(k); it is at
    least 1e-3 of the row's mean distance (of the overall mean if rho is 0) and at least 1e-12. One short list per row goes
    to numpy in Arrow batches, where all rows of a batch are searched in step.
    """

    def run(batches):
        for b in batches:
            d, mask = kernels.padded(b["d"].to_pylist())
            rho, sigma = kernels.smooth_rows(d, mask)
            yield pa.RecordBatch.from_arrays([b["src_id"], pa.array(rho), pa.array(sigma), pa.array(d.sum(1) / np.maximum(mask.sum(1), 1))], ["src_id", "rho", "sigma", "mean"])

    lists = knn.groupBy("src_id").agg(F.sort_array(F.collect_list("distance")).alias("d"))
    solved = lists.mapInArrow(run, "src_id bigint, rho double, sigma double, mean double")
    overall = knn.agg(F.avg("distance").alias("_all"))
    floor = LEAST_SHARE * F.when(F.col("rho") > 0, F.col("mean")).otherwise(F.col("_all"))
    return solved.crossJoin(F.broadcast(overall)).select("src_id", "rho", F.greatest("sigma", floor, F.lit(TINY)).alias("sigma"))


def memberships(knn: DataFrame, smooth: DataFrame | None = None) -> DataFrame:
    """src, dst, weight: strength 1 within rho, else exp(-(d - rho) / sigma); self and non-positive ones dropped; the greatest of repeats."""
    s = smooth if smooth is not None else smooth_knn(knn)
    w = F.when(F.col("distance") <= F.col("rho"), 1.0).otherwise(F.exp(-(F.col("distance") - F.col("rho")) / F.col("sigma")))
    kept = knn.join(s, "src_id").select(F.col("src_id").alias("src"), F.col("nbr_id").alias("dst"), w.alias("weight")).where("src <> dst AND weight > 0 AND NOT isnan(weight) AND weight < double('infinity')")
    return collapsed(kept)


def collapsed(edges: DataFrame) -> DataFrame:
    """One row per (src, dst), with the greatest weight."""
    return edges.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def fuzzy_union(edges: DataFrame) -> DataFrame:
    """Symmetric weights w + w' - w * w' of directed strengths, both directions, above 1e-6."""
    a = edges.select("src", "dst", F.col("weight").alias("w"))
    b = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("t"))
    w, t = F.coalesce("w", F.lit(0.0)), F.coalesce("t", F.lit(0.0))
    return a.join(b, ["src", "dst"], "full_outer").select("src", "dst", (w + t - w * t).alias("weight")).where(F.col("weight") > LEAST_WEIGHT)


def binary_union(knn: DataFrame) -> DataFrame:
    """Unit weights on every pair of neighbours, both directions."""
    e = knn.where("src_id <> nbr_id").select(F.col("src_id").alias("src"), F.col("nbr_id").alias("dst"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumn("weight", F.lit(1.0))


def with_schedule(edges: DataFrame) -> DataFrame:
    """Edges with epochs_per_sample: greatest weight over own weight."""
    top = edges.agg(F.max("weight").alias("_top"))
    return edges.crossJoin(F.broadcast(top)).select("src", "dst", "weight", (F.col("_top") / F.greatest("weight", F.lit(1e-6))).alias("epochs_per_sample"))


def prepare_umap_knn(knn: DataFrame, graph_mode: str = "fuzzy") -> DataFrame:
    """src, dst, weight, epochs_per_sample: the graph to be reused over seeds (cut it before using it twice)."""
    if graph_mode == "binary":
        return binary_union(knn).withColumn("epochs_per_sample", F.lit(1.0))
    if graph_mode != "fuzzy":
        raise ValueError("graph_mode must be fuzzy or binary")
    return with_schedule(fuzzy_union(memberships(knn)))


def distance_profile(knn: DataFrame) -> DataFrame:
    """One row: rows, the coefficient of variation of all distances, and medians of the 15th, 30th and 50th neighbour."""
    at = lambda r: F.median(F.when(F.col("rank") == r, F.col("distance")))
    cv = F.stddev_pop("distance") / F.avg("distance")
    return knn.agg(F.countDistinct("src_id").alias("n_rows"), F.round(cv, 6).alias("cv"), *[F.round(at(r), 6).alias(f"median_{r}") for r in (15, 30, 50)])


def umap_parameters(n: int, cv: float, ratio_50_15: float | None = None) -> dict:
    """Layout parameters by size and distance profile."""
    if n < 10_000:
        return {"n_epochs": 500, "min_dist": 0.01, "spread": 1.0, "negative_samples": 5, "learning_rate": 1.0, "init_sd": None, "spectral_iterations": 30}
    out = {"n_epochs": 200, "min_dist": 0.1, "spread": 1.0, "negative_samples": 5, "learning_rate": 1.0, "init_sd": None, "spectral_iterations": 20}
    if ratio_50_15 is not None and ratio_50_15 >= 1.25 and cv >= 1.0:
        return out | {"min_dist": 0.1, "init_sd": 5.0, "learning_rate": 1.25}
    return out | {"n_epochs": 300} if cv >= 0.6 else out


def spectral_iterations(n: int, components: int, largest_share: float) -> int:
    """Rounds of the power iteration: more for a more fragmented graph of at least 10000 rows."""
    if n < 10_000:
        return 30
    return 20 if components == 1 else 25 if largest_share >= 0.9 else 30


def find_ab(spread: float = 1.0, min_dist: float = 0.01) -> tuple[float, float]:
    """a, b of 1 / (1 + a d^(2b)), fitted to exp(-(d - min_dist) / spread) by damped least squares."""
    x = np.linspace(0, 3 * spread, 300)
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    a, b, damping = 1.5, 0.9, 1e-3

    def residual(a, b):
        return 1 / (1 + a * np.power(x, 2 * b, where=x > 0, out=np.zeros_like(x))) - y

    r = residual(a, b)
    for _ in range(200):
        xp = np.power(x, 2 * b, where=x > 0, out=np.zeros_like(x))
        q = (1 + a * xp) ** 2
        j = np.stack([-xp / q, -2 * a * xp * np.log(np.where(x > 0, x, 1.0)) / q], 1)
        h = j.T @ j
        step = np.linalg.solve(h + damping * np.diag(np.diag(h)), -j.T @ r)
        new = residual(a + step[0], b + step[1])
        if new @ new < r @ r:
            a, b, r, damping = a + step[0], b + step[1], new, damping / 3
            if np.abs(step).max() < 1e-10:
                break
        else:
            damping *= 4
    return float(a), float(b)
