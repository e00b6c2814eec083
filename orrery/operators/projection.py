"""New rows placed among fixed reference rows: neighbour means, local affine maps, interpolation and t-SNE transforms.

Every new row depends on nothing but its own neighbours, so all of it scales with the number of new rows.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators import kernels
from orrery.plans.ranged import first_rows

EPS = 1.4901161193847656e-08  # fixed value: square root of the double's machine epsilon
RIDGE, REACH, AFFINE_NEIGHBOURS = 1e-3, 2.5, 12
#: References up to which all repel a new row, and how many stand for more of them.
EXACT_REPULSION, SAMPLED_REPULSION = 4096, 256


def weighted(knn: DataFrame, layout: DataFrame) -> DataFrame:
    """id, features: the mean of the references at distance 0 if there are any, else the mean weighted by
    exp(-(d - rho) / sigma), rho the least distance, sigma the median of the positive d - rho."""
    near = knn.join(layout.select(F.col("id").alias("nbr_id"), F.col("features").alias("y")), "nbr_id")
    w = Window.partitionBy("src_id")
    near = near.withColumn("rho", F.min("distance").over(w)).withColumn("zero", F.max((F.col("distance") <= EPS).cast("int")).over(w))
    gap = F.col("distance") - F.col("rho")
    near = near.withColumn("sigma", F.coalesce(F.median(F.when(gap > 0, gap)).over(w), F.lit(1.0)))
    weight = F.when(F.col("zero") == 1, (F.col("distance") <= EPS).cast("double")).otherwise(F.exp(-gap / F.greatest("sigma", F.lit(1e-12))))
    long = near.select("src_id", weight.alias("w"), F.posexplode("y").alias("pos", "v"))
    mean = long.groupBy("src_id", "pos").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))
    return mean.groupBy(F.col("src_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("features"))


def start_positions(knn: DataFrame, layout: DataFrame, how: str = "median") -> DataFrame:
    """id, features: median of the neighbours' positions, mean weighted by 1 / (d + 1e-6), or near the first neighbour (random)."""
    near = knn.join(layout.select(F.col("id").alias("nbr_id"), F.col("features").alias("y")), "nbr_id").select("src_id", "rank", "distance", F.posexplode("y").alias("pos", "v"))
    if how == "median":
        v = F.median("v")
    elif how == "weighted":
        v = F.sum(F.col("v") / (F.col("distance") + 1e-6)) / F.sum(1 / (F.col("distance") + 1e-6))
    elif how == "random":
        v = F.max(F.when(F.col("rank") == 1, F.col("v"))) + (F.pmod(F.xxhash64("src_id", "pos"), F.lit(2000)) - 1000) * 1e-7
    else:
        raise ValueError("initialization must be median, weighted or random")
    return near.groupBy("src_id", "pos").agg(v.alias("v")).groupBy(F.col("src_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("features"))


def affine_rows(x: np.ndarray, d: np.ndarray, ref_x: np.ndarray, ref_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New rows (n, p): (positions, confidences) from their neighbours' distances (n, k; infinite where there are fewer than
    k), features (n, k, p) and positions (n, k, q), nearest first.

    A reference at distance 0 is copied. Else a weighted ridge fit (1e-3 of the trace, in kernel form); a step of more than
    2.5 neighbourhood radii is shortened. Confidence is the effective share of neighbours. A row's result doesn't depend on
    the others.
    """
    there = np.isfinite(d)
    gap = np.where(there, d - d.min(1, keepdims=True), np.nan)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)  # rows without a positive gap
        sigma = np.nanmedian(np.where(gap > 0, gap, np.nan), axis=1)
    sigma = np.maximum(np.where(np.isfinite(sigma), sigma, 1.0), 1e-12)
    w = np.where(there, np.exp(-np.where(there, gap, 0.0) / sigma[:, None]), 0.0)
    w /= w.sum(1, keepdims=True)
    cx, cy = np.einsum("nk,nkp->np", w, ref_x), np.einsum("nk,nkq->nq", w, ref_y)
    root = np.sqrt(w)[:, :, None]
    a, b = root * (ref_x - cx[:, None]), root * (ref_y - cy[:, None])
    k = a @ a.transpose(0, 2, 1)
    trace = np.trace(k, axis1=1, axis2=2)
    fit = np.linalg.solve(k + (RIDGE * trace + 1e-12)[:, None, None] * np.eye(k.shape[1]), b)
    step = ((x - cx)[:, None] @ a.transpose(0, 2, 1) @ fit)[:, 0]
    step[~(np.isfinite(step).all(1) & (trace > 0))] = 0.0
    radius = np.sqrt((w * ((ref_y - cy[:, None]) ** 2).sum(2)).sum(1))
    size = np.sqrt((step * step).sum(1))
    step *= np.where(size > REACH * radius, REACH * radius / np.maximum(size, 1e-12), 1.0)[:, None]
    copied = (d <= EPS).any(1)
    first = (d <= EPS).argmax(1)
    at = np.where(copied[:, None], ref_y[np.arange(len(d)), first], cy + step)
    return at, np.where(copied, 1.0, 1 / (w * w).sum(1) / there.sum(1))


def padded(column: pa.ListArray, width: int, fill: float = 0.0) -> np.ndarray:
    """Lists of numbers, or of lists of numbers of one length, as one array of ``width`` entries a row, short ones filled up."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten()
    inner = flat.flatten() if pa.types.is_list(flat.type) else flat
    values = np.asarray(inner, float).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))
    out = np.full((len(column), width, values.shape[1]), fill)
    out[np.arange(width)[None] < lengths[:, None]] = values
    return out if pa.types.is_list(flat.type) else out[:, :, 0]


#: Rows that are computed at once.
AT_ONCE = 512


def affine(knn: DataFrame, query: DataFrame, reference: DataFrame, layout: DataFrame) -> DataFrame:
    """id, features, confidence of each query row by :func:`affine_rows` over at most 12 neighbours, which come by equi-joins.
    One numpy computation per part of an Arrow batch."""
    refs = reference.select(F.col("id").alias("nbr_id"), F.col("features").alias("x")).join(layout.select(F.col("id").alias("nbr_id"), F.col("features").alias("y")), "nbr_id")
    near = knn.where(F.col("rank") <= AFFINE_NEIGHBOURS).join(refs, "nbr_id").groupBy("src_id").agg(F.sort_array(F.collect_list(F.struct("rank", "distance", "x", "y"))).alias("near"))
    both = query.select("id", "features").join(near, query.id == near.src_id).select("id", "features", F.col("near.distance").alias("d"), F.col("near.x").alias("x"), F.col("near.y").alias("y"))

    def run(batches):
        for whole in batches:
            for s in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(s, AT_ONCE)
                x = np.asarray(b["features"].flatten(), float).reshape(b.num_rows, -1)
                at, conf = affine_rows(x, padded(b["d"], AFFINE_NEIGHBOURS, np.inf), padded(b["x"], AFFINE_NEIGHBOURS), padded(b["y"], AFFINE_NEIGHBOURS))
                yield pa.RecordBatch.from_arrays([b["id"], pa.array(at.tolist(), pa.list_(pa.float64())), pa.array(conf, pa.float64())], ["id", "features", "confidence"])

    return both.mapInArrow(run, "id bigint, features array<double>, confidence double")


def low_confidence(placed: DataFrame, fraction: float) -> DataFrame:
    """The ceil(fraction * n) rows of least confidence, ties by id."""
    return first_rows(placed, ["confidence", "id"], math.ceil(fraction * placed.count()))


def interpolated(knn: DataFrame, layout: DataFrame) -> DataFrame:
    """id, features: the first reference at distance 0 copied, else the mean weighted by 1 / (d + 1e-6)."""
    near = knn.join(layout.select(F.col("id").alias("nbr_id"), F.col("features").alias("y")), "nbr_id")
    first = near.where(F.col("distance") <= EPS).groupBy("src_id").agg(F.min_by("y", "rank").alias("copy"))
    mean = start_positions(knn, layout, "weighted")
    return mean.join(first, mean.id == first.src_id, "left").select("id", F.coalesce("copy", "features").alias("features"))


def transform_tsne(layout: DataFrame, knn: DataFrame, perplexity: float = 5.0, initialization: str = "median", start: DataFrame | None = None, n_iter: int = 250, early_iter: int = 0, learning_rate: float = 0.1, exaggeration: float = 1.5, early_exaggeration: float = 4.0, max_grad_norm: float = 0.25, n_negatives: int | None = None, exact_threshold: int = EXACT_REPULSION, seed: int = 4) -> DataFrame:
    """id, features: new rows moved by t-SNE's gradient among fixed reference rows, which stay where they are.

    Neighbours' positions come by an equi-join. The repulsion takes all references up to ``exact_threshold`` of them, above it
    a seeded sample that stands for all; those few are broadcast. Each part of a batch of new rows is one numpy computation.
    """
    spark = layout.sparkSession
    refs = layout.select("id", "features")
    n = refs.count()
    few = n_negatives or (SAMPLED_REPULSION if n > exact_threshold else n)
    # a bounded number of rows: at most exact_threshold, or the sample
    held = refs.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(few).orderBy("id").toArrow() if few < n else refs.orderBy("id").toArrow()
    shared = spark.sparkContext.broadcast((np.asarray(held["features"].combine_chunks().flatten(), float).reshape(held.num_rows, -1), n))
    lists = knn.join(refs.select(F.col("id").alias("nbr_id"), F.col("features").alias("y")), "nbr_id").groupBy("src_id").agg(F.sort_array(F.collect_list(F.struct("rank", "distance", "y"))).alias("near"))
    begun = start if start is not None else start_positions(knn, layout, initialization)
    both = begun.join(lists, begun.id == lists.src_id).select("id", "features", F.col("near.distance").alias("dist"), F.col("near.y").alias("near"))

    def run(batches):
        rest, n = shared.value
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                p = kernels.perplexity_rows(np.array(part["dist"].to_pylist(), float), perplexity)
                near = np.array(part["near"].to_pylist(), float)
                y = kernels.tsne_transform(np.array(part["features"].to_pylist(), float), p, near, rest, n / len(rest), n_iter, early_iter, early_exaggeration, exaggeration, learning_rate, max_grad_norm=max_grad_norm)
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(y.tolist(), pa.list_(pa.float64()))], ["id", "features"])

    return both.mapInArrow(run, "id bigint, features array<double>")
