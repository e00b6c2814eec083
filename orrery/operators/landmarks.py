"""Landmark models: a layout is fitted on chosen rows, all others are projected onto it. Linear in the rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import projection
from orrery.operators.knn import precompute_query_knn
from orrery.operators.layouts import Embedding, opentsne, refine_rows, umap
from orrery.operators.preprocess import column_moments, prepared, standardized
from orrery.plans.cut import cut
from orrery.plans.ranged import first_rows, summed_before

#: Candidates and landmarks up to which farthest-first choice runs on the driver.
FARTHEST_CANDIDATES, FARTHEST_COUNT = 12_000, 2000


def auto_count(n: int) -> int:
    """Landmarks when none are asked for."""
    if n <= 3:
        return n
    if n <= 80:
        return math.ceil(n / 2)
    return min(n, max(80 if n <= 1000 else 300, math.ceil(7 * math.sqrt(n))))


def landmark_count(n: int, landmarks) -> int:
    if landmarks is True:
        return auto_count(n)
    if isinstance(landmarks, float) and 0 < landmarks < 1:
        return max(1, math.ceil(landmarks * n))
    if isinstance(landmarks, (int, float)) and landmarks >= 1:
        return min(n, int(landmarks))
    raise ValueError("landmarks must be True, a share, a count or a table of ids")


def selection_features(df: DataFrame, seed: int = 4) -> DataFrame:
    """The first (at most 4) columns and as many seeded unit projections, standardized."""
    p = df.select(F.size("features").alias("p")).first().p
    m = min(4, p)
    w = np.random.default_rng(seed).standard_normal((p, m))
    w /= np.linalg.norm(w, axis=0)
    proj = [F.aggregate(F.zip_with("features", F.array(*[F.lit(float(x)) for x in w[:, j]]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for j in range(m)]
    return standardized(df.select("id", F.concat(F.slice("features", 1, m), F.array(*proj)).alias("features")))


def spaced_rows(feats: DataFrame, per_axis: int) -> DataFrame:
    """axis, slot, id: along each axis of the features the rows at the first of ``per_axis`` evenly spaced parts of the order by
    (value, id). Places come from ranges and their counts: no task sorts a whole axis."""
    n = feats.count()
    long = feats.select("id", F.posexplode("features").alias("axis", "x")).withColumn("_one", F.lit(1).cast("bigint"))
    rank = summed_before(long, ["axis"], ["x", "id"], "_one", "_r")
    slot = F.floor(F.col("_r") * per_axis / n).cast("bigint")
    first = (slot != F.floor((F.col("_r") - 1) * per_axis / n)) | (F.col("_r") == 0)
    return rank.where(first).select("axis", slot.alias("slot"), "id")


def select_landmarks(df: DataFrame, landmarks=True, seed: int = 4) -> DataFrame:
    """id, is_landmark of every row: a disjoint cover. ``landmarks``: True (auto), a share, a count, or a table with ids.

    Candidates are the row nearest to the centre and evenly spaced ranks along each selection feature; of a bounded number
    the farthest-first are kept, else those of least hash; missing ones are filled up by hash.
    """
    if isinstance(landmarks, DataFrame):
        return df.select("id").join(landmarks.select("id").distinct().withColumn("is_landmark", F.lit(True)), "id", "left").select("id", F.coalesce("is_landmark", F.lit(False)).alias("is_landmark"))
    n = df.count()
    count = landmark_count(n, landmarks)
    if count >= n:
        return df.select("id", F.lit(True).alias("is_landmark"))
    feats = cut(selection_features(df, seed), "landmark-features")
    axes = feats.select(F.size("features").alias("p")).first().p
    per_axis = max(2, math.ceil(2 * count / axes))
    centre = feats.withColumn("_d", F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x)).orderBy("_d", "id").limit(1).select("id")
    spaced = spaced_rows(feats, per_axis).select("id")
    candidates = cut(centre.unionByName(spaced).distinct(), "landmark-candidates")
    m = candidates.count()
    if m > count and m <= FARTHEST_CANDIDATES and count <= FARTHEST_COUNT:
        rows = feats.join(candidates, "id").orderBy("id").collect()
        ids, x = np.array([r.id for r in rows]), np.array([r.features for r in rows])
        chosen = farthest_first(x, count)
        picked = df.sparkSession.createDataFrame([(int(i),) for i in ids[chosen]], "id bigint")
    else:
        picked = first_rows(candidates, [F.xxhash64("id", F.lit(seed)), "id"], count)
    picked = cut(picked, "landmark-picked")
    missing = count - picked.count()
    if missing > 0:
        picked = picked.unionByName(first_rows(df.select("id").join(picked, "id", "left_anti"), [F.xxhash64("id", F.lit(seed)), "id"], missing))
    return select_landmarks(df, picked)


def farthest_first(x: np.ndarray, count: int) -> np.ndarray:
    """Row numbers: first the one of least norm, then ever the one farthest from those chosen."""
    chosen = [int((x * x).sum(1).argmin())]
    d = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(count, len(x)):
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)


@dataclass(frozen=True)
class LandmarkModel:
    """A fit on the landmark rows, with what is needed to place others."""

    fit: Embedding
    reference: DataFrame
    method: str
    n_landmarks: int
    metric: str = "euclidean"

    def __repr__(self) -> str:
        return f"LandmarkModel({self.method}, landmarks={self.n_landmarks})"


def fit_landmark_model(df: DataFrame, selection: DataFrame, method: str = "umap", metric: str = "euclidean", seed: int = 4, **options) -> LandmarkModel:
    """An ordinary fit on the rows that ``selection`` marks."""
    reference = cut(df.join(selection.where("is_landmark").select("id"), "id", "left_semi").select("id", "features"), "landmarks")
    if method not in ("umap", "opentsne"):
        raise ValueError("method must be umap or opentsne")
    fit = umap(reference, metric=metric, seed=seed, **options) if method == "umap" else opentsne(reference, metric=metric, seed=seed, **options)
    return LandmarkModel(fit, reference, method, reference.count(), metric)


def project_rows(model: LandmarkModel, query: DataFrame, transform_k: int | None = None, refinement_epochs: int = 50, transform_perplexity: float = 5.0, transform_iter: int = 250, initialization: str = "median", seed: int = 4) -> DataFrame:
    """id, features of new rows: query neighbours, then a local affine map and a UMAP refinement, or a t-SNE transform."""
    k = min(model.n_landmarks, transform_k or (15 if model.method == "umap" else max(25, math.ceil(3 * transform_perplexity))))
    knn = cut(precompute_query_knn(model.reference, query, k, model.metric, seed=seed), "query-knn")
    if model.method == "umap":
        placed = cut(projection.affine(knn, query, model.reference, model.fit.layout), "placed")
        if refinement_epochs <= 0:
            return placed.select("id", "features")
        params = {x: model.fit.parameters[x] for x in ("a", "b", "learning_rate", "negative_samples")}
        return refine_rows(placed, knn, model.fit.layout, seed, refinement_epochs, params)
    return projection.transform_tsne(model.fit.layout, knn, transform_perplexity, initialization, n_iter=transform_iter, seed=seed)


def project_landmark_model(model: LandmarkModel, df: DataFrame, selection: DataFrame | None = None, **options) -> DataFrame:
    """id, features, is_landmark of every row of ``df``: landmarks keep their fitted place, the others are projected."""
    fixed = model.fit.layout.select("id", "features").withColumn("is_landmark", F.lit(True))
    rest = df.join(fixed.select("id"), "id", "left_anti") if selection is None else df.join(selection.where("NOT is_landmark").select("id"), "id", "left_semi")
    return fixed.join(df.select("id"), "id", "left_semi").unionByName(project_rows(model, rest, **options).withColumn("is_landmark", F.lit(False)))


def _landmark_layout(df, method, landmarks, standardize, pca_dims, seed, fit, project):
    data = cut(prepared(df, standardize, pca_dims, seed), "landmark-data")
    selection = cut(select_landmarks(data, landmarks, seed), "selection")
    model = fit_landmark_model(data, selection, method, seed=seed, **fit)
    return model, cut(project_landmark_model(model, data, selection, seed=seed, **project), "landmark-layout")


def landmark_umap(df: DataFrame, landmarks=0.5, n_neighbors: int | None = None, standardize: bool = True, pca_dims: int | None = None, seed: int = 4, transform_k: int | None = None, **options) -> tuple[LandmarkModel, DataFrame]:
    """(model, layout of all rows). Standardizes by default, unlike the plain fit."""
    return _landmark_layout(df, "umap", landmarks, standardize, pca_dims, seed, {"n_neighbors": n_neighbors} | options, {"transform_k": transform_k})


def landmark_tsne(df: DataFrame, landmarks=True, perplexity: float | None = None, standardize: bool = True, pca_dims: int | None = None, seed: int = 4, transform_k: int | None = None, transform_perplexity: float = 5.0, transform_iter: int = 250, initialization: str = "median", **options) -> tuple[LandmarkModel, DataFrame]:
    """(model, layout of all rows) by t-SNE."""
    return _landmark_layout(df, "opentsne", landmarks, standardize, pca_dims, seed, {"perplexity": perplexity} | options, {"transform_k": transform_k, "transform_perplexity": transform_perplexity, "transform_iter": transform_iter, "initialization": initialization})


__all__ = ["LandmarkModel", "column_moments", "fit_landmark_model", "landmark_tsne", "landmark_umap", "project_landmark_model", "select_landmarks"]
