"""One row of all quality figures of a layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import metrics
from orrery.operators.knn import exact_knn
from orrery.plans.cut import cut
from orrery.sources.layouts import cached_at


def kmeans_labels(layout: DataFrame, k: int, seed: int = 4, starts: int = 5) -> DataFrame:
    """id, community by the best of ``starts`` seeded k-means runs of the layout."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = cut(layout.select("id", "features"), "kmeans-rows").select("id", array_to_vector("features").alias("v"))
    models = [KMeans(featuresCol="v", predictionCol="community", k=k, seed=seed + s).fit(data) for s in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return cut(best.transform(data).select("id", F.col("community").cast("bigint").alias("community")), "kmeans")


#: Columns of the row and their types; one knn_preservation_<k> for each further k follows.
COLUMNS = {
    "dataset": "string", "method": "string", "seed": "bigint", "primary_k": "bigint", "n_rows": "bigint", "local_sample_size": "bigint",
    "trustworthiness": "double", "continuity": "double", "knn_preservation": "double", "knn_preservation_15": "double", "knn_preservation_30": "double", "knn_preservation_50": "double", "mean_neighbor_rank_error": "double",
    "distance_spearman": "double", "distance_pearson": "double", "stress": "double", "global_sample_size": "bigint", "global_pair_count": "bigint",
    "density_spearman": "double", "density_pearson": "double", "density_log_radius_rmse": "double", "density_radius_high_mean": "double", "density_radius_embedding_mean": "double", "density_sample_size": "bigint",
    "evaluation_reference_supplied_used": "boolean", "evaluation_reference_cache_hit": "boolean", "evaluation_reference_cache_path": "string",
    "centroid_distance_correlation": "double", "silhouette": "double", "label_knn_accuracy": "double", "nn_accuracy": "double", "ari": "double", "nmi": "double", "rare_class_recall": "double", "per_class_recall_json": "string",
    "batch_entropy": "double", "batch_mixing_score": "double", "label_batch_tradeoff": "double",
}


def evaluate_embedding(high: DataFrame, layout: DataFrame, labels: DataFrame | None = None, batch: DataFrame | None = None, ks: tuple[int, ...] = (15, 30, 50), primary_k: int | None = None, local_rows: int = 2000, global_rows: int = 5000, seed: int = 4, method: str | None = None, dataset: str | None = None, reference_knn: DataFrame | None = None, cache_dir: str | None = None) -> DataFrame:
    """One row (COLUMNS): rank metrics on a seeded sample, at ``primary_k`` and preservation at every k, global distances on
    sampled pairs, density, and, given labels (id, label) or batches (id, batch), their metrics. What can't be computed is null.

    The sample's neighbours among the features are ``reference_knn`` if given (over the sampled ids), else they are read from
    ``cache_dir`` if they were written there before for the same sample, k and content, else searched and written.
    """
    n = layout.count()
    ks = tuple(k for k in ks if k < n) or (max(1, n - 2),)
    k = primary_k or ks[0]
    ks = tuple(sorted({*ks, k}))
    sample = cut(metrics.local_sample(high.join(layout.select("id"), "id", "left_semi").select("id", "features"), min(local_rows, metrics.RANK_ROWS), max(ks), seed), "sample-high")
    low = cut(layout.join(sample.select("id"), "id", "left_semi").select("id", "features"), "sample-low")
    ranks = {r.k: r for r in metrics.rank_metrics(sample, low, ks).collect()}
    values: dict[str, object] = {"dataset": dataset, "method": method, "seed": seed, "primary_k": k, "n_rows": n, "local_sample_size": sample.count()}
    values |= {c: ranks[k][c] for c in ("trustworthiness", "continuity", "knn_preservation", "mean_neighbor_rank_error")}
    values |= {f"knn_preservation_{j}": r.knn_preservation for j, r in ranks.items()}

    hit, path = False, None
    if reference_knn is not None:
        high_knn = cut(reference_knn.where(F.col("rank") <= k), "high-knn")
    elif cache_dir is None:
        high_knn = cut(exact_knn(sample, k), "high-knn")
    else:
        high_knn, path, hit = cached_at(sample, cache_dir, ("eval_nn", dataset or "dataset", k, "euclidean"), lambda: exact_knn(sample, k))
    values |= {"evaluation_reference_supplied_used": reference_knn is not None, "evaluation_reference_cache_hit": hit, "evaluation_reference_cache_path": path}
    low_knn = cut(exact_knn(low, k), "low-knn")
    values |= metrics.density_metrics(high_knn, low_knn, k).first().asDict()
    wide = cut(metrics.local_sample(high.join(layout.select("id"), "id", "left_semi").select("id", "features"), global_rows, max(ks), seed), "global")
    pairs = cut(metrics.pair_distances(metrics.sampled_pairs(wide, seed=seed), high, layout), "pairs")
    d = metrics.distance_metrics(pairs).first()
    values |= {"distance_spearman": d.spearman, "distance_pearson": d.pearson, "stress": d.normalized_stress, "global_sample_size": wide.count(), "global_pair_count": pairs.count()}
    if labels is not None:
        known = cut(labels.where("label IS NOT NULL").select("id", "label").join(low.select("id"), "id", "left_semi"), "known-labels")
        classes = known.select("label").distinct().count()
        values["centroid_distance_correlation"] = metrics.centroid_corr(sample, low, known).first()[0]
        if classes >= 2:
            per = cut(metrics.label_accuracy(cut(metrics.label_votes(low_knn, known, k), "votes")), "classes")
            values["label_knn_accuracy"] = values["nn_accuracy"] = per.agg(F.round(F.sum("correct") / F.sum("n"), 6)).first()[0]
            values["rare_class_recall"] = metrics.rare_recall(per).first().rare_recall
            values["per_class_recall_json"] = per.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("label").cast("string"), "recall")))))).first()[0]
            values["silhouette"] = metrics.silhouette(low, known).first()[0]
            values |= metrics.ari_nmi(known.select("id", F.col("label").alias("community")), kmeans_labels(low, classes, seed)).first().asDict()
    if batch is not None:
        mixed = metrics.batch_mixing(low_knn, batch, k).first()
        values |= {"batch_entropy": mixed.batch_entropy, "batch_mixing_score": mixed.batch_mixing}
        if values.get("label_knn_accuracy") is not None and mixed.batch_mixing is not None:
            values["label_batch_tradeoff"] = round(0.5 * values["label_knn_accuracy"] + 0.5 * mixed.batch_mixing, 6)
    kinds = COLUMNS | {c: "double" for c in values if c not in COLUMNS}
    return layout.sparkSession.createDataFrame([tuple(values.get(c) for c in kinds)], ", ".join(f"`{c}` {t}" for c, t in kinds.items()))
