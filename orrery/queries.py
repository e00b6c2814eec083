"""Named queries of the core operators: name -> (spark, folder of tables) -> DataFrame, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from orrery.operators import affinity, community, evaluate, fuzzy, graph, knn, landmarks, layouts, metrics, pca, preprocess, projection, schema_drift
from orrery.plans.cut import cut
from orrery.sources.tables import table
from orrery.sql import ORACLES as SQL


def p3_found(spark, d):
    return schema_drift.found_changes(table(spark, d, "benchmark_file"), table(spark, d, "benchmark_record"))


def p3_changes(spark, d):
    """Every edit, nested ones too, with its cost."""
    return schema_drift.changes(schema_drift.files_once(table(spark, d, "benchmark_file")), schema_drift.profiles(schema_drift.records_once(table(spark, d, "benchmark_record"))))


def p3_table(spark, d):
    return schema_drift.consistent_table(table(spark, d, "benchmark_file"), table(spark, d, "benchmark_record"))


# --- vectors and neighbours --------------------------------------------------------------------------------------


def _e(spark, d):
    """id, features, label of the embeddings."""
    return preprocess.features(table(spark, d, "embeddings"), "vec_id", "embedding", ["label"])


def _low(spark, d):
    """The first two components as a deterministic stand-in for a layout."""
    return _e(spark, d).select("id", F.slice("features", 1, 2).alias("features"), "label")


def _labels(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")


def _knn(spark, d, k=15, metric="euclidean"):
    return cut(knn.exact_knn(_e(spark, d), k, metric), "knn")


def _low_knn(spark, d, k=15):
    return cut(knn.exact_knn(_low(spark, d), k), "knn")


def _rounded(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


def finite_check(spark, d):
    return preprocess.finite_report(_e(spark, d))


def _long(df):
    return df.select("id", F.posexplode("features").alias("pos", "z")).withColumn("z", F.round("z", 6))


def standardize(spark, d):
    return _long(preprocess.standardized(_e(spark, d)))


def standardize_columns(spark, d):
    """Several numeric columns as features."""
    return _long(preprocess.standardized(preprocess.features(table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"])))


def _lengths(df):
    return df.select("id", F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x), 6).alias("length2"), F.round(F.col("features")[0], 6).alias("first"))


def normalize_rows(spark, d):
    return _lengths(preprocess.rows_for(_e(spark, d), "cosine"))


def normalize_centred_rows(spark, d):
    return _lengths(preprocess.rows_for(_e(spark, d), "correlation"))


def knn_euclidean(spark, d):
    return _rounded(knn.exact_knn(_e(spark, d), 15), "distance")


def knn_cosine(spark, d):
    return _rounded(knn.exact_knn(_e(spark, d), 15, "cosine"), "distance")


def knn_correlation(spark, d):
    return _rounded(knn.exact_knn(_e(spark, d), 15, "correlation"), "distance")


def knn_inner_product(spark, d):
    return _rounded(knn.exact_knn(_e(spark, d), 15, "inner_product"), "distance")


def _split(spark, d):
    e = _e(spark, d)
    return e.where("id % 5 <> 0"), e.where("id % 5 = 0")


def knn_query(spark, d):
    reference, query = _split(spark, d)
    return _rounded(knn.precompute_query_knn(reference, query, 10), "distance")


def knn_nearest_one(spark, d):
    reference, query = _split(spark, d)
    return _rounded(knn.precompute_query_knn(reference, query, 1), "distance")


def knn_self_removed(spark, d):
    """A search that finds each row itself first, with the row removed."""
    e = _e(spark, d)
    return _rounded(knn.trimmed(knn.strip_self(knn.exact_knn(e, 11, query=e)), 10), "distance")


def knn_trimmed(spark, d):
    return _rounded(knn.trimmed(_knn(spark, d), 5), "distance")


def knn_checked(spark, d):
    return knn.knn_problems(_knn(spark, d), _labels(spark, d))


def knn_recall(spark, d):
    return knn.knn_recall(_low_knn(spark, d), _knn(spark, d), 15)


def knn_lists(spark, d):
    """Approximate search through inverted lists: from 8 of 16 on, as many as find nine tenths of the neighbours."""
    return _rounded(knn.ivf_knn(_e(spark, d), 15, n_lists=16, n_probe=8, target_recall=0.9), "distance")


def knn_projected(spark, d):
    """Shortlists by a projection to half the columns, ranked by exact distances."""
    return _rounded(knn.projected_knn(_e(spark, d), 15, columns=32), "distance")


def knn_connectivity(spark, d):
    return graph.connectivity(_knn(spark, d, 3), _labels(spark, d))


# --- labels and batches ------------------------------------------------------------------------------------------


def knn_label_accuracy(spark, d):
    """Exact neighbours -> majority label -> recall per label."""
    return metrics.label_accuracy(metrics.label_votes(_knn(spark, d), _labels(spark, d), 15))


def rare_recall(spark, d):
    return metrics.rare_recall(cut(knn_label_accuracy(spark, d), "classes"))


def _batches(spark, d):
    return _labels(spark, d).select("id", (F.col("id") % 3).alias("batch"))


def batch_mixing(spark, d):
    return metrics.batch_mixing(_knn(spark, d), _batches(spark, d), 15)


def label_batch_tradeoff(spark, d):
    k = _knn(spark, d)
    accuracy = metrics.label_accuracy(metrics.label_votes(k, _labels(spark, d), 15)).agg((F.sum("correct") / F.sum("n")).alias("a"))
    return metrics.batch_mixing(k, _batches(spark, d), 15).crossJoin(accuracy).select(F.round(0.5 * F.col("a") + 0.5 * F.col("batch_mixing"), 4).alias("tradeoff"))


# --- graphs ------------------------------------------------------------------------------------------------------


def _graph(spark, d, **options):
    return graph.knn_graph(_knn(spark, d), **options)


def snn_graph(spark, d):
    return _rounded(_graph(spark, d), "weight")


def snn_graph_pruned(spark, d):
    return _rounded(_graph(spark, d, prune=0.1), "weight")


def distance_graph(spark, d):
    return _rounded(_graph(spark, d, weight="distance"), "weight")


def binary_graph(spark, d):
    return _rounded(_graph(spark, d, weight="binary"), "weight")


def mutual_graph(spark, d):
    return _rounded(_graph(spark, d, mutual=True), "weight")


def graph_degree(spark, d):
    return _rounded(graph.degrees(_graph(spark, d, prune=0.1), _labels(spark, d)), "strength")


def graph_components(spark, d):
    return graph.components(_graph(spark, d, prune=0.3), _labels(spark, d))


def _by_label(spark, d):
    return _labels(spark, d).withColumnRenamed("label", "community")


def modularity_by_label(spark, d):
    return _rounded(graph.modularity(cut(_graph(spark, d), "graph"), _by_label(spark, d)), "modularity")


def community_graph(spark, d):
    return _rounded(graph.community_graph(_graph(spark, d), _by_label(spark, d)), "weight")


def communities_connected(spark, d):
    return graph.communities_connected(_graph(spark, d, prune=0.2), _by_label(spark, d))


# --- UMAP graph and t-SNE affinities -----------------------------------------------------------------------------


def smooth_knn(spark, d):
    return _rounded(fuzzy.smooth_knn(_knn(spark, d)), "rho", "sigma")


def memberships(spark, d):
    return _rounded(fuzzy.memberships(_knn(spark, d)), "weight")


def fuzzy_union(spark, d):
    return _rounded(fuzzy.fuzzy_union(cut(fuzzy.memberships(_knn(spark, d)), "strength")), "weight")


def epoch_schedule(spark, d):
    return _rounded(_rounded(fuzzy.with_schedule(cut(fuzzy.fuzzy_union(cut(fuzzy.memberships(_knn(spark, d)), "strength")), "fuzzy")), "weight"), "epochs_per_sample", places=4)


def binary_union(spark, d):
    return fuzzy.binary_union(_knn(spark, d))


def distance_profile(spark, d):
    return fuzzy.distance_profile(_knn(spark, d, 50))


def perplexity_affinity(spark, d):
    return _rounded(affinity.conditional(_knn(spark, d), 5.0), "p")


def _symmetric(spark, d):
    return cut(affinity.symmetric(cut(affinity.conditional(_knn(spark, d), 5.0), "conditional")), "affinity")


def symmetric_affinity(spark, d):
    return _rounded(_symmetric(spark, d), "p", places=8)


def _plane(spark, d):
    return _low(spark, d).select("id", F.col("features")[0].alias("y1"), F.col("features")[1].alias("y2"))


def tsne_kl(spark, d):
    return _rounded(affinity.kl_cost(_symmetric(spark, d), _plane(spark, d)), "kl")


def tsne_gradient(spark, d):
    return _rounded(affinity.exact_gradient(_symmetric(spark, d), _plane(spark, d)), "g1", "g2", places=8)


# --- quality of a layout -----------------------------------------------------------------------------------------


def rank_metrics(spark, d):
    return metrics.rank_metrics(_e(spark, d), _low(spark, d), (15, 30, 50))


def preservation(spark, d):
    return metrics.preservation(_knn(spark, d), _low_knn(spark, d), 15)


def structure_score(spark, d):
    return metrics.structure_score(_knn(spark, d), _low_knn(spark, d), 15)


def silhouette(spark, d):
    return metrics.silhouette(_low(spark, d).select("id", "features"), _labels(spark, d))


def _pairs(spark, d):
    return cut(metrics.pair_distances(metrics.sampled_pairs(_e(spark, d)), _e(spark, d), _low(spark, d)), "pairs")


def pair_distances(spark, d):
    return _rounded(_pairs(spark, d), "dh", "dl")


def distance_corr(spark, d):
    return metrics.distance_metrics(_pairs(spark, d))


def density(spark, d):
    return metrics.density_metrics(_knn(spark, d), _low_knn(spark, d), 15)


def centroid_corr(spark, d):
    return metrics.centroid_corr(_e(spark, d), _low(spark, d), _labels(spark, d))


def ari_nmi(spark, d):
    return metrics.ari_nmi(_by_label(spark, d), _labels(spark, d).select("id", (F.col("id") % 3).alias("community")))


# --- components, layouts, projections, communities ---------------------------------------------------------------


def pca_scores(spark, d):
    return _long(pca.fit_pca(_e(spark, d), 5).transform(_e(spark, d).select("id", "features")))


def pca_sketch(spark, d):
    """The random-sketch route that wide tables take."""
    return _long(pca.fit_pca(_e(spark, d), 5, method="sketch").transform(_e(spark, d).select("id", "features")))


def pca_new_rows(spark, d):
    """Components of four fifths of the rows, scores of the others."""
    reference, query = _split(spark, d)
    return _long(pca.fit_pca(reference, 5).transform(query.select("id", "features")))


def pca_given(spark, d):
    """Scores of rows by given loadings, centre and scale."""
    given = pca.Pca(np.array([[1.0, 0.0], [0.5, 0.25], [-0.5, 2.0]] + [[0.0, 0.0]] * 61), np.ones(2), np.full(64, 0.125), np.full(64, 0.5), 0)
    return _long(given.transform(_e(spark, d).select("id", "features")))


def pca_start(spark, d):
    return pca.opentsne_pca_init(_e(spark, d)).select("id", F.posexplode("features").alias("pos", "z"))


def scaled_start(spark, d):
    """Two given components as a t-SNE start: centred, the larger standard deviation 1e-4."""
    return pca.scaled_scores(_low(spark, d)).select("id", F.posexplode("features").alias("pos", "z")).withColumn("z", F.round(F.col("z") * 1e4, 6))


def random_start(spark, d):
    return pca.random_init(_labels(spark, d)).select("id", F.posexplode("features").alias("pos", "z"))


def _reference_layout(spark, d):
    return _low(spark, d).where("id % 5 <> 0").select("id", "features")


def _query_knn(spark, d, k):
    reference, query = _split(spark, d)
    return cut(knn.exact_knn(reference, k, query=query), "query-knn")


def project_weighted(spark, d):
    return _long(projection.weighted(_query_knn(spark, d, 10), _reference_layout(spark, d)))


def project_interpolated(spark, d):
    return _long(projection.interpolated(_query_knn(spark, d, 10), _reference_layout(spark, d)))


def transform_init_median(spark, d):
    return _long(projection.start_positions(_query_knn(spark, d, 15), _reference_layout(spark, d), "median"))


def transform_init_weighted(spark, d):
    return _long(projection.start_positions(_query_knn(spark, d, 15), _reference_layout(spark, d), "weighted"))


def _placed(spark, d):
    reference, query = _split(spark, d)
    return projection.affine(_query_knn(spark, d, 12), query, reference, _reference_layout(spark, d))


def project_affine(spark, d):
    return _placed(spark, d)


def low_confidence_rows(spark, d):
    return projection.low_confidence(_placed(spark, d), 0.1)


def transform_tsne(spark, d):
    return projection.transform_tsne(_reference_layout(spark, d), _query_knn(spark, d, 25))


def landmark_places(spark, d):
    """Rows at twenty evenly spaced places along the first four columns."""
    return landmarks.spaced_rows(_e(spark, d).select("id", F.slice("features", 1, 4).alias("features")), 20)


def landmark_selection(spark, d):
    return landmarks.select_landmarks(_e(spark, d).select("id", "features"))


def landmark_split(spark, d):
    """Landmarks given by id, and the rest: a disjoint cover."""
    return landmarks.select_landmarks(_e(spark, d), _e(spark, d).where("id % 5 = 0"))


def umap_start(spark, d):
    return layouts.umap_init(_knn(spark, d)).layout


def umap_layout(spark, d):
    return layouts.umap(_e(spark, d).select("id", "features"), n_neighbors=15).layout


def umap_binary_layout(spark, d):
    return layouts.umap(_e(spark, d).select("id", "features"), n_neighbors=15, graph_mode="binary").layout


def umap_pilot(spark, d):
    return layouts.tuned_umap(_e(spark, d).select("id", "features"), [{"n_epochs": 100}, {"n_epochs": 200, "min_dist": 0.1}], labels=_labels(spark, d))


def tsne_layout(spark, d):
    return layouts.opentsne(_e(spark, d).select("id", "features")).layout


def tsne_fft_layout(spark, d):
    return layouts.opentsne(_e(spark, d).select("id", "features"), negative_gradient_method="fft").layout


def landmark_umap(spark, d):
    return landmarks.landmark_umap(_e(spark, d).select("id", "features"))[1]


def landmark_tsne(spark, d):
    return landmarks.landmark_tsne(_e(spark, d).select("id", "features"))[1]


def _communities(spark, d, method):
    return community.graph_cluster(_graph(spark, d), _labels(spark, d), method).membership


def louvain(spark, d):
    return _communities(spark, d, "louvain")


def leiden(spark, d):
    return _communities(spark, d, "leiden")


def walktrap(spark, d):
    return _communities(spark, d, "walktrap")


def evaluation(spark, d):
    """All figures of the two-component stand-in layout in one row."""
    return evaluate.evaluate_embedding(_e(spark, d).select("id", "features"), _low(spark, d).select("id", "features"), _labels(spark, d), _batches(spark, d))


def evaluation_settled(spark, d):
    """Those of its figures that no random start enters."""
    c = ["primary_k", "trustworthiness", "continuity", "knn_preservation", "knn_preservation_15", "knn_preservation_30", "knn_preservation_50", "mean_neighbor_rank_error", "density_spearman", "density_pearson", "density_log_radius_rmse", "density_sample_size", "silhouette", "centroid_distance_correlation"]
    return evaluation(spark, d).select(*c)


def evaluation_of_umap(spark, d):
    """All figures of a layout made here."""
    return evaluate.evaluate_embedding(_e(spark, d).select("id", "features"), umap_layout(spark, d), _labels(spark, d), _batches(spark, d), method="umap")


def prepare_embedding_data(spark, d):
    """Checked and standardized features."""
    return _long(preprocess.prepared(_e(spark, d).select("id", "features"), standardize=True))


def prepare_embedding_components(spark, d):
    """Checked, standardized and reduced to ten components."""
    return _long(preprocess.prepared(_e(spark, d).select("id", "features"), standardize=True, pca_dims=10))


def refine_rows(spark, d):
    """New rows by affine maps, then moved by the forces of the reference layout."""
    placed = cut(_placed(spark, d).select("id", "features"), "placed")
    return layouts.refine_rows(placed, _query_knn(spark, d, 15), _reference_layout(spark, d))


def projection_confidence(spark, d):
    """The tenth of the new rows of least confidence."""
    return projection.low_confidence(_rounded(_placed(spark, d).select("id", "confidence"), "confidence"), 0.1)


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_")}
ORACLES: dict[str, str] = dict(SQL)
