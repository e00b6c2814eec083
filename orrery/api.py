"""All public functions in one place."""

from orrery.operators.affinity import neighbour_policy
from orrery.operators.community import graph_cluster
from orrery.operators.evaluate import evaluate_embedding
from orrery.operators.graph import graph_of, knn_graph
from orrery.operators.knn import precompute_knn, precompute_query_knn
from orrery.operators.landmarks import fit_landmark_model, landmark_tsne, landmark_umap, project_landmark_model, select_landmarks
from orrery.operators.layouts import embed_knn, opentsne, opentsne_knn, prepare_opentsne_knn, umap, umap_init, umap_knn
from orrery.operators.fuzzy import prepare_umap_knn
from orrery.operators.pca import fit_pca as pca
from orrery.operators.pca import opentsne_pca_init
from orrery.operators.preprocess import features, prepared as prepare_embedding_data
from orrery.operators.projection import transform_tsne

__all__ = [
    "embed_knn", "evaluate_embedding", "features", "fit_landmark_model", "graph_cluster", "graph_of", "knn_graph", "landmark_tsne", "landmark_umap", "neighbour_policy", "opentsne", "opentsne_knn", "opentsne_pca_init", "pca", "precompute_knn",
    "precompute_query_knn", "prepare_embedding_data", "prepare_opentsne_knn", "prepare_umap_knn", "project_landmark_model", "select_landmarks", "transform_tsne", "umap", "umap_init", "umap_knn",
]
