import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import affinity, community, fuzzy, graph, kernels, knn, landmarks, layouts, metrics, projection
from orrery.operators.evaluate import evaluate_embedding


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, features array<double>")


def vertices(spark, n):
    return spark.range(n)


def cliques(spark):
    e = [(a + o, b + o, 1.0) for o in (0, 6, 12) for a in range(6) for b in range(a + 1, 6)] + [(5, 6, 0.15), (11, 12, 0.15)]
    return spark.createDataFrame(e, "src long, dst long, weight double")


def blobs(n=60, seed=0, dims=4, gap=3.0):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(0, 0.2, (n // 2, dims)), rng.normal(gap, 0.2, (n - n // 2, dims))])


def layout_array(df):
    return np.array([r.features for r in df.orderBy("id").collect()])


@pytest.mark.parametrize("method", ["louvain", "leiden", "walktrap"])
def test_three_cliques(spark, method):
    c = community.graph_cluster(cliques(spark), vertices(spark, 18), method, n_runs=2)
    label = [r.community for r in c.membership.orderBy("id").collect()]
    assert label == [1] * 6 + [2] * 6 + [3] * 6 and c.n_communities == 3 and c.modularity > 0.6
    assert all(r.connected for r in c.connected(cliques(spark)).collect())
    assert method in repr(c)


def test_isolated_rows_resolution_and_errors(spark):
    low = community.graph_cluster(cliques(spark), vertices(spark, 20), resolution=0.5)
    high = community.graph_cluster(cliques(spark), vertices(spark, 20), resolution=2.0)
    assert low.n_communities <= high.n_communities and low.membership.count() == 20
    empty = spark.createDataFrame([], "src long, dst long, weight double")
    assert community.graph_cluster(empty, vertices(spark, 3)).n_communities == 3
    with pytest.raises(ValueError):
        community.graph_cluster(empty, vertices(spark, 4001), "walktrap")
    with pytest.raises(ValueError):
        community.graph_cluster(empty, vertices(spark, 3), resolution=0)


def test_block_model_beats_planted_labels(spark):
    rng = np.random.default_rng(13)
    sizes = [45, 55, 65, 75]
    label = np.repeat(np.arange(4), sizes)
    e = [(i, j, float(rng.uniform(0.5, 1.5))) for i in range(240) for j in range(i + 1, 240) if rng.random() < (0.07 if label[i] == label[j] else 0.006)]
    edges = spark.createDataFrame(e, "src long, dst long, weight double")
    planted = spark.createDataFrame([(i, int(c)) for i, c in enumerate(label)], "id long, community long")
    q = graph.modularity(edges, planted).first().modularity
    for method in ("louvain", "leiden", "walktrap"):
        assert community.graph_cluster(edges, vertices(spark, 240), method, n_runs=3).modularity >= q - 0.05


def test_graph_weights_and_checks(spark):
    near = knn.exact_knn(table(spark, blobs(40)), 8)
    g = graph.knn_graph(near).collect()
    assert all(r.src < r.dst and 0 <= r.weight <= 1 for r in g)
    mutual = graph.knn_graph(near, mutual=True).count()
    assert mutual <= len(g)
    bad = spark.createDataFrame([(0, 1, -1.0)], "src long, dst long, weight double")
    with pytest.raises(ValueError):
        graph.validated_graph(bad, vertices(spark, 3))
    twice = spark.createDataFrame([(1, 0, 1.0), (0, 1, 3.0), (2, 2, 1.0)], "src long, dst long, weight double")
    assert [tuple(r) for r in graph.validated_graph(twice, vertices(spark, 3)).collect()] == [(0, 1, 3.0)]


def test_scales_with_copies_and_a_constant_row(spark):
    rows = [(1, j, j, 0.0) for j in range(1, 5)] + [(2, 1, 1, 0.0), (2, 3, 2, 1.0), (2, 4, 3, 2.0), (2, 5, 4, 2.5)]
    near = spark.createDataFrame(rows, "src_id long, nbr_id long, rank long, distance double")
    got = {r.src_id: r for r in fuzzy.smooth_knn(near).collect()}
    assert got[1].rho == 0.0 and got[1].sigma > 0 and got[2].rho == 1.0
    mass = 2 + math.exp(-1.0 / got[2].sigma) + math.exp(-1.5 / got[2].sigma)
    assert abs(mass - 2.0) < 0.2


def test_fitted_curve():
    for min_dist, a, b in ((0.01, 1.8956, 0.8006), (0.1, 1.5769, 0.8951), (0.5, 0.5830, 1.3342)):
        got = fuzzy.find_ab(1.0, min_dist)
        assert abs(got[0] - a) < 0.02 and abs(got[1] - b) < 0.02
    assert fuzzy.umap_parameters(5000, 2.0)["n_epochs"] == 500 and fuzzy.umap_parameters(20_000, 1.2, 1.3)["learning_rate"] == 1.25 and fuzzy.umap_parameters(20_000, 0.7)["n_epochs"] == 300


def test_policies():
    assert affinity.neighbour_policy(100) == (15, 5.0) and affinity.neighbour_policy(100, 12.5) == (13, 12.5)
    with pytest.raises(ValueError):
        affinity.neighbour_policy(10, 9)
    assert [landmarks.auto_count(n) for n in (3, 80, 1000, 10_000)] == [3, 40, 222, 700]
    assert layouts.tsne_schedule(600)["learning_rate"] == 50 and layouts.tsne_schedule(600)["early_iter"] == 250


def test_grid_repulsion_is_close_to_exact():
    y = np.random.default_rng(1).normal(0, 3, (500, 2))
    a, za = kernels.exact_repulsion(y)
    b, zb = kernels.fft_repulsion(y, 256)
    assert abs(za - zb) / za < 0.02 and np.corrcoef(a.ravel(), b.ravel())[0, 1] > 0.99


def test_layouts_keep_blobs_apart_and_repeat(spark):
    x = blobs(90)
    df = table(spark, x)
    label = np.arange(90) >= 45
    e = layouts.umap(df, n_neighbors=10, parameters={"n_epochs": 100})
    y = layout_array(e.layout)
    assert y.shape == (90, 2) and np.isfinite(y).all() and "umap" in repr(e)
    assert np.linalg.norm(y[label].mean(0) - y[~label].mean(0)) > y[label].std()
    again = layout_array(layouts.umap(df.repartition(5), n_neighbors=10, parameters={"n_epochs": 100}).layout)
    assert np.allclose(y, again, atol=1e-6)
    t = layouts.opentsne(df, perplexity=8)
    z = layout_array(t.layout)
    assert np.isfinite(z).all() and metrics.rank_metrics(df, t.layout, (10,)).first().trustworthiness > 0.8
    b = layouts.umap(df, n_neighbors=10, graph_mode="binary", parameters={"n_epochs": 50})
    assert np.isfinite(layout_array(b.layout)).all()
    with pytest.raises(ValueError):
        layouts.opentsne_knn(layouts.TsneKnn(knn.exact_knn(df, 8), 5.0, 90), n_components=4)


def test_cost_falls():
    rng = np.random.default_rng(3)
    x = blobs(80)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = np.argsort(d, 1)[:, 1:11]
    p = kernels.perplexity_rows(np.take_along_axis(d, near, 1), 5.0)
    sym = np.zeros((80, 80))
    np.put_along_axis(sym, near, p, 1)
    sym = (sym + sym.T) / (2 * 80)
    s, t = np.nonzero(sym)
    _, costs = kernels.tsne_optimize(rng.normal(0, 1e-4, (80, 2)), s, t, sym[s, t], 100, 300, record=True)
    assert costs[-1] < costs[2] and np.isfinite(costs).all()


def test_refined_rows_are_pushed_too(spark):
    rng = np.random.default_rng(6)
    ref = np.concatenate([rng.normal(0, 0.3, (40, 2)), rng.normal(6, 0.3, (40, 2))])
    feature = lambda x, first: spark.createDataFrame([(first + i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    start = feature(np.zeros((20, 2)) + rng.normal(0, 0.01, (20, 2)), 100)
    near = spark.createDataFrame([(100 + i, j, j + 1, 0.5 + 0.1 * j) for i in range(20) for j in range(5)], "src_id long, nbr_id long, rank long, distance double")
    run = lambda s, **p: {r.id: r.features for r in layouts.refine_rows(s, near, feature(ref, 0), parameters=p).collect()}
    both, pull = run(start), run(start, negative_samples=0)
    assert run(start.repartition(5)) == both
    middle = ref[:5].mean(0)
    spread = lambda rows: np.mean([np.linalg.norm(np.array(y) - middle) for y in rows.values()])
    assert spread(both) > 1.2 * spread(pull)


def test_landmarks_stay_and_cover(spark):
    df = table(spark, blobs(60))
    sel = landmarks.select_landmarks(df, 30)
    assert sel.count() == 60 and sel.where("is_landmark").count() == 30
    assert landmarks.select_landmarks(df, 0.5).where("is_landmark").count() == 30
    assert landmarks.select_landmarks(df, 100).where("is_landmark").count() == 60
    for method, options in (("umap", {"n_neighbors": 8, "parameters": {"n_epochs": 50}}), ("opentsne", {"perplexity": 5, "n_iter": 100})):
        model = landmarks.fit_landmark_model(df, sel, method, **options)
        placed = landmarks.project_landmark_model(model, df, sel)
        assert placed.count() == 60 and "landmarks=30" in repr(model)
        fixed = {r.id: r.features for r in model.fit.layout.collect()}
        assert all(fixed[r.id] == r.features for r in placed.where("is_landmark").collect())
        assert np.isfinite(layout_array(placed)).all()


def test_affine_copies_and_fits():
    ref_x = np.array([[0.0, 0], [1, 0], [0, 1], [1, 1], [2, 2]])
    ref_y = 2 * ref_x + 1

    def at(*rows, k=5):
        x = np.array(rows)
        d = np.sqrt(((ref_x[None] - x[:, None]) ** 2).sum(2))
        o = np.argsort(d, 1)[:, :k]
        return projection.affine_rows(x, np.take_along_axis(d, o, 1), ref_x[o], ref_y[o])

    y, confidence = at([1.0, 1.0], [0.4, 0.6], [50.0, 50.0])
    assert np.allclose(y[0], [3, 3]) and confidence[0] == 1.0
    assert np.allclose(y[1], [1.8, 2.2], atol=0.05)
    assert np.linalg.norm(y[2] - ref_y.mean(0)) < 20
    # a row's result doesn't depend on the others, nor on room for more neighbours
    for i, row in enumerate(([1.0, 1.0], [0.4, 0.6], [50.0, 50.0])):
        assert np.allclose(at(row)[0][0], y[i])
    x = np.array([[0.4, 0.6]])
    d = np.sqrt(((ref_x - x) ** 2).sum(1))
    o = np.argsort(d)[:3]
    pad = lambda v, fill: np.concatenate([v, np.full((2, *v.shape[1:]), fill)])[None]
    short, c = projection.affine_rows(x, pad(d[o], np.inf), pad(ref_x[o], 0.0), pad(ref_y[o], 0.0))
    assert np.allclose(short, at([0.4, 0.6], k=3)[0]) and np.allclose(c, at([0.4, 0.6], k=3)[1])


def test_transform_ignores_batching():
    rng = np.random.default_rng(2)
    ref, near = rng.normal(0, 1, (80, 2)), rng.integers(0, 80, (30, 15))
    p = kernels.perplexity_rows(np.sort(rng.exponential(1, (30, 15)), 1), 5.0)
    start = ref[near].mean(1)
    whole = kernels.tsne_transform(start, p, ref[near], ref, n_iter=50)
    parts = np.concatenate([kernels.tsne_transform(start[s : s + 7], p[s : s + 7], ref[near[s : s + 7]], ref, n_iter=50) for s in range(0, 30, 7)])
    assert np.allclose(whole, parts)


def test_a_table_evaluated_against_itself(spark):
    df = table(spark, np.random.default_rng(8).normal(0, 1, (40, 4)))
    for r in metrics.rank_metrics(df, df, (3, 5)).collect():
        assert (r.trustworthiness, r.continuity, r.knn_preservation, r.mean_neighbor_rank_error) == (1, 1, 1, 0)
    labels = spark.createDataFrame([(i, i % 3) for i in range(40)], "id long, label int")
    one = evaluate_embedding(df, df, labels, labels.select("id", F.col("label").alias("batch")), (3, 5), local_rows=40).first()
    assert one.distance_pearson == 1 and one.stress == 0 and one.density_log_radius_rmse == 0 and one.density_spearman == 1 and one.n_rows == one.density_sample_size == 40
    assert (one.trustworthiness, one.knn_preservation, one.knn_preservation_3, one.knn_preservation_15, one.global_pair_count) == (1, 1, 1, None, 780)
    assert one.per_class_recall_json.startswith("{") and one.label_batch_tradeoff is not None and not one.evaluation_reference_cache_hit


def test_caches_are_read_again(spark, tmp_path):
    x = np.random.default_rng(9).normal(0, 1, (40, 4))
    df, other = table(spark, x), table(spark, x + 1)
    run = lambda d: evaluate_embedding(d, d, ks=(3,), cache_dir=str(tmp_path / "knn")).first()
    first, second, third = run(df), run(df.repartition(3)), run(other)
    assert (first.evaluation_reference_cache_hit, second.evaluation_reference_cache_hit, third.evaluation_reference_cache_hit) == (False, True, False)
    assert first.evaluation_reference_cache_path == second.evaluation_reference_cache_path and first.density_pearson == second.density_pearson == 1
    a = layouts.opentsne(df, 5, n_iter=20, early_iter=10, cache_dir=str(tmp_path / "start"))
    b = layouts.opentsne(df, 5, n_iter=20, early_iter=10, cache_dir=str(tmp_path / "start"))
    assert len(list((tmp_path / "start").iterdir())) == 1 and np.allclose(layout_array(a.layout), layout_array(b.layout))
    a.layout.write.parquet(str(tmp_path / "saved"))
    assert layout_array(layouts.opentsne(df, 5, init=str(tmp_path / "saved"), n_iter=5, early_iter=0).layout).shape == (40, 2)
    pilot = lambda: layouts.tuned_umap(df, [{"n_epochs": 20}, {"n_epochs": 40}], 5, cache_dir=str(tmp_path / "pilot")).collect()
    assert pilot() == pilot() and len(list((tmp_path / "pilot").iterdir())) == 1


def test_singleton_class_and_tied_votes(spark):
    df = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [5.0])], "id long, features array<double>")
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "id long, label int")
    want = np.mean([(5 - 1) / 5, (4 - 1) / 4, 1.0])
    assert abs(metrics.silhouette(df, labels).first()[0] - want) < 1e-6
    near = spark.createDataFrame([(9, 0, 1, 0.1), (9, 2, 2, 0.2), (9, 5, 3, 0.3)], "src_id long, nbr_id long, rank long, distance double")
    votes = spark.createDataFrame([(9, 1), (0, 1), (2, 0), (5, None)], "id long, label int")
    assert metrics.label_votes(near, votes, 3).where("src_id = 9").first().predicted == 0
