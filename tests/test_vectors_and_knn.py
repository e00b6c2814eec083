import math
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.functions.ordering import from_ordered_bits, ordered_bits
from orrery.operators import graph, knn, pca, preprocess


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, features array<double>")


def brute(x, k, q=None, metric="euclidean"):
    def unit(a):
        if metric == "correlation":
            a = a - a.mean(1, keepdims=True)
        n = np.linalg.norm(a, axis=1, keepdims=True)
        return a / np.where(n > 0, n, 1) if metric in ("cosine", "correlation") else a

    a, b = unit(x), unit(x if q is None else q)
    out = {}
    for i, v in enumerate(b):
        d = ((a - v) ** 2).sum(1)
        d = -(a @ v) if metric == "inner_product" else 0.5 * d if metric != "euclidean" else np.sqrt(d)
        if q is None:
            d[i] = np.inf
        out[i] = np.lexsort((np.arange(len(d)), d))[:k].tolist()
    return out


def lists(df):
    out = {}
    for r in df.orderBy("src_id", "rank").collect():
        out.setdefault(r.src_id, []).append(r.nbr_id)
    return out


def test_ordered_bits_order_and_return(spark):
    vs = [-1.7976931348623157e308, -2.5, -1.0, -2.2250738585072014e-308, -5e-324, 0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 0.1, 1.0, 1.0000000000000002, 2.0, 3.0, 1.7976931348623157e308]
    df = spark.createDataFrame([(v,) for v in vs], "v double").select("v", ordered_bits(__import__("pyspark.sql.functions", fromlist=["col"]).col("v")).alias("k"))
    got = df.withColumn("back", from_ordered_bits(df.k)).orderBy("k").collect()
    assert [r.v for r in got] == vs and [r.back for r in got] == vs
    bad = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r[0] for r in bad.select(ordered_bits(bad.v)).collect()] == [None] * 3


@pytest.mark.parametrize("metric", knn.METRICS)
def test_exact_search_with_ties_and_copies(spark, metric):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 5, (70, 4)).astype(float)
    x[10] = x[11] = x[12]
    if metric == "correlation":
        x += rng.normal(0, 1, x.shape)
    if metric == "cosine":
        x = rng.normal(0, 1, x.shape)
        x[3] = 0
    got, want = lists(knn.exact_knn(table(spark, x), 6, metric)), brute(x, 6, metric=metric)
    if metric == "cosine":  # every row lies half a unit from an all-zero one, up to rounding
        got.pop(3), want.pop(3)
        assert {round(r.distance, 9) for r in knn.exact_knn(table(spark, x), 6, metric).where("src_id = 3").collect()} == {0.5}
    assert got == want


def test_query_search_keeps_equal_ids(spark):
    rng = np.random.default_rng(613)
    x, q = rng.normal(0, 1, (80, 5)), rng.normal(0, 1, (20, 5))
    assert lists(knn.precompute_query_knn(table(spark, x), table(spark, q), 10)) == brute(x, 10, q)
    with pytest.raises(ValueError):
        knn.precompute_query_knn(table(spark, x), table(spark, q[:, :3]), 5)
    with pytest.raises(ValueError):
        knn.exact_knn(table(spark, x), 80)


def test_blocks_and_partitions_change_nothing(spark, monkeypatch):
    x = np.random.default_rng(44).normal(0, 1, (200, 6))
    want = brute(x, 7)
    monkeypatch.setattr(knn, "REFERENCE_BLOCK", 37)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 23)
    assert lists(knn.exact_knn(table(spark, x).repartition(7), 7)) == want
    assert lists(knn.exact_knn(table(spark, x).coalesce(1), 7)) == want


def test_list_search_recall(spark):
    x = np.random.default_rng(4).normal(0, 1, (600, 12))
    got = knn.ivf_knn(table(spark, x), 10, n_lists=16, n_probe=12)
    r = knn.knn_recall(got, knn.exact_knn(table(spark, x), 10), 10).first()
    assert r.mean_recall >= 0.97
    assert knn.plan_knn(1000, 1000, 10, 5).strategy == "exact" and knn.plan_knn(10**8, 10**8, 100, 15).strategy == "lists"


def test_recall_of_the_lists_query(spark):
    from orrery import queries

    folder = "/root/testdata/sf0.1"
    if not os.path.exists(f"{folder}/embeddings.parquet"):
        pytest.skip("no test data")
    r = knn.knn_recall(queries.knn_lists(spark, folder), queries.knn_euclidean(spark, folder), 15).first()
    print("recall of knn_lists:", r)
    assert r.mean_recall >= 0.9


def test_recall_of_the_projected_query(spark):
    """The query's own parameters, over the whole table."""
    from orrery import queries

    folder = "/root/testdata/sf0.1"
    if not os.path.exists(f"{folder}/embeddings.parquet"):
        pytest.skip("no test data")
    r = knn.knn_recall(queries.knn_projected(spark, folder), queries.knn_euclidean(spark, folder), 15).first()
    print("recall of knn_projected:", r)
    assert r.mean_recall >= 0.9


def test_probes_grow_until_the_recall_holds(spark):
    x = np.random.default_rng(8).normal(0, 1, (1500, 24))
    truth = knn.exact_knn(table(spark, x), 10)
    few = knn.ivf_knn(table(spark, x), 10, n_lists=40, n_probe=4)
    assert knn.knn_recall(few, truth, 10).first().mean_recall < 0.9
    for target in (0.9, 1.0):
        got = knn.ivf_knn(table(spark, x), 10, n_lists=40, n_probe=4, target_recall=target)
        assert knn.knn_recall(got, truth, 10).first().mean_recall >= (target if target < 1 else 0.999)


def test_large_tables_keep_every_neighbour(spark, monkeypatch):
    monkeypatch.setattr(knn, "EXACT_BUDGET", 0)  # every table counts as large
    x = np.random.default_rng(21).normal(0, 1, (700, 16))
    q = np.random.default_rng(22).normal(0, 1, (90, 16))
    assert lists(knn.precompute_knn(table(spark, x), 8)) == brute(x, 8)
    assert lists(knn.precompute_query_knn(table(spark, x), table(spark, q), 8)) == brute(x, 8, q)
    some = knn.knn_recall(knn.precompute_knn(table(spark, x), 8, target_recall=0.95), knn.exact_knn(table(spark, x), 8), 8).first()
    assert some.mean_recall >= 0.95


def test_self_is_stripped_by_rule(spark):
    rows = [(1, 1, 1, 0.0), (1, 2, 2, 1.0), (2, 3, 1, 0.5), (2, 2, 2, 0.6), (3, 1, 1, 0.1), (3, 3, 2, 0.2)]
    df = spark.createDataFrame(rows, "src_id long, nbr_id long, rank long, distance double")
    assert lists(knn.strip_self(df)) == {1: [2], 2: [3], 3: [1]}
    lacking = df.where("NOT (src_id = 3 AND nbr_id = 3)")
    assert lists(knn.strip_self(lacking)) == {1: [1, 2], 2: [3, 2], 3: [1]}
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    with pytest.raises(ValueError):
        knn.supplied_knn(df, ids)


def test_standardize_and_checks(spark):
    x = np.random.default_rng(2).normal(3, 2, (30, 4))
    x[:, 2] = 7.0
    got = np.array([r.features for r in preprocess.standardized(table(spark, x)).orderBy("id").collect()])
    sd = x.std(0, ddof=1)
    assert np.allclose(got, (x - x.mean(0)) / np.where(sd > 1e-12, sd, 1), atol=1e-9)
    for bad in ([[1.0, math.nan]], [[1.0, math.inf]], [[1.0]]):
        with pytest.raises(ValueError):
            preprocess.validated(table(spark, [[1.0, 2.0], *bad]))
    assert preprocess.finite_report(table(spark, [])).first().n_rows == 0
    assert [preprocess.auto_k(n) for n in (100, 1000, 20000, 8)] == [15, 30, 50, 7]


@pytest.mark.parametrize("method", ["gram", "sketch"])
def test_components_equal_numpy(spark, method):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (120, 20)) * np.linspace(5, 0.1, 20)
    fit = pca.fit_pca(table(spark, x), 5, method=method)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = pca.signed(vt[:5].T)
    assert np.allclose(np.abs((fit.loadings * want).sum(0)), 1, atol=1e-4) and np.allclose(fit.singular_values, s[:5], rtol=1e-4)
    scores = np.array([r.features for r in fit.transform(table(spark, x)).orderBy("id").collect()])
    assert np.allclose(scores, (x - fit.center) @ fit.loadings, atol=1e-10)
    start = np.array([r.features for r in pca.opentsne_pca_init(table(spark, x)).collect()])
    assert abs(start.std(0, ddof=1).max() - 1e-4) < 1e-9
    prepared = preprocess.prepared(table(spark, x), pca_dims=3)
    assert len(prepared.first().features) == 3
    assert len(preprocess.prepared(table(spark, x), pca_dims=20).first().features) == 20


def test_random_start_is_centred_and_stable(spark):
    ids = table(spark, np.zeros((50, 1)))
    a = {r.id: r.features for r in pca.random_init(ids.repartition(5)).collect()}
    assert a == {r.id: r.features for r in pca.random_init(ids.coalesce(1)).collect()} or all(np.allclose(a[r.id], r.features, atol=1e-18) for r in pca.random_init(ids.coalesce(1)).collect())
    assert np.allclose(np.mean(list(a.values()), axis=0), 0, atol=1e-12)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=20))
def test_components_of_any_graph(spark, pairs):
    parent = list(range(16))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    vertices = spark.createDataFrame([(i,) for i in range(16)], "id long")
    edges = spark.createDataFrame(pairs, "src long, dst long")
    got = {r.id: r.component for r in graph.components(edges, vertices).collect()}
    assert got == {i: root(i) for i in range(16)}


def test_projected_shortlists_find_nearly_all(spark):
    rng = np.random.default_rng(12)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rng.normal(0, 1, (1500, 40)) @ rng.normal(0, 1, (40, 300)))], "id long, features array<double>")
    for metric in ("euclidean", "cosine", "inner_product"):
        r = knn.knn_recall(knn.projected_knn(df, 10, metric), knn.exact_knn(df, 10, metric), 10).first()
        print("recall of the projected search:", metric, r)
        assert r.mean_recall >= 0.99
    narrow = df.selectExpr("id", "slice(features, 1, 5) AS features")
    assert sorted(knn.projected_knn(narrow, 5).collect()) == sorted(knn.exact_knn(narrow, 5).collect())
