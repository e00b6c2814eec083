import numpy as np
import pytest

from orrery.llm import proximity_graph as pg
from orrery.llm.similar_vectors import probe_pairs, similar_rows

SCHEMA = "row_id long, dataset string, ncol int, matrix_values array<float>, probe boolean, loaded_at timestamp, v string, rep string, usable string, ids string"


def rows(spark, data):
    """(row_id, dataset, ncol, values, probe, loaded_at); further columns have clashing names."""
    from datetime import datetime

    full = [(*r[:5], datetime(2025, 1, r[5]) if r[5] else None, "x", "x", "x", "x") for r in data]
    return spark.createDataFrame(full, SCHEMA)


def brute(items, k):
    out = {}
    for i, x in items:
        near = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), j) for j, y in items if j != i)
        out[i] = [j for _, j in near[:k]]
    return out


def test_lists_equal_brute_force_with_ties_copies_and_versions(spark):
    rng = np.random.default_rng(3)
    points = [(int(i) * 7 + 3, np.float32(rng.integers(0, 6, 3)).tolist()) for i in range(60)]
    points = [(i, x) for i, x in points if any(x)]
    data = [(i, "a", 3, x, i % 5 == 0, 2) for i, x in points]
    data += [(points[0][0], "a", 3, [99.0, 99.0, 99.0], True, 1)]  # an older version, in a later place
    data += [(points[1][0], "a", 3, points[1][1], points[1][0] % 5 == 0, 2)]  # the same row again
    data += [(9001, "a", 3, [1.0, float("nan"), 0.0], True, 2), (9002, "a", 3, [1.0], True, 2), (9003, "a", 3, None, True, 2), (9004, "a", 3, [0.0, 0.0, 0.0], True, 2), (9005, "a", 3, [1.0, None, 2.0], True, 2), (9006, "a", None, [1.0, 2.0, 3.0], True, 2), (9007, None, 3, [1.0, 2.0, 3.0], True, 2), (None, "a", 3, [1.0, 2.0, 3.0], True, 2)]
    data += [(5000, "alone", 2, [1.0, 2.0], None, None), (5001, "pair", 2, [1.0, 2.0], True, None), (5002, "pair", 2, [1.0, 2.0], False, None)]
    out = {r.row_id: r for r in similar_rows(rows(spark, data), 4).collect()}
    want = brute(points, 4)
    assert {i: list(out[i].indices) for i, _ in points} == want
    assert list(out[5000].indices) == [] and list(out[5001].indices) == [5002] and out[5001].distances == [0.0]
    assert set(out) == {i for i, _ in points} | {5000, 5001, 5002}
    pairs = {(r.row_a, r.row_b) for r in probe_pairs(similar_rows(rows(spark, data), 4)).collect()}
    assert pairs == {(min(i, j), max(i, j)) for i, _ in points if i % 5 == 0 for j in want[i]} | {(5001, 5002)}


def test_many_copies_of_one_vector(spark):
    data = [(i, "a", 2, [1.0, 1.0], False, 2) for i in range(100, 150)] + [(i, "a", 2, [1.0, float(i)], False, 2) for i in range(2, 8)]
    out = {r.row_id: list(r.indices) for r in similar_rows(rows(spark, data), 4).collect()}
    assert out[100] == [101, 102, 103, 104] and out[149] == [100, 101, 102, 103]
    assert out[2] == [100, 101, 102, 103] or out[2] == [3, 100, 101, 102]  # 3 lies as near as the copies, with a smaller id
    assert out[2][0] == 3


def test_empty_table(spark):
    assert similar_rows(rows(spark, []), 4).count() == 0


@pytest.mark.parametrize("clusters", [1, 40])
def test_recall_over_several_shards(spark, clusters):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 20, (clusters, 16))
    x = (centres[rng.integers(0, clusters, 3000)] + rng.normal(0, 1, (3000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, "a", 16, v.tolist(), False, None, "", "", "", "") for i, v in enumerate(x)], SCHEMA)
    out = {r.row_id: set(r.indices) for r in similar_rows(df, 10, shard_rows=1000).where("row_id % 10 = 0").collect()}
    hits = 0
    for i, got in out.items():
        d = ((x.astype(float) - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hits += len(got & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits / (10 * len(out)) >= 0.99


def test_pruning_keeps_diverse_links():
    x = np.float32([[0, 0], [1, 0], [1.1, 0], [0, 1], [5, 5]])
    out = pg.robust_prune(x, np.array([0]), np.array([[1, 2, 3, 4, -1, 1]], np.int32), 4, 1.1)
    assert set(out[0][out[0] >= 0]) == {1, 3}  # 2 lies behind 1, 4 behind both
