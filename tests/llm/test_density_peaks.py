import numpy as np

from orrery.llm import density_peaks
from orrery.llm.density_peaks import _Block, cluster_pairs, clusters, described

MATRIX = "row_id long, dataset string, ncol int, matrix_values array<float>, probe boolean, loaded_at timestamp, scale string, peak string"
EDGES = "dataset string, from_id long, to_id long, weight double, peak string"


def test_nearest_columns_are_the_nearest():
    x = np.random.default_rng(0).normal(size=(1003, 5)).astype(np.float32)
    d = ((x[:200, None].astype(float) - x[None]) ** 2).sum(2)
    got = _Block(x).nearest(x[:200], 8, own=False)
    assert np.allclose(got[1], np.sort(d, 1)[:, :8], atol=1e-5) and (got[0][:, 0] == np.arange(200)).all()
    few = _Block(x[:3]).nearest(x[:3], 8, own=True)
    assert np.isfinite(few[1]).sum() == 6 and (np.isfinite(few[1]).sum(1) == 2).all()


def test_blocks_and_kept_neighbours_change_nothing(spark, monkeypatch):
    matrix, edges, *_ = make(spark, 3)
    rows = lambda: sorted(map(tuple, clusters(matrix, edges).drop("scale").collect()))
    want = rows()
    for block, kept in ((25, 8), (7, 3), (60, 4), (1000, 30)):
        monkeypatch.setattr(density_peaks, "BLOCK_ROWS", block)
        monkeypatch.setattr(density_peaks, "KEPT", kept)
        assert rows() == want


def make(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows, truth, i = [], {}, 1000
    for c, (size, spread) in enumerate([(40, 1.0), (4, 0.3), (12, 3.0), (3, 0.5)]):
        centre = rng.normal(0, 60, 12)
        for _ in range(size):
            i += int(rng.integers(1, 5))
            rows.append((i, "a", 12, (centre + rng.normal(0, spread, 12)).tolist()))
            if size >= 4:
                truth[i] = c
    noise = []
    for _ in range(60):
        i += 1
        noise.append(i)
        rows.append((i, "a", 12, rng.normal(0, 60, 12).tolist()))
    first = min(k for k, v in truth.items() if v == 0)
    ones = [k for k, v in truth.items() if v == 0]
    rows += [(5, "a", 12, None), (9000, "a", 12, [float("nan")] * 12), (9001, "a", 12, [0.0] * 12), (9002, "b", 12, None)]
    edges = [("a", 5, ones[0], 0.8), ("a", ones[1], 5, 0.7), ("a", 5, ones[1], 0.9), ("a", 9000, ones[2], 0.9), ("a", 9001, ones[0], 0.05), ("a", 9001, ones[1], 0.05), ("a", 9001, ones[1], float("nan")), ("a", 9001, ones[2], -1.0), ("a", 9001, ones[2], None), ("a", 7, 7, 1.0), ("b", 9002, ones[0], 0.9), ("b", 9002, ones[1], 0.9), (None, None, None, 0.5)]
    matrix = spark.createDataFrame([(*r, False, None, "", "") for r in rows], MATRIX)
    return matrix, spark.createDataFrame([(*e, "") for e in edges], EDGES), truth, first, rows


def test_clusters_noise_and_tied_rows(spark):
    matrix, edges, truth, _, _ = make(spark)
    got = {r.row_id: r.cluster_id for r in clusters(matrix, edges).collect()}
    want = truth | {5: 0}
    assert set(got) == set(want)
    for c in set(truth.values()):
        members = [i for i, v in want.items() if v == c]
        assert {got[i] for i in members} == {min(members)}
    members = clusters(matrix, edges)
    pairs = cluster_pairs(members).collect()
    assert len(pairs) == len(want) - 3 and all(r.row_a < r.row_b for r in pairs)
    told = {r.cluster_id: r for r in described(members).collect()}
    assert told[5].size == 41 and len(told[5].typical_row_ids) == 3 and 5 not in told[5].typical_row_ids


def test_many_copies_count_as_rows(spark):
    matrix, edges, truth, _, rows = make(spark, 1)
    twin = next(r for r in rows if truth.get(r[0]) == 2)
    more = spark.createDataFrame([(20_000 + j, "a", 12, twin[3], False, None, "", "") for j in range(30)], MATRIX)
    got = {r.row_id: r.cluster_id for r in clusters(matrix.unionByName(more), edges).collect()}
    assert all(got[20_000 + j] == got[twin[0]] for j in range(30))


def test_copies_are_a_cluster_of_their_own(spark):
    matrix, edges, truth, _, rows = make(spark, 2)
    lonely = spark.createDataFrame([(30_000 + j, "a", 12, [300.0 + v for v in range(12)], False, None, "", "") for j in range(4)] + [(40_000 + j, "only", 1, [2.0], False, None, "", "") for j in range(5)] + [(50_000, "one", 1, [2.0], False, None, "", "")], MATRIX)
    got = {r.row_id: r.cluster_id for r in clusters(matrix.unionByName(lonely), edges).collect()}
    assert {got[30_000 + j] for j in range(4)} == {30_000} and {got[40_000 + j] for j in range(5)} == {40_000} and 50_000 not in got
    assert set(truth) <= set(got)


def test_empty_tables(spark):
    assert clusters(spark.createDataFrame([], MATRIX), spark.createDataFrame([], EDGES)).count() == 0


def test_scattered_rows_are_no_clusters(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 60, (8, 12))
    rows = [(i, "a", 12, (centres[i % 8] + rng.normal(0, 1, 12)).tolist()) for i in range(160)]
    rows += [(1000 + i, "a", 12, rng.uniform(-150, 150, 12).tolist()) for i in range(1500)]
    matrix = spark.createDataFrame([(*r, False, None, "", "") for r in rows], MATRIX)
    got = {r.row_id: r.cluster_id for r in clusters(matrix, spark.createDataFrame([], EDGES)).collect()}
    assert all(got[i] == i % 8 for i in range(160))
    assert sum(i >= 1000 for i in got) <= 15
