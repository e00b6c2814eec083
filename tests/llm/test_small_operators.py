"""Top N, percentiles, rank fusion, packing against brute force, with nulls, ties, repeats and empty tables."""

import math
from collections import defaultdict
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import packing, percentiles, rank_fusion
from orrery.llm.top_per_group import nearest_nodes, top_per_group

INF, NAN = float("inf"), float("nan")


# --- top N -------------------------------------------------------------------------------------------------------


def brute_top(rows, n):
    best = defaultdict(dict)
    for g, i, d in rows:
        if g is None or i is None or d is None or math.isnan(d) or math.isinf(d) or d < 0:
            continue
        best[g][i] = min(d, best[g].get(i, INF))
    return {(g, i) for g, items in best.items() for i, _ in sorted(items.items(), key=lambda t: (t[1], t[0]))[:n]}


@pytest.mark.parametrize("split", [5, 1000])
def test_top_of_groups_with_ties_repeats_and_unusable_rows(spark, split):
    rng = np.random.default_rng(1)
    rows = [(int(rng.zipf(1.5)) % 7, int(rng.integers(0, 40)), float(rng.integers(0, 6))) for _ in range(400)]
    rows += [(None, 1, 1.0), (1, None, 1.0), (1, 2, None), (1, 3, NAN), (1, 4, INF), (1, 5, -1.0), (99, 1, NAN), (98, 7, 0.0)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "search_id long, id long, distance float, layer int, _sub int, n_sub int")
    usable = (df.distance >= 0) & (df.distance < INF)
    got = top_per_group(df, "search_id", "id", "distance", 10, usable, split_rows=split).collect()
    assert {(r.search_id, r.id) for r in got} == brute_top(rows, 10)
    assert len(got) == len({(r.search_id, r.id) for r in got})
    for g in {r.search_id for r in got}:
        own = sorted((r for r in got if r.search_id == g), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(1, len(own) + 1))
        assert [(r.distance, r.id) for r in own] == sorted((r.distance, r.id) for r in own)


def test_top_of_nothing_and_from_the_other_end(spark):
    df = spark.createDataFrame([], "search_id long, id long, distance float")
    assert nearest_nodes(df).count() == 0
    df = spark.createDataFrame([(1, i, float(i % 5)) for i in range(20)], "g long, i long, s double")
    assert [r.i for r in top_per_group(df, "g", "i", "s", 3, descending=True).orderBy("position").collect()] == [4, 9, 14]


# --- percentiles -------------------------------------------------------------------------------------------------

RUN = "run_id long, dataset string, implementation string, run_at timestamp, loaded_at timestamp, status string, embedding_time_sec double, total_time_sec double, value string, n int"


def test_exact_percentiles_and_slow_runs(spark):
    rng = np.random.default_rng(2)
    t = datetime(2025, 1, 1)
    rows = [(i, "a" if i % 3 else None, "x", t, t, "success", float(np.exp(rng.normal())), float(rng.integers(1, 4)), "", 0) for i in range(500)]
    rows += [rows[0], rows[1]]
    rows += [(1000, "a", "x", t, t, "failed", 1e9, 1e9, "", 0), (1001, "a", None, t, t, "success", 1e9, 1e9, "", 0), (1002, "a", "x", t, t, "success", NAN, INF, "", 0), (1003, "a", "x", t, t, "success", -1.0, 0.0, "", 0), (1004, "a", "x", t, t, "success", None, None, "", 0), (None, "a", "x", t, t, "success", 1e9, 1e9, "", 0), (1005, "a", "x", t, t, "success", 1e6, 2.0, "", 0)]
    df = spark.createDataFrame(rows, RUN)
    values = percentiles.measures(df)
    got = {(r.dataset, r.measure_name, r.permille): r for r in percentiles.radix_percentiles(values, percentiles.GROUP).collect()}
    want = defaultdict(list)
    for r in {r[0]: r for r in rows if r[0] is not None}.values():
        for name, v in (("embedding_time_sec", r[6]), ("total_time_sec", r[7])):
            if r[5] == "success" and r[2] and v is not None and 0 < v < INF:
                want[r[1], name].append(v)
    for (dataset, name), vs in want.items():
        for q in percentiles.PERMILLE:
            r = got[dataset, name, q]
            assert r.value == r.low == r.high == sorted(vs)[max(1, (len(vs) * q + 999) // 1000) - 1] and r.n == len(vs)
    assert len(got) == 4 * len(want)
    assert [(r.run_id, r.measure_name) for r in percentiles.slow_runs(df).where("run_id >= 1000").collect()] == [(1005, "embedding_time_sec")]


def test_digests_of_days_add_up_within_their_bound(spark):
    rng = np.random.default_rng(4)
    rows = [("a", d, float(v)) for d in range(5) for v in np.exp(rng.normal(d, 2, 200))] + [("a", 1, -3.5), ("a", 1, 0.0), ("a", 1, None), ("a", 1, NAN)]
    df = spark.createDataFrame(rows, "g string, day int, value double")
    merged = percentiles.merge_digests(percentiles.digest(df, ["g", "day"]), ["g"])
    exact = {r.permille: r.value for r in percentiles.radix_percentiles(df, ["g"]).collect()}
    got = percentiles.digest_percentiles(merged, ["g"]).collect()
    assert len(got) == 4
    for r in got:
        assert r.low <= exact[r.permille] <= r.high and r.high - r.low <= abs(r.high) * 2**-16


def test_extreme_values_and_no_values(spark):
    vs = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308, 1.0, 1.0000000000000002, 2.0, 0.1, -7.25]
    df = spark.createDataFrame([("g", v) for v in vs], "g string, value double")
    for q in range(0, 1001, 50):
        r = percentiles.radix_percentiles(df, ["g"], permille=[q]).first()
        assert r.value == sorted(vs)[max(1, (len(vs) * q + 999) // 1000) - 1]
        if q == 100:
            break
    r = percentiles.radix_percentiles(df, ["g"], permille=[1000]).first()
    assert r.value == max(vs)
    assert percentiles.radix_percentiles(df.where("g = 'none'"), ["g"]).count() == 0


# --- one ranking -------------------------------------------------------------------------------------------------

ACC = "panel_id long, item_id long, thread_id int, preservation_sum double, trust_sum double, continuity_sum double, label_accuracy_sum double, label_accuracy_n int, scored int, scored_at timestamp, place int, position int"


def acc(spark, rows):
    return spark.createDataFrame([(*r, datetime(2025, 1, 1), 0, 0) for r in rows], ACC)


def test_items_threads_repeats_and_missing_scores(spark):
    rows = [
        (1, 1, 0, 10.0, 5.0, 5.0, 4.0, 5, 10), (1, 1, 1, 2.0, 1.0, 1.0, 0.0, 0, 2), (1, 1, 0, 10.0, 5.0, 5.0, 4.0, 5, 10),
        (1, 2, 0, 5.0, 2.0, 3.0, NAN, 0, 10), (1, 3, 0, NAN, NAN, NAN, NAN, 9, 10), (1, 4, 0, None, None, None, 1.0, 2, 10), (1, 5, 0, 0.0, 0.0, 0.0, 0.0, 0, 0), (1, 6, 0, 8.0, None, NAN, None, None, 10),
        (None, 1, 0, 1.0, 1.0, 1.0, 1.0, 1, 1), (1, None, 0, 1.0, 1.0, 1.0, 1.0, 1, 1),
    ]
    got = {r.item_id: (r.preservation, r.trust, r.continuity, r.label_accuracy) for r in rank_fusion.item_scores(acc(spark, rows)).collect()}
    assert got == {1: (1.0, 0.5, 0.5, 0.8), 2: (0.5, 0.2, 0.3, None), 6: (0.8, None, None, None)}


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_places_with_ties_equal_sorting(spark, coalesce):
    rng = np.random.default_rng(6)
    rows = [(int(i % 3), i, float(rng.integers(-5, 5)) / 7) for i in range(90)]
    df = spark.createDataFrame(rows, "g long, i long, v double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    shared = {r.i: r.p for r in rank_fusion.places(df, ["g"], "v", "p").collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g, i, v in rows:
        assert shared[i] == 1 + sum(b > v for h, _, b in rows if h == g)


def test_any_scale_is_ranked(spark):
    rows = [(1, i, 0, x, x, x, None, 0, 1) for i, x in enumerate([3e-13, 1e-13, 4e-13, 2e-13, 5e300, 1e30, -1e30, 0.0, 1e-320], 1)]
    # threads that add up to what one thread has
    rows += [(2, 1, 0, 0.1, 0.1, 0.1, None, 0, 1), (2, 1, 1, 0.2, 0.2, 0.2, None, 0, 1), (2, 2, 0, 0.3, 0.3, 0.3, None, 0, 2), (2, 3, 0, 1e-200, 1e-200, 1e-200, None, 0, 1), (2, 3, 1, 2e-200, 2e-200, 2e-200, None, 0, 1), (2, 4, 7, 3e-200, 3e-200, 3e-200, None, 0, 2)]
    got = rank_fusion.ranking(acc(spark, rows)).collect()
    assert [r.item_id for r in sorted(got, key=lambda r: (r.panel_id, r.position)) if r.panel_id == 1] == [5, 6, 3, 1, 4, 2, 9, 8, 7]
    assert {r.item_id: r.median_rank for r in got if r.panel_id == 2} == {1: 1.0, 2: 1.0, 3: 3.0, 4: 3.0}
    scores = {(r.panel_id, r.item_id): r.trust for r in rank_fusion.item_scores(acc(spark, rows)).collect()}
    assert scores[1, 5] == 5e300 and scores[1, 9] == 1e-320 and scores[2, 1] == 0.15 and scores[2, 3] == 1.5e-200


def test_no_score_rules_by_its_range(spark):
    rows = [(1, i, 0, 1e9 * p, t, c, a, 1, 1) for i, (p, t, c, a) in enumerate([(9, 0.1, 0.1, 0.1), (1, 0.9, 0.9, 0.9), (2, 0.8, 0.8, 0.8)], 1)]
    order = rank_fusion.ranking(acc(spark, rows)).orderBy("position").collect()
    assert [r.item_id for r in order] == [2, 3, 1] and [r.mean_rank for r in order] == [1.5, 2.0, 2.5]
    assert [r.median_rank for r in order] == [1.0, 2.0, 3.0]
    assert rank_fusion.ranking(acc(spark, [])).count() == 0


def test_weighted_median(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 9.0), (1, 2, 2.0, 8.0), (1, 3, 3.0, 7.0)], "panel_id long, item_id long, x double, y double")
    got = {r.item_id: r.median_rank for r in rank_fusion.fused(df, ["x", "y"], {"x": 3.0, "y": 1.0}).collect()}
    assert got == {1: 3.0, 2: 2.0, 3: 1.0}


# --- packing -----------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_every_item_once_and_none_over(sizes):
    bins = packing.best_two_fit(np.array(sizes, int), 50)
    assert sorted(s for b in bins for s in b) == sorted(sizes) and all(sum(b) <= 50 for b in bins)
    assert len(bins) <= max(1, math.ceil(1.5 * sum(sizes) / 50) + 1) or not sizes


def test_two_fit_better_than_one():
    assert sorted(map(sorted, packing.best_two_fit(np.array([6, 3, 2, 2]), 10))) == [[2, 2, 6], [3]]


def test_packing_texts(spark):
    words = "alpha beta gamma delta "
    docs = [(i, words * (i % 9)) for i in range(200)] + [(900, None), (901, ""), (902, "token " * 1500), (None, "x"), (3, "again")]
    df = spark.createDataFrame([(*r, 1, "c") for r in docs], "doc_id long, text string, n_tokens int, capacity string")
    plans = spark.createDataFrame([("a", 64, "byte_bpe_50k"), ("b", 1024, "byte_bpe_50k"), ("a", 64, "byte_bpe_50k"), (None, 5, "byte_bpe_50k"), ("z", 0, "byte_bpe_50k")], "plan_name string, capacity int, tokenizer string")
    got = packing.pack(df, plans, share_rows=50).collect()
    assert {r.plan_name for r in got} == {"a", "b"}
    held = defaultdict(int)
    for r in got:
        held[r.plan_name, r.container_id] += r.n_tokens
    capacity = {"a": 64, "b": 1024}
    assert all(v <= capacity[p] for (p, _), v in held.items())
    for plan in capacity:
        own = [r for r in got if r.plan_name == plan]
        assert {r.doc_id for r in own} == {d for d, _ in docs if d is not None}
        parts = sorted((r.part_no, r.n_tokens) for r in own if r.doc_id == 902)
        assert [p for p, _ in parts] == list(range(len(parts))) and all(n == capacity[plan] for _, n in parts[:-1])
        assert len([r for r in own if r.doc_id == 3]) == 2
        assert all(r.n_tokens == 0 for r in own if r.doc_id in (900, 901))
    assert packing.pack(df.where("doc_id = -1"), plans).count() == 0
    assert {r.plan_name for r in packing.fill(packing.pack(df, plans)).collect()} == {"a", "b"}
