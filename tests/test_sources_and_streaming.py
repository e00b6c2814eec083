import importlib
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import landmarks
from orrery.plans.cut import cut, shared_folder
from orrery.sources import layouts as saved
from orrery.streaming.projection import project_stream


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, features array<double>")


def test_cut_starts_from_a_scan(spark):
    df = cut(spark.range(10).withColumn("x", F.rand(1)), "t")
    assert "Scan parquet" in df._jdf.queryExecution().executedPlan().toString() and "Range" not in df._jdf.queryExecution().executedPlan().toString()
    assert shared_folder(spark) == shared_folder(spark)


def test_saved_layout_and_cache(spark, tmp_path):
    df = table(spark, np.eye(3))
    saved.save_layout(df, f"{tmp_path}/y")
    assert saved.load_layout(spark, f"{tmp_path}/y").count() == 3
    calls = []

    def make():
        calls.append(1)
        return df.select("id")

    a = saved.cached(df, f"{tmp_path}/c", ("knn", 15), make)
    b = saved.cached(df.repartition(3), f"{tmp_path}/c", ("knn", 15), make)
    assert a.count() == b.count() == 3 and len(calls) == 1
    saved.cached(df, f"{tmp_path}/c", ("knn", 15), make, force=True)
    saved.cached(df.where("id > 0"), f"{tmp_path}/c", ("knn", 15), make)
    assert len(calls) == 3


def test_streamed_rows_get_the_place_of_a_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.2, (30, 4)), rng.normal(3, 0.2, (30, 4))])
    df = table(spark, x)
    model = landmarks.fit_landmark_model(df, landmarks.select_landmarks(df, 40), "umap", n_neighbors=8, parameters={"n_epochs": 30})
    new = table(spark, rng.normal(3, 0.2, (6, 4)), 1000)
    new.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(new.schema).parquet(f"{tmp_path}/in")
    q = project_stream(model, stream, f"{tmp_path}/out", f"{tmp_path}/state", refinement_epochs=10)
    q.awaitTermination(120)
    got = {r.id: r.features for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {r.id: r.features for r in landmarks.project_rows(model, new, refinement_epochs=10).collect()}
    assert set(got) == set(want) and all(np.allclose(got[i], want[i]) for i in want)


def test_contract_without_the_optional_package(monkeypatch):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and all(callable(f) for f in names.values())
    monkeypatch.setitem(sys.modules, "orrery.llm", None)
    bare = importlib.reload(entry)
    try:
        assert "knn_euclidean" in bare.queries() and "p1_found" not in bare.queries() and "p3_found" in bare.queries()
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


@pytest.mark.parametrize("name", ["knn_label_accuracy"])
def test_flagship(spark, name):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
