import json
from datetime import datetime

import pytest

from orrery.operators import schema_drift as D
from orrery.operators import schema_trees as T
from orrery.operators.schema_trees import Node, assign, script, tree

FILES = "file_id long, stream_id string, tool string, file_name string, written_at timestamp, received_at timestamp, n_records int, kind string"
RECORDS = "file_id long, record_no int, payload string, path string"


def data(spark, files, records):
    t = lambda d: datetime(2025, 1, d) if d else None
    f = spark.createDataFrame([(i, s, "tool", "f", t(d), t(d), None, "k") for i, s, d in files], FILES)
    r = spark.createDataFrame([(i, n, p if p is None or isinstance(p, str) else json.dumps(p), "p") for i, n, p in records], RECORDS)
    return f, r


def found(spark, files, records):
    return {(r.file_id, r.change_kind, r.field_name) for r in D.found_changes(*data(spark, files, records)).collect()}


def test_every_kind_of_change(spark):
    files = [(3, "s", 9), (1, "s", 1), (2, "s", 5), (4, "s", 10), (5, "s", 12), (9, "s", 7), (7, None, 1)]
    records = [
        (1, 1, {"total_time_sec": 1.5, "status": "ok", "n": 3, "flag": True}), (1, 2, {"total_time_sec": 2, "status": None}), (1, 2, {"total_time_sec": 2, "status": None}),
        (2, 1, {"time_total_s": 4, "status": ["ok"], "n": 3, "flag": True}), (2, 2, "not json"), (2, 3, None), (2, 4, "[1]"),
        (3, 1, {"time_total_s": 4, "run_status": ["ok"], "flag": "yes", "host": "a"}),
        (4, 1, {"time_total_s": None, "run_status": ["ok"], "flag": "no", "host": None}),
        (5, 1, {"time_total_s": "4", "run_status": ["ok"], "flag": "no", "host": 5}), (5, 2, {"time_total_s": 4}), (5, 3, {"time_total_s": 6}),
        (7, 1, {"x": 1}), (None, 1, {"x": 1}),
    ]
    assert found(spark, files, records) == {
        (2, "renamed", "time_total_s"), (2, "retyped", "status"), (3, "renamed", "run_status"), (3, "removed", "n"), (3, "retyped", "flag"), (3, "added", "host"), (5, "retyped", "host"),
    }


def test_kind_is_remembered_through_a_rename_without_values(spark):
    files = [(1, "s", 1), (2, "s", 2), (3, "s", 3)]
    records = [(1, 1, {"raw_p": 5, "n": 1}), (2, 1, {"p_raw": None, "n": 1}), (3, 1, {"p_raw": "many", "n": 1})]
    assert found(spark, files, records) == {(2, "renamed", "p_raw"), (3, "retyped", "p_raw")}


def test_moves_into_and_out_of_objects_are_found(spark):
    files = [(1, "s", 1), (2, "s", 2), (3, "s", 3)]
    records = [(1, 1, {"host": "a", "o": {"n": 1, "q": 2}}), (2, 1, {"o": {"n": 1, "q": 2, "host": "a"}}), (3, 1, {"host": "a", "o": {"n": 1, "q": 2}})]
    assert found(spark, files, records) == {(2, "removed", "host"), (3, "added", "host")}


def test_records_without_number_are_all_kept(spark):
    files, records = [(1, "s", 1), (2, "s", 2)], [(1, 1, {"a": 1, "b": 2, "host": "x"}), (2, None, {"a": 1}), (2, None, {"b": 2}), (2, None, {"host": "x"}), (2, None, {"a": 1})]
    assert D.records_once(data(spark, files, records)[1]).count() == 4
    assert found(spark, files, records) == set()


def test_changes_of_deep_fields(spark):
    deep = lambda v: {"a": {"b": {"c": {"d": {"e": {"f": v}}}}}}
    f, r = data(spark, [(1, "s", 1), (2, "s", 2)], [(1, 1, deep(5)), (2, 1, deep("many"))])
    got = D.changes(D.files_once(f), D.profiles(D.records_once(r))).collect()
    assert [(e.change_kind, e.field_path, e.old_kind, e.new_kind) for e in got] == [("retyped", "a\x1fb\x1fc\x1fd\x1fe\x1ff", "number", "text")]


def test_consistent_table(spark):
    files = [(1, "s", 1), (2, "s", 2), (3, "s", 3), (4, None, 1)]
    records = [(1, 1, {"raw_p": 5, "tool": "a"}), (2, 1, {"rawP": {"value": 6, "rev": 2}, "tool": "b"}), (3, 1, {"raw.p": ["7"], "tool": "c", "ok": True}), (4, 1, {"raw_p": 8})]
    rows = {r.file_id: r for r in D.consistent_table(*data(spark, files, records)).collect()}
    assert {i: r.raw_p for i, r in rows.items()} == {1: 5.0, 2: 6.0, 3: 7.0, 4: 8.0}
    assert rows[3].ok is True and rows[2].field_tool == "b" and rows[1].tool == "tool"


def test_consistent_table_keeps_every_member_and_stray_value(spark):
    files = [(1, "s", 1), (2, "s", 2), (3, "s", 3), (4, "s", 4)]
    records = [
        (1, 1, {"p": {"rev": 2, "value": 6.5}, "m": {"mean": 1, "sd": 2}, "w": {"only": [3]}, "l": [1, 2]}),
        (1, 2, {"p": {"value": 7, "rev": None}, "m": {"sd": 4}, "w": None, "l": [[8, 9]]}),
        (2, 1, {"p": 5, "m": None, "l": [3, 4], "p_rev": "x"}), (3, 1, {"p": [4], "l": [5, 6]}), (4, 1, {"p": "see o'note", "l": []}),
    ]
    rows = {(r.file_id, r.record_no): r for r in D.consistent_table(*data(spark, files, records)).collect()}
    assert {i: r.p for i, r in rows.items()} == {(1, 1): 6.5, (1, 2): 7.0, (2, 1): 5.0, (3, 1): 4.0, (4, 1): None}
    a, b = rows[1, 1], rows[1, 2]
    assert (a.m_mean, a.m_sd, a.w, a.l, a.p_rev_2) == (1.0, 2.0, 3.0, "[1, 2]", 2.0)
    assert (b.m_mean, b.m_sd, b.l, b.p_rev_2) == (None, 4.0, "[8, 9]", None)
    assert rows[2, 1].p_rev == "x"
    assert json.loads(rows[4, 1].unfit_values) == {"p": "see o'note"} and {r.unfit_values for i, r in rows.items() if i != (4, 1)} == {None}
    assert D.leaf_of({"rev": 2, "value": "x"}) == D.leaf_of({"value": "x", "rev": 2}) == "text"


def test_empty_tables(spark):
    assert found(spark, [], []) == set()
    assert D.consistent_table(*data(spark, [], [])).count() == 0


def test_scripts():
    old = tree([("a", "number", "number"), ("o", "object", None), ("o\x1fx", "text", "text"), ("o\x1fy", "number", "number")])
    new = tree([("a", "number", "number"), ("o", "object", None), ("o\x1fy", "list", "number"), ("x", "text", "text")])
    edits = {(e.change, e.path) for e in script(old, new)}
    assert edits == {("moved", "x"), ("retyped", "o\x1fy")}
    assert script(old, old) == []
    gone = script(Node("object", None, {"peak_ram_mb": Node("number", "number")}), Node("object", None, {"gpu_mem_mb": Node("number", "number")}))
    assert {(e.change, e.path) for e in gone} == {("removed", "peak_ram_mb"), ("added", "gpu_mem_mb")}


@pytest.mark.parametrize("seed", range(5))
def test_pairing_is_the_cheapest(seed):
    import itertools

    import numpy as np

    c = np.random.default_rng(seed).integers(0, 20, (4, 6)).astype(float)
    got = assign(c.tolist())
    best = min(sum(c[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(6), 4))
    assert len(set(got)) == 4 and sum(c[i, j] for i, j in enumerate(got)) == best


@pytest.fixture(params=["true", "false"])
def ranges(spark, request):
    """One range, as small tables get it, and several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param)
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_looking_back_over_ranges_equals_a_loop(spark, ranges):
    import numpy as np

    from pyspark.sql import functions as F

    from orrery.plans.ranged import carried, summed_before

    rng = np.random.default_rng(3)
    rows = [("hot" if rng.random() < 0.8 else f"g{int(rng.integers(4))}", i, None if rng.random() < 0.6 else int(rng.integers(100))) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, t long, v long").repartition(5)
    for current in (True, False):
        got = {r.t: r.o for r in carried(df, ["g"], ["t"], {"v": "o"}, current).collect()}
        last: dict = {}
        for g, t, v in rows:
            if current and v is not None:
                last[g] = v
            assert got[t] == last.get(g)
            if v is not None:
                last[g] = v
    got = {r.t: r.o for r in summed_before(df.where("v IS NOT NULL"), ["g"], [F.col("t").desc()], "v", "o").collect()}
    assert got == {t: sum(w for h, u, w in rows if h == g and u > t and w is not None) for g, t, v in rows if v is not None}
    assert carried(df.where("t < 0"), ["g"], ["t"], {"v": "o"}, True).count() == 0 == summed_before(df.where("t < 0"), ["g"], ["t"], "v", "o").count()


def numbers_in_files(spark, old, new, extra=None, stream="s"):
    """What is found where a field of the values ``old`` (name, values) goes and one of ``new`` comes."""
    records = [(i, n, {name: v, "k": "same"}) for i, (name, values) in enumerate((old, new), 1) for n, v in enumerate(values)]
    return found(spark, [(1, stream, 1), (2, stream, 2)] + [(i, "t", i) for i in {r[0] for r in extra or []}], records + (extra or []))


def test_values_speak_against_a_likely_name(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    assert numbers_in_files(spark, ("lat", rng.uniform(-90, 90, 20).tolist()), ("latency", rng.uniform(5, 50, 20).tolist())) == {(2, "removed", "lat"), (2, "added", "latency")}
    assert numbers_in_files(spark, ("lat", rng.uniform(-90, 90, 20).tolist()), ("latitude", rng.uniform(-90, 90, 20).tolist())) == {(2, "renamed", "latitude")}


def test_values_speak_for_an_unlikely_name(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    assert numbers_in_files(spark, ("elapsed", rng.lognormal(1, 1, 300).tolist()), ("duration", rng.lognormal(1, 1, 300).tolist())) == {(2, "renamed", "duration")}
    again = rng.lognormal(1, 1, 20).tolist()
    assert numbers_in_files(spark, ("knn_time_sec", again), ("neighbour_seconds", again)) == {(2, "renamed", "neighbour_seconds")}
    assert numbers_in_files(spark, ("outcome", ["good", "bad", "late"] * 4), ("verdict", ["late", "good", "bad"] * 2)) == {(2, "renamed", "verdict")}
    assert numbers_in_files(spark, ("outcome", ["good", "bad", "late"] * 4), ("verdict", ["a", "b", "c"] * 2)) == {(2, "removed", "outcome"), (2, "added", "verdict")}


def test_fields_that_stand_side_by_side_are_no_renames(spark):
    one = [("sum_time_sec", [1.0]), ("own_time_sec", [1.0])]
    assert numbers_in_files(spark, *one) == {(2, "renamed", "own_time_sec")}
    both = [(8, 1, {"sum_time_sec": 2.0, "own_time_sec": 1.0})]
    assert numbers_in_files(spark, *one, both) == {(2, "removed", "sum_time_sec"), (2, "added", "own_time_sec")}


def test_numbers_beyond_doubles_and_odd_texts(spark):
    odd = ['{"a": 1%s, "b": NaN, "c": Infinity, "d": "\\\\ud800", "e": "1e999", "f": []}' % ("0" * 400), '{"a": -1, "b": 2, "c": null, "d": "", "e": "+", "f": {}}']
    assert found(spark, [(1, "s", 1), (2, "s", 2)], [(1, 1, odd[0]), (2, 1, odd[1])]) == {(2, "retyped", "f")}


def brute_cost(old, new):
    """Least cost of pairing two flat schemas of which no name stays, over all pairings."""
    import itertools

    a, b = sorted(old.children), sorted(new.children)
    best = len(a) + len(b)
    for k in range(1, min(len(a), len(b)) + 1):
        for x in itertools.combinations(a, k):
            for y in itertools.permutations(b, k):
                costs = []
                for p, q in zip(x, y, strict=True):
                    alike = T.Names(old.children, new.children).likeness(p, q) + (T.evidence(old.children[p], new.children[q]) or 0.0)
                    if alike < T.ALIKE:
                        break
                    costs.append(0.2 + 1.2 * (1 - min(1.0, alike)))
                else:
                    best = min(best, sum(costs) + len(a) + len(b) - 2 * k)
    return best


@pytest.mark.parametrize("seed", range(20))
def test_script_of_a_flat_schema_costs_least(seed):
    import random

    rng = random.Random(seed)
    parts = ["run", "time", "total", "sec", "state", "mem", "peak"]
    make = lambda n: {"_".join(rng.sample(parts, rng.randint(1, 3))): Node("text", "text") for _ in range(n)}
    x, y = make(5), make(4)
    shared = set(x) & set(y)
    old, new = (Node("object", None, {k: v for k, v in s.items() if k not in shared}) for s in (x, y))
    assert sum(e.cost for e in script(old, new)) == pytest.approx(brute_cost(old, new))


def test_a_rename_counts_what_is_below():
    leaf = lambda: Node("number", "number")
    old = Node("object", None, {"host_info": Node("object", None, {"cores": leaf(), "ram": leaf(), "disk": leaf()})})
    new = Node("object", None, {"host": Node("object", None, {"city": leaf(), "zip": leaf(), "floor": leaf()}), "info_of_machine": Node("object", None, {"cores": leaf(), "ram": leaf(), "disk": leaf()})})
    edits = {(e.change, e.path) for e in script(old, new)}
    assert edits == {("renamed", "info_of_machine"), ("added", "host")}


def test_moves_compete_with_renames():
    text = lambda: Node("text", "text")
    old = Node("object", None, {"name": text(), "site": text()})
    new = Node("object", None, {"site_name": text(), "owner": Node("object", None, {"name": text()})})
    edits = {(e.change, e.path, e.old_path) for e in script(old, new)}
    assert edits == {("moved", "owner\x1fname", "name"), ("renamed", "site_name", "site"), ("added", "owner", "")}
    # an object that goes while two of its members come out
    old = Node("object", None, {"pos": Node("object", None, {"lat": text(), "lon": text()})})
    new = Node("object", None, {"lat": text(), "lon": text()})
    assert {(e.change, e.path) for e in script(old, new)} == {("moved", "lat"), ("moved", "lon"), ("removed", "pos")}
