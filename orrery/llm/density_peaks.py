"""Problem 5: clusters of similar rows by density peaks, with blocked neighbour joins.

The distinct vectors of a dataset are hashed into blocks. Every pair of blocks of a dataset is one task's work (a few products
of two matrices), so the work spreads evenly however large a dataset is, and what leaves a task is a few neighbours per row,
never the pairs. Pass one gives each row its nearest neighbours and from them its scale (the distance within which three
other rows lie; a small scale is a high density). A row's nearest denser row is mostly among those neighbours; pass two looks
for it among all rows only for those whose known neighbours are all less dense and yet all lie within reach. Pointers to
denser rows that are long for the scale of their target are cut; following the others gives trees, and a tree whose peak lies
apart from everything denser and whose rows have their nearest rows inside it is a cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.rows import doubles_of, latest_rows, points_of
from orrery.plans.cut import cut
from orrery.plans.pointers import follow
from orrery.plans.sizing import heavy_partitions

#: Distinct rows of a block; a task holds two blocks.
BLOCK_ROWS = 32_768
#: Other rows within the scale of a row: a cluster has at least one more.
NEIGHBOURS = 3
#: A pointer longer than this many scales of its target leaves the cluster.
REACH = 2.2
#: A peak lies apart if its nearest denser row is farther than this many of its scales; with heavy edges inside, this many.
APART, APART_WITH_EDGES = 1.4, 1.15
#: An edge of at least this weight ties its ends together; so many of them tie an unusable row to a cluster.
HEAVY_WEIGHT, SEVERAL = 0.2, 2
MIN_ROWS = 4
#: The rows of a cluster lie together: of their NEIGHBOURS nearest rows at least this part are in it. In a tree of scattered rows,
#: which have neighbours in other trees, it is about a half; in a cluster nearly all, so the value matters little.
CLOSED = 0.8
#: Neighbours of a row that pass one keeps (copies counted); any number from NEIGHBOURS on gives the same clusters.
KEPT = 8

#: Columns of a chunk whose least value is looked at first, and rows of a strip.
CHUNK, STRIP = 16, 64


def _matrix(column) -> np.ndarray:
    a = column.combine_chunks()
    return np.asarray(a.flatten(), np.float32).reshape(len(a), -1)


class _Block:
    """Squared distances from strips of rows to the rows of ``y``, short of each row's own square.

    One matrix product in single precision per strip; what is chosen by it is measured again in double precision. Columns
    are padded with infinity to whole chunks; chunk j has the columns j, j + width, j + 2 width and so on.
    """

    def __init__(self, y: np.ndarray):
        self.n, self.width = len(y), -(-len(y) // CHUNK)
        self.mean = y.mean(0, dtype=np.float64).astype(np.float32)
        self.y = y - self.mean
        self.yt = np.zeros((y.shape[1] + 1, self.width * CHUNK), np.float32)
        self.yt[:-1, : self.n] = -2 * self.y.T
        self.yt[-1, : self.n] = np.einsum("ij,ij->i", self.y, self.y)
        self.yt[-1, self.n :] = np.inf
        self.room = np.empty((STRIP, self.width * CHUNK), np.float32)

    def strips(self, x: np.ndarray, columns: int | None = None):
        """(rows, centred x of those rows, rough distances to the first ``columns`` rows of y)."""
        columns = self.width * CHUNK if columns is None else columns
        for s in range(0, len(x), STRIP):
            part = x[s : s + STRIP] - self.mean
            rough = np.matmul(np.concatenate([part, np.ones((len(part), 1), np.float32)], 1), self.yt[:, :columns], out=self.room[: len(part), :columns])
            yield slice(s, s + len(part)), part, rough

    def exact(self, part: np.ndarray, picked: np.ndarray) -> np.ndarray:
        diff = self.y[picked].astype(np.float64) - part[:, None].astype(np.float64)
        return np.einsum("bcd,bcd->bc", diff, diff)

    def nearest(self, x: np.ndarray, k: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
        """(columns, squared distances) of the k nearest rows of y, nearest first; infinite where there are fewer. With
        ``own``, x is y and a row isn't its own neighbour."""
        cols, dist = [], []
        # the k least values lie in the k chunks of least minima; one more of each, for what rounding may swap
        chunks = min(k + 1, self.width)
        for rows, part, rough in self.strips(x):
            n = len(part)
            if own:
                rough[np.arange(n), np.arange(rows.start, rows.stop)] = np.inf
            low = rough.reshape(n, CHUNK, self.width).min(1)
            at = np.argpartition(low, chunks - 1, axis=1)[:, :chunks]
            inside = (at[:, :, None] + self.width * np.arange(CHUNK)).reshape(n, -1)
            few = np.take_along_axis(rough, inside, 1)
            m = min(k + 1, inside.shape[1])
            part_of = np.argpartition(few, m - 1, axis=1)[:, :m]
            pick = np.take_along_axis(inside, part_of, 1)
            there = np.isfinite(np.take_along_axis(few, part_of, 1))
            pick = np.minimum(pick, self.n - 1)
            d2 = np.where(there, self.exact(part, pick), np.inf)
            order = np.argsort(d2, axis=1)[:, :k]
            cols.append(np.take_along_axis(pick, order, 1))
            dist.append(np.take_along_axis(d2, order, 1))
        return np.concatenate(cols), np.concatenate(dist)


NEAR = "rep bigint, dataset string, n_copies bigint, near array<struct<d2:double,to:bigint>>"


def _nearest(kept: int):
    """Of each row of either block the ``kept`` nearest other rows of the other one; a neighbour of several copies comes so
    many times, NEIGHBOURS times at most."""

    def lists(rep, n_copies, dataset, other, other_copies, cols, d2):
        ok = np.isfinite(d2)
        times = np.where(ok, np.minimum(other_copies[cols], NEIGHBOURS), 0)
        lengths = times.sum(1)
        flat = times.ravel()
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(np.repeat(d2.ravel(), flat)), pa.array(np.repeat(other[cols.ravel()], flat))], ["d2", "to"])
        return pa.table({"rep": rep, "dataset": pa.repeat(dataset, len(rep)), "n_copies": n_copies, "near": pa.ListArray.from_arrays(pa.array(ends), pairs)})

    def run(key, t):
        t = t.sort_by("rep")
        block, rep, n, x = t["block"].to_numpy(), t["rep"].to_numpy(), t["n_copies"].to_numpy(), _matrix(t["v"])
        if key[1].as_py() == key[2].as_py():
            return lists(rep, n, key[0], rep, n, *_Block(x).nearest(x, kept, own=True))
        low, out = block == key[1].as_py(), []
        for a, b in ((low, ~low), (~low, low)):
            if a.any() and b.any():
                out.append(lists(rep[a], n[a], key[0], rep[b], n[b], *_Block(x[b]).nearest(x[a], kept, own=False)))
        return pa.concat_tables(out) if out else lists(rep[:0], n[:0], key[0], rep, n, np.zeros((0, 1), int), np.zeros((0, 1)))

    return run


def _nearest_denser(key, t):
    """Of each asking row the nearest denser row of the block. Density falls with scale, then rep."""
    out = {"rep": [np.zeros(0, np.int64)], "d2": [np.zeros(0)], "to": [np.zeros(0, np.int64)], "target": [np.zeros(0)]}
    t = t.sort_by([("scale", "ascending"), ("rep", "ascending"), ("asks", "ascending")])
    asks = t["asks"].to_numpy(zero_copy_only=False)
    x, rep, scale = _matrix(t["v"]), t["rep"].to_numpy(), t["scale"].to_numpy()
    # a row's twin in the block stands right before it, if it is there: only what is before that is denser
    before = np.cumsum(~asks)[asks]
    a, b = rep[asks], rep[~asks]
    if len(a) and len(b):
        denser = before - ((before > 0) & (b[np.maximum(before - 1, 0)] == a))
        block = _Block(x[~asks])
        for rows, part, rough in block.strips(x[asks], int(denser.max())):
            here = denser[rows]
            if not here.max():
                continue
            least = int(here.min())
            rough[:, least:][np.arange(least, rough.shape[1])[None] >= here[:, None]] = np.inf
            at, ok = rough.argmin(1), here > 0
            out["rep"].append(a[rows][ok])
            out["d2"].append(block.exact(part, at[:, None])[:, 0][ok])
            out["to"].append(b[at][ok])
            out["target"].append(scale[~asks][at][ok])
    return pa.table({c: np.concatenate(v) for c, v in out.items()})


def scales(points: DataFrame, units: float) -> DataFrame:
    """rep, dataset, n_copies, near, closest, scale: the KEPT nearest neighbours (squared distance, rep) of each point, those of them
    that are among its NEIGHBOURS nearest rows, and the distance within which so many other rows lie, copies counted.

    A vector of more copies than that gets the distance of its nearest other vector; a vector in a dataset of too few rows the
    distance of its farthest neighbour. A vector that is alone in its dataset has no scale and no row. ``units``: how many pairs of
    blocks there are.
    """
    keys = ["dataset", "low", "high"]
    met = points.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("dataset", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "n_copies", "v")
    found = met.repartition(heavy_partitions(points.sparkSession, 2 * units), *keys).groupBy(*keys).applyInArrow(_nearest(KEPT), NEAR)
    near = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, KEPT)
    merged = found.groupBy("rep", "dataset", "n_copies").agg(near.alias("near")).where("size(near) > 0")
    third = F.greatest(F.lit(1), F.least(F.lit(NEIGHBOURS + 1) - F.col("n_copies"), F.size("near"))).cast("int")
    closest = F.greatest(F.lit(0), F.least(F.lit(NEIGHBOURS + 1) - F.col("n_copies"), F.size("near"))).cast("int")
    return merged.withColumns({"closest": F.slice(F.col("near.to"), F.lit(1), closest), "scale": F.sqrt(F.element_at("near", third)["d2"])})


def nearest_denser(points: DataFrame, scaled: DataFrame) -> DataFrame:
    """rep, dataset, n_copies, scale, closest, delta, to, target: the nearest denser row within REACH scales, its distance and its scale;
    null where there is none. ``scaled`` is :func:`scales` (cut). Farther rows can be nobody's target: a target is denser."""
    own = scaled.select("rep", "dataset", "n_copies", "scale")
    limit = REACH * F.col("scale")
    within = scaled.select("rep", "scale", F.inline("near")).where(F.sqrt("d2") <= limit)
    target = own.select(F.col("rep").alias("to"), F.col("scale").alias("target"))
    met = within.join(target, "to").where("target < scale OR target = scale AND to < rep").select("rep", "d2", "to", "target")
    known = met.groupBy("rep").agg(F.min(F.struct("d2", "to", "target")).alias("near"))
    full = (F.size("near") >= KEPT) & (F.sqrt(F.element_at("near", -1)["d2"]) <= limit)
    first = scaled.withColumn("asks", full).select("rep", "dataset", "n_copies", "scale", "closest", "asks").join(known, "rep", "left").withColumn("asks", F.col("asks") & F.col("near").isNull())
    first = cut(first, "denser")

    ask = first.where("asks").groupBy("dataset").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts"))
    placed = points.join(first.select("rep", "scale", "asks"), "rep").join(ask, "dataset").withColumn("part", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("parts")).cast("int"))
    met_as = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.col("block").alias("block"), p.alias("part"), F.lit(False).alias("asks")))
    asks_as = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.col("part").alias("part"), F.lit(True).alias("asks")))
    roles = F.when(F.col("asks"), F.concat(met_as, asks_as)).otherwise(met_as)
    keys = ["dataset", "block", "part"]
    sent = placed.select("dataset", F.inline(roles).alias("block", "part", "asks"), "rep", "scale", "v")
    far = sent.repartition(heavy_partitions(points.sparkSession), *keys).groupBy(*keys).applyInArrow(_nearest_denser, "rep bigint, d2 double, to bigint, target double")
    best = far.groupBy("rep").agg(F.min(F.struct("d2", "to", "target")).alias("_far"))
    near = F.coalesce("near", F.when(F.sqrt("_far.d2") <= limit, F.col("_far")))
    return first.join(best, "rep", "left").select("rep", "dataset", "n_copies", "scale", "closest", near.alias("near")).select("rep", "dataset", "n_copies", "scale", "closest", F.sqrt("near.d2").alias("delta"), "near.to", "near.target")


def heavy_edges(edges: DataFrame) -> DataFrame:
    """dataset, a, b, weight: every heavy edge between different rows, in both directions, repeats and all.

    A null, NaN or negative weight is not usable.
    """
    ok = F.col("from_id").isNotNull() & F.col("to_id").isNotNull() & (F.col("from_id") != F.col("to_id")) & (F.col("weight") >= HEAVY_WEIGHT) & ~F.isnan("weight")
    used = edges.select("dataset", "from_id", "to_id", "weight").where(ok)
    return used.select("dataset", F.inline(F.array(F.struct(F.col("from_id").alias("a"), F.col("to_id").alias("b")), F.struct(F.col("to_id").alias("a"), F.col("from_id").alias("b")))), "weight")


def clusters(matrix: DataFrame, edges: DataFrame) -> DataFrame:
    """row_id, dataset, cluster_id, scale: the rows that belong to a cluster, whose id is its smallest row_id.

    ``scale`` is null for an unusable row, which belongs to the cluster that SEVERAL heavy edges tie it to (of two, to the
    one of greater total weight, then of smaller id). All other rows belong to none and are not in the result. An edge may
    come more than once, in either direction; its greatest usable weight holds.

    Which rows count: see :func:`orrery.llm.rows.latest_rows`. Exact copies are one point with a count, so a vector that
    a third of all rows share costs no more than one row. Empty tables give an empty result.
    """
    rows = cut(latest_rows(matrix), "cluster-rows")
    doubles = cut(doubles_of(rows), "cluster-copies")
    # how many blocks a dataset has follows from its rows; a small table
    sizes = cut(rows.where("usable").groupBy("dataset").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")), "cluster-sizes")
    units = sizes.agg(F.coalesce(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2), F.lit(0))).first()[0]
    points = cut(points_of(rows, doubles).join(sizes, "dataset").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")), "cluster-points")
    denser = nearest_denser(points, cut(scales(points, units), "scales"))
    pointed = denser.select("rep", "dataset", "n_copies", "scale", "closest", F.when(F.col("delta") <= REACH * F.col("target"), F.col("to")).alias("to"), F.coalesce(F.try_divide("delta", "scale"), F.lit(float("inf"))).alias("apart"))
    pointed = cut(pointed, "pointers")
    linked = cut(pointed.drop("to").join(follow(pointed, "rep", "to", "peak"), "rep"), "linked")

    own = F.col("n_copies") * F.least(F.lit(NEIGHBOURS), F.col("n_copies") - 1)
    trees = linked.groupBy("peak").agg(
        F.sum("n_copies").alias("size"), F.min("rep").alias("cluster_id"), F.max(F.when(F.col("rep") == F.col("peak"), F.col("apart"))).alias("apart"),
        F.sum(own).alias("copied"), F.sum(own + F.col("n_copies") * F.size("closest")).alias("nearest"),
    )
    # how many of its rows' nearest rows are in the same tree
    met = linked.select("peak", "n_copies", F.explode("closest").alias("to")).join(linked.select(F.col("rep").alias("to"), F.col("peak").alias("_other")), "to")
    inside = met.where("peak = _other").groupBy("peak").agg(F.sum("n_copies").alias("met"))
    closed = F.coalesce("met", F.lit(0)) + F.col("copied") >= CLOSED * F.col("nearest")
    trees = trees.where((F.col("size") >= MIN_ROWS) & (F.col("apart") >= APART_WITH_EDGES)).join(inside, "peak", "left").where(closed)
    trees = cut(trees.select("peak", "size", "cluster_id", "apart"), "trees")
    every = cut(linked.drop("apart", "closest").join(trees, "peak").select("rep", "dataset", "peak", "cluster_id", "scale", "size", "apart"), "in-trees")
    owned = every.unionByName(doubles.where("row_id <> rep").join(every, "rep").select(F.col("row_id").alias("rep"), "dataset", "peak", "cluster_id", "scale", "size", "apart")).withColumnRenamed("rep", "row_id")
    heavy = heavy_edges(edges)
    # edges are counted only in the trees that need them
    near = cut(owned.where(F.col("apart") < APART).select("row_id", "peak", "size"), "doubtful")
    inside = heavy.where("a < b").join(near.select(F.col("row_id").alias("a"), "peak", "size"), "a").join(near.select(F.col("row_id").alias("b"), F.col("peak").alias("pb")), "b").where("peak = pb")
    tied_trees = inside.groupBy("peak", "size").agg(F.count_distinct("a", "b").alias("ties")).where("ties >= size - 1").select("peak")
    held = owned.join(cut(tied_trees, "tied-trees").withColumn("_tied", F.lit(True)), "peak", "left").where((F.col("apart") >= APART) | F.col("_tied"))
    members = held.select("row_id", "dataset", "cluster_id", "scale")
    # copies enough for a cluster lie nearer to one another than to all else, wherever they lie
    many = doubles.where(F.col("n_copies") >= MIN_ROWS)
    alone = many.join(members.select(F.col("row_id").alias("rep")), "rep", "left_anti")
    alone = alone.join(rows.select("row_id", "dataset"), "row_id").select("row_id", "dataset", F.col("rep").alias("cluster_id"), F.lit(0.0).alias("scale"))
    members = cut(members.unionByName(alone), "members")

    loose = cut(rows.where("NOT usable").select(F.col("row_id").alias("a"), "dataset"), "loose")
    tied = heavy.join(loose, ["a", "dataset"]).join(members.select(F.col("row_id").alias("b"), "dataset", "cluster_id"), ["b", "dataset"])
    edge = tied.groupBy("a", "dataset", "cluster_id", "b").agg(F.max("weight").alias("weight"))
    votes = edge.groupBy("a", "dataset", "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).where(F.col("n") >= SEVERAL)
    best = votes.groupBy("a", "dataset").agg(F.max(F.struct("w", (-F.col("cluster_id")).alias("c"))).alias("best"))
    joined = cut(best.select(F.col("a").alias("row_id"), "dataset", (-F.col("best.c")).alias("cluster_id"), F.lit(None).cast("double").alias("scale")), "tied-rows")
    # an unusable row may have the smallest id of all
    renamed = joined.groupBy("cluster_id").agg(F.min("row_id").alias("_least")).where("_least < cluster_id")
    return members.unionByName(joined).join(renamed, "cluster_id", "left").select("row_id", "dataset", F.coalesce("_least", "cluster_id").alias("cluster_id"), "scale")


def described(members: DataFrame, typical: int = 3) -> DataFrame:
    """cluster_id, dataset, size, typical_row_ids: each cluster with its most typical rows, those of greatest density."""
    w = Window.partitionBy("cluster_id").orderBy(F.col("scale").asc_nulls_last(), "row_id")
    top = members.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= typical).groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "row_id"))), lambda s: s["row_id"]).alias("typical_row_ids"))
    sizes = members.groupBy("cluster_id").agg(F.first("dataset").alias("dataset"), F.count(F.lit(1)).alias("size"))
    return sizes.join(top, "cluster_id")


def cluster_pairs(members: DataFrame) -> DataFrame:
    """row_a, row_b: the smallest row_id of each cluster with every other row_id of it."""
    return members.where("row_id <> cluster_id").select(F.col("cluster_id").alias("row_a"), F.col("row_id").alias("row_b"))
