"""Nearest neighbours as a long table (src_id, nbr_id, rank from 1, distance): exact by blocks, approximate by lists."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.preprocess import rows_for
from orrery.plans.cut import cut
from orrery.plans.sizing import cores, heavy_partitions

METRICS = ("euclidean", "cosine", "correlation", "inner_product")
#: Rows of the reference that one task holds.
REFERENCE_BLOCK = 16_384
#: Queries of a block at most; smaller when there are few, so that all cores have work.
QUERY_BLOCK = 8_192
#: n_reference * n_query * dims up to which an exact search is chosen although a target_recall was named.
EXACT_BUDGET = 5e12
KNN = "src_id bigint, nbr_id bigint, distance double"


@dataclass(frozen=True)
class KnnPlan:
    """How a search is run and why."""

    strategy: str
    n_reference: int
    n_query: int
    k: int
    n_lists: int = 0
    n_probe: int = 0


def plan_knn(n_reference: int, n_query: int, dims: int, k: int, target_recall: float = 0.99) -> KnnPlan:
    """For callers who accept a recall below 1: exact within the budget of products, else inverted lists. ``n_probe`` is where
    the search starts; it grows until the recall holds on a sample."""
    if not 1 <= k:
        raise ValueError("k must be at least 1")
    if n_reference * n_query * dims <= EXACT_BUDGET:
        return KnnPlan("exact", n_reference, n_query, k)
    lists = max(16, int(4 * math.sqrt(n_reference)))
    share = 0.02 if target_recall <= 0.9 else 0.05 if target_recall <= 0.95 else 0.1
    return KnnPlan("lists", n_reference, n_query, k, lists, max(4, math.ceil(lists * share)))


def _matrix(column) -> np.ndarray:
    a = column.combine_chunks()
    return np.asarray(a.flatten(), np.float64).reshape(len(a), -1)


def _block_top(k: int, metric: str, exclude_self: bool, basis: np.ndarray | None = None, shortlist: int = 0):
    """The k nearest rows of a block. A rough product chooses a shortlist, which is ranked by exact distances; with ``basis``
    (columns x few) the rough product is that of the projected rows."""

    def run(key, queries, reference):
        out = [], [], []
        if queries.num_rows and reference.num_rows:
            q, x = _matrix(queries["features"]), _matrix(reference["features"])
            qid, xid = queries["id"].to_numpy(), reference["id"].to_numpy()
            order = np.argsort(xid)
            x, xid = x[order], xid[order]
            mean = x.mean(0)
            seen = (lambda a: a) if basis is None else lambda a: a @ basis
            c = seen(x - (0 if metric == "inner_product" else mean))
            c2 = (c * c).sum(1)
            ct = np.ascontiguousarray(c.T)
            kept = min(len(xid), max(shortlist, k + 1 + 16))
            strip = max(16, 4_000_000 // len(xid))
            for s in range(0, len(q), strip):
                p, pid = q[s : s + strip], qid[s : s + strip]
                rough = -(seen(p) @ ct) if metric == "inner_product" else c2[None] - 2 * (seen(p - mean) @ ct)
                if exclude_self:
                    rough[pid[:, None] == xid[None]] = np.inf
                near = np.argpartition(rough, kept - 1, axis=1)[:, :kept] if kept < len(xid) else np.tile(np.arange(len(xid)), (len(p), 1))
                # the shortlist is ranked by sums of squared differences, which keep ties as ties
                if metric == "inner_product":
                    d = -np.einsum("bcd,bd->bc", x[near], p)
                else:
                    diff = x[near] - p[:, None, :]
                    d = np.einsum("bcd,bcd->bc", diff, diff)
                    d = 0.5 * d if metric in ("cosine", "correlation") else np.sqrt(d)
                if exclude_self:
                    d[xid[near] == pid[:, None]] = np.inf
                rank = np.lexsort((xid[near], d), axis=1)[:, :k]
                near, d = np.take_along_axis(near, rank, 1), np.take_along_axis(d, rank, 1)
                ok = np.isfinite(d)
                out[0].append(np.broadcast_to(pid[:, None], near.shape)[ok])
                out[1].append(xid[near][ok])
                out[2].append(d[ok])
        cat = lambda a, t: np.concatenate(a) if a else np.zeros(0, t)
        return pa.table({"src_id": cat(out[0], np.int64), "nbr_id": cat(out[1], np.int64), "distance": cat(out[2], np.float64)})

    return run


def exact_knn(reference: DataFrame, k: int, metric: str = "euclidean", query: DataFrame | None = None) -> DataFrame:
    """src_id, nbr_id, rank, distance: the k nearest reference rows of each query, by distance, then id.

    Without ``query`` every row looks among the others (never itself); with it nothing is excluded. Cosine and correlation
    distances are half the squared distance of unit rows, so all-zero rows stay defined; inner_product ranks by -dot.

    Queries and reference meet in blocks on (query block, reference block): no side is ever broadcast or collected, and
    only k rows per query and reference block are shuffled.
    """
    self_search = query is None
    ref = cut(rows_for(reference.select("id", "features"), metric), "knn-reference")
    qry = ref if self_search else cut(rows_for(query.select("id", "features"), metric), "knn-query")
    n_ref, n_qry = ref.count(), qry.count()
    if not 1 <= k <= max(1, n_ref - self_search):
        raise ValueError(f"k must be between 1 and {n_ref - self_search}")
    return _by_blocks(ref, qry, n_ref, n_qry, k, metric, self_search)


#: Columns of the projection, and rows of the shortlist up to 15, up to 50 and beyond that many neighbours.
PROJECTED_COLUMNS, SHORTLISTS = 128, (288, 384, 512)


def projected_knn(reference: DataFrame, k: int, metric: str = "euclidean", query: DataFrame | None = None, columns: int = PROJECTED_COLUMNS, shortlist: int | None = None, seed: int = 4, target_recall: float = 0.9) -> DataFrame:
    """As :func:`exact_knn` for wide rows: in each pair of blocks a seeded Gaussian projection to ``columns`` columns chooses a
    shortlist for every query, which is ranked by exact distances. Distances are exact, a neighbour may be missed.

    The shortlist starts at ``shortlist`` rows (SHORTLISTS) and doubles until a bounded sample of queries (PILOT_ROWS) finds
    ``target_recall`` of its true neighbours, two standard errors below the mean. At the size of a block it is an exact search.
    """
    self_search = query is None
    ref = cut(rows_for(reference.select("id", "features"), metric), "knn-reference")
    qry = ref if self_search else cut(rows_for(query.select("id", "features"), metric), "knn-query")
    n_ref, n_qry = ref.count(), qry.count()
    if not 1 <= k <= max(1, n_ref - self_search):
        raise ValueError(f"k must be between 1 and {n_ref - self_search}")
    first = ref.select(F.size("features").alias("p")).first()
    basis = None
    if first is not None and first.p > columns:
        basis = np.random.default_rng(seed).standard_normal((first.p, columns)) / math.sqrt(columns)
    size = shortlist or (SHORTLISTS[0] if k <= 15 else SHORTLISTS[1] if k <= 50 else SHORTLISTS[2])
    if basis is not None:
        pilot = cut(qry.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(PILOT_ROWS), "projected-pilot")
        n = pilot.count()
        truth = cut(_by_blocks(ref, pilot, n_ref, n, k, metric, self_search), "projected-truth")
        while size < REFERENCE_BLOCK:
            found = _by_blocks(ref, pilot, n_ref, n, k, metric, self_search, basis, size)
            hits = truth.join(found.select("src_id", "nbr_id", F.lit(1).alias("_hit")), ["src_id", "nbr_id"], "left").groupBy("src_id").agg((F.count("_hit") / F.count(F.lit(1))).alias("r"))
            r = hits.agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"), F.count(F.lit(1)).alias("n")).first()
            if not r.n or r.mean - 2 * r.sd / math.sqrt(r.n) >= target_recall:
                break
            size *= 2
    return _by_blocks(ref, qry, n_ref, n_qry, k, metric, self_search, basis, size)


def _by_blocks(ref: DataFrame, qry: DataFrame, n_ref: int, n_qry: int, k: int, metric: str, exclude_self: bool, basis: np.ndarray | None = None, shortlist: int = 0) -> DataFrame:
    spark = ref.sparkSession
    r_blocks = max(1, math.ceil(n_ref / REFERENCE_BLOCK))
    q_blocks = max(1, math.ceil(n_qry / QUERY_BLOCK), min(math.ceil(n_qry / 128), math.ceil(cores(spark) / r_blocks)))
    n = heavy_partitions(spark, 4 * r_blocks * q_blocks)
    keys = ["q", "r"]
    left = qry.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(r_blocks - 1)))).repartition(n, *keys)
    right = ref.withColumn("r", F.pmod(F.xxhash64("id"), F.lit(r_blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))).repartition(n, *keys)
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_block_top(k, metric, exclude_self, basis, shortlist), KNN)
    return ranked(met, k)


def ranked(knn: DataFrame, k: int | None = None) -> DataFrame:
    """Neighbours numbered from 1 by (distance, id), the first k of them."""
    nth = F.row_number().over(Window.partitionBy("src_id").orderBy("distance", "nbr_id"))
    out = knn.select("src_id", "nbr_id", "distance").withColumn("rank", nth.cast("bigint"))
    return (out.where(F.col("rank") <= k) if k else out).select("src_id", "nbr_id", "rank", "distance")


def _lists(spark, sample: np.ndarray, n_lists: int, seed: int) -> np.ndarray:
    """Centroids of the lists, by a few rounds of k-means on a bounded sample."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(n_lists, len(sample)), replace=False)].copy()
    for _ in range(8):
        c2 = (centres * centres).sum(1)
        near = np.concatenate([(c2[None] - 2 * sample[s : s + 1024] @ centres.T).argmin(1) for s in range(0, len(sample), 1024)])
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, sample)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


#: Rows at most on which the lists' centroids are fitted; every row is indexed.
LIST_SAMPLE = 50_000
#: Queries at most on which the recall of the lists is measured.
PILOT_ROWS = 1_000


def _probes_needed(target: float, least: int, ref: DataFrame, qry: DataFrame, placed: DataFrame, centres: np.ndarray, k: int, metric: str, exclude_self: bool, seed: int) -> int:
    """The lists that a query must look into (at least ``least``) so that ``target`` of the true neighbours are found.

    A true neighbour is found exactly if its list is looked into. The neighbours of a bounded sample of queries are searched
    exactly, and the place of each one's list tells the recall of every number of lists at once; two standard errors below
    the mean must reach the target. All lists are an exact search, so there always is an answer.
    """
    pilot = cut(qry.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(PILOT_ROWS), "ivf-pilot")
    rows = pilot.select("id", "features").collect()
    truth = _by_blocks(ref, pilot, ref.count(), len(rows), k, metric, exclude_self)
    pairs = truth.join(placed.select(F.col("id").alias("nbr_id"), "r"), "nbr_id").select("src_id", "r").collect()
    if not pairs:
        return least
    nth = {r.id: i for i, r in enumerate(rows)}
    x = np.array([r.features for r in rows], float)
    src, own = np.array([nth[p.src_id] for p in pairs]), np.array([p.r for p in pairs])
    need, c2 = np.empty(len(pairs), int), (centres * centres).sum(1)
    for s in range(0, len(pairs), 1024):
        i, r = src[s : s + 1024], own[s : s + 1024]
        d = c2[None] - 2 * x[i] @ centres.T
        need[s : s + 1024] = (d <= d[np.arange(len(r)), r][:, None]).sum(1)
    wanted = np.bincount(src, minlength=len(x))

    def holds(count):
        share = np.bincount(src, need <= count, len(x))[wanted > 0] / wanted[wanted > 0]
        return share.mean() - 2 * share.std() / math.sqrt(len(share)) >= target

    low, high = min(least, len(centres)), len(centres)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if holds(mid) else (mid + 1, high)
    return high


def ivf_knn(reference: DataFrame, k: int, metric: str = "euclidean", query: DataFrame | None = None, n_lists: int = 64, n_probe: int = 8, seed: int = 4, target_recall: float | None = None) -> DataFrame:
    """As :func:`exact_knn`, but a query looks only into the ``n_probe`` lists nearest to it, or into as many more as a
    sample of the queries needs for ``target_recall``.

    Centroids are fitted on a bounded sample (LIST_SAMPLE rows by hash order); each reference row goes to one list. Queries
    meet the lists by an equi-join on the list's number and block, so a long list is cut into blocks like any other.
    """
    self_search = query is None
    ref = cut(rows_for(reference.select("id", "features"), metric), "ivf-reference")
    qry = ref if self_search else cut(rows_for(query.select("id", "features"), metric), "ivf-query")
    spark = reference.sparkSession
    sample = np.array([r.features for r in ref.orderBy(F.xxhash64("id", F.lit(seed)), "id").select("features").limit(LIST_SAMPLE).collect()], float)
    centres = _lists(spark, sample, n_lists, seed)
    shared = spark.sparkContext.broadcast(centres)  # at most LIST_SAMPLE x dims

    def nearest_lists(count):
        def run(batches):
            c = shared.value
            for b in batches:
                x = _matrix(pa.chunked_array([b["features"]]))
                d = (c * c).sum(1)[None] - 2 * x @ c.T
                take = min(count, len(c))
                near = np.argpartition(d, take - 1, axis=1)[:, :take]
                again = pa.array(np.repeat(np.arange(b.num_rows), take))
                yield pa.RecordBatch.from_arrays([b["id"].take(again), b["features"].take(again), pa.array(near.ravel().astype(np.int32))], ["id", "features", "r"])

        return run

    placed = "id bigint, features array<double>, r int"
    ref_in = cut(ref.mapInArrow(nearest_lists(1), placed), "ivf-lists")
    if target_recall is not None:
        n_probe = _probes_needed(target_recall, n_probe, ref, qry, ref_in, centres, k, metric, self_search, seed)
    sizes = ref_in.groupBy("r").agg(F.ceil(F.count(F.lit(1)) / REFERENCE_BLOCK).cast("int").alias("blocks"))
    ref_in = ref_in.join(sizes, "r").withColumn("q", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    asked = cut(qry.mapInArrow(nearest_lists(n_probe), placed), "ivf-queries")
    parts = asked.groupBy("r").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("parts"))
    qry_in = asked.join(sizes, "r").join(parts, "r").withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "parts")
    ref_in = ref_in.join(parts, "r").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    n = heavy_partitions(spark, 4 * len(centres))
    keys = ["q", "r", "part"]
    met = qry_in.repartition(n, *keys).groupBy(*keys).cogroup(ref_in.repartition(n, *keys).groupBy(*keys)).applyInArrow(_block_top(k, metric, self_search), KNN)
    return ranked(met, k)


def precompute_knn(df: DataFrame, k: int = 30, metric: str = "euclidean", target_recall: float | None = None, seed: int = 4) -> DataFrame:
    """Self-search, exact at every size. Only a caller who names a ``target_recall`` may get the lists that
    :func:`plan_knn` chooses for large tables, with as many probes as that recall needs on a sample."""
    if target_recall is None:
        return exact_knn(df, k, metric)
    first = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("p")).first()
    plan = plan_knn(first.n, first.n, first.p or 1, k, target_recall)
    return exact_knn(df, k, metric) if plan.strategy == "exact" else ivf_knn(df, k, metric, None, plan.n_lists, plan.n_probe, seed, target_recall)


def precompute_query_knn(reference: DataFrame, query: DataFrame, k: int = 30, metric: str = "euclidean", target_recall: float | None = None, seed: int = 4) -> DataFrame:
    """Search of ``query`` rows among ``reference`` rows, exact or not as in :func:`precompute_knn`; an equal id is not excluded."""
    a = reference.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("p"), F.min(F.size("features")).alias("l")).first()
    b = query.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("p"), F.min(F.size("features")).alias("l")).first()
    if b.n and {a.p, a.l} != {b.p, b.l}:
        raise ValueError("reference and query must have the same number of columns")
    if target_recall is None:
        return exact_knn(reference, k, metric, query)
    plan = plan_knn(a.n, b.n, a.p or 1, k, target_recall)
    return exact_knn(reference, k, metric, query) if plan.strategy == "exact" else ivf_knn(reference, k, metric, query, plan.n_lists, plan.n_probe, seed, target_recall)


# --- supplied neighbour tables -----------------------------------------------------------------------------------

EPS = 1.4901161193847656e-08  # fixed value: square root of the double's machine epsilon


def strip_self(knn: DataFrame) -> DataFrame:
    """Neighbours without the row itself, ranked anew.

    If the first neighbour is the row itself at distance <= EPS in every row, the first column goes. Else the first self
    match of each row goes; but if any row lacks itself, all are kept as they are.
    """
    marked = knn.withColumn("_self", (F.col("nbr_id") == F.col("src_id")).cast("int"))
    w = Window.partitionBy("src_id").orderBy("rank")
    marked = marked.withColumn("_nth", F.sum("_self").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = marked.groupBy("src_id").agg(F.max("_self").alias("has"), F.max(((F.col("_self") == 1) & (F.col("rank") == 1) & (F.col("distance") <= EPS)).cast("int")).alias("led"))
    told = rows.agg(F.min("has").alias("_has"), F.min("led").alias("_led"))
    gone = F.when(F.col("_led") == 1, F.col("rank") == 1).when(F.col("_has") == 1, (F.col("_self") == 1) & (F.col("_nth") == 1)).otherwise(F.lit(False))
    left = marked.crossJoin(F.broadcast(told)).where(~gone)
    return left.withColumn("rank", F.row_number().over(w).cast("bigint")).select("src_id", "nbr_id", "rank", "distance")


def trimmed(knn: DataFrame, k: int) -> DataFrame:
    return knn.where(F.col("rank") <= k)


def knn_problems(knn: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: how many neighbours are unknown ids, bad distances (null, NaN, infinite, negative), and ragged rows."""
    d = F.col("distance")
    bad = d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")) | (d < 0)
    unknown = knn.join(ids.select(F.col("id").alias("nbr_id")), "nbr_id", "left_anti").agg(F.count(F.lit(1)).alias("unknown_neighbours"))
    sizes = knn.groupBy("src_id").agg(F.count(F.lit(1)).alias("n"))
    ragged = sizes.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("k"), F.coalesce((F.max("n") != F.min("n")).cast("int"), F.lit(0)).cast("bigint").alias("ragged"))
    return unknown.crossJoin(knn.agg(F.count(F.when(bad, 1)).alias("bad_distances"))).crossJoin(ragged)


def supplied_knn(knn: DataFrame, ids: DataFrame, k: int | None = None) -> DataFrame:
    """A checked neighbour table of someone else's search: self removed, first k kept. ValueError if it is unusable."""
    p = knn_problems(knn, ids).first()
    if p.unknown_neighbours or p.bad_distances or p.ragged:
        raise ValueError(f"neighbour table: {p.asDict()}")
    out = strip_self(knn)
    return trimmed(out, k) if k else out


def knn_recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: mean, median and least share of the true k neighbours found, per row."""
    a, b = found.where(F.col("rank") <= k).select("src_id", "nbr_id"), truth.where(F.col("rank") <= k).select("src_id", "nbr_id")
    hits = b.join(a, ["src_id", "nbr_id"]).groupBy("src_id").agg(F.count(F.lit(1)).alias("hits"))
    per = b.select("src_id").distinct().join(hits, "src_id", "left").select((F.coalesce("hits", F.lit(0)) / F.lit(float(k))).alias("r"))
    return per.agg(F.round(F.avg("r"), 6).alias("mean_recall"), F.round(F.median("r"), 6).alias("median_recall"), F.round(F.min("r"), 6).alias("min_recall"))
