"""Quality of a layout against its features: rank, label, batch and distance metrics.

Tables: features (id, features), layout (id, features: the low-dimensional coordinates), labels (id, label), neighbour
tables (src_id, nbr_id, rank, distance).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.plans.cut import cut

#: Rows for which all ranks are computed; a larger table has to be sampled first (local_sample).
RANK_ROWS = 5000
#: Pairs of the global distance metrics; above that a seeded sample of pairs.
GLOBAL_PAIRS = 250_000


def local_sample(df: DataFrame, rows: int, max_k: int, seed: int = 4) -> DataFrame:
    """The rows of least seeded hash: ``rows``, but at least floor((3 max_k + 1) / 2) + 1."""
    n = max(rows, (3 * max_k + 1) // 2 + 1)
    return df.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def _collected(df: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    rows = df.select("id", "features").orderBy("id").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: sample first")
    return np.array([r.id for r in rows], np.int64), np.array([r.features for r in rows], float)


def rank_metrics(high: DataFrame, low: DataFrame, ks: tuple[int, ...] = (15,)) -> DataFrame:
    """k, trustworthiness, continuity, knn_preservation, mean_neighbor_rank_error for each k.

    Exact ranks by (distance, id) in both spaces, of at most RANK_ROWS rows (that bounded sample is broadcast; each task
    ranks its rows against it). Both tables must hold the same ids. Trustworthiness and continuity are
    1 - 2 / (n k (2n - 3k - 1)) times the sum of max(0, rank - k), within 0..1; null if the factor is undefined.
    """
    spark = high.sparkSession
    ids, x = _collected(high, RANK_ROWS)
    ids_low, y = _collected(low, RANK_ROWS)
    if not np.array_equal(ids, ids_low):
        raise ValueError("features and layout must have the same ids")
    n = len(ids)
    shared = spark.sparkContext.broadcast((x, y))
    ks = tuple(int(k) for k in ks)

    def ranks(a: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty((len(at), n), np.int64)
        for r, i in enumerate(at):
            d = np.sqrt(((a - a[i]) ** 2).sum(1))
            d[i] = np.inf
            out[r, np.argsort(d, kind="stable")] = np.arange(1, n + 1)
        return out

    def run(batches):
        x, y = shared.value
        for b in batches:
            at = b["at"].to_numpy()
            h, low_rank = ranks(x, at), ranks(y, at)
            other = np.arange(n)[None] != at[:, None]
            cols = []
            for k in ks:
                in_high, in_low = (h <= k) & other, (low_rank <= k) & other
                cols.append([np.where(in_low, np.maximum(0, h - k), 0).sum(1), np.where(in_high, np.maximum(0, low_rank - k), 0).sum(1), (in_high & in_low).sum(1), np.where(in_low, np.abs(h - low_rank), 0).sum(1)])
            flat = [np.concatenate([c[j] for c in cols]) for j in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ks, np.int64), len(at))), *map(pa.array, flat)], ["k", "t", "c", "s", "e"])

    parts = max(1, min(spark.sparkContext.defaultParallelism * 2, n))
    per = spark.range(0, n, 1, parts).withColumnRenamed("id", "at").mapInArrow(run, "k bigint, t bigint, c bigint, s bigint, e bigint")
    sums = per.groupBy("k").agg(*[F.sum(c).alias(c) for c in "tcse"])
    k = F.col("k")
    factor = F.lit(2.0) / (F.lit(float(n)) * k * (2 * n - 3 * k - 1))
    score = lambda c: F.when(2 * n - 3 * k - 1 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - factor * F.col(c))))
    return sums.select("k", F.round(score("t"), 6).alias("trustworthiness"), F.round(score("c"), 6).alias("continuity"), F.round(F.col("s") / (k * float(n)), 6).alias("knn_preservation"), F.round(F.col("e") / (k * float(n)), 6).alias("mean_neighbor_rank_error"))


def preservation(high_knn: DataFrame, low_knn: DataFrame, k: int) -> DataFrame:
    """One row: share of the k neighbours that both tables have. An equi-join; any number of rows."""
    a, b = (t.where(F.col("rank") <= k).select("src_id", "nbr_id") for t in (high_knn, low_knn))
    total = a.agg((F.countDistinct("src_id") * k).alias("total"))
    return a.join(b, ["src_id", "nbr_id"]).agg(F.count(F.lit(1)).alias("hits")).crossJoin(total).select(F.round(F.col("hits") / F.col("total"), 6).alias("knn_preservation"))


def structure_score(high_knn: DataFrame, low_knn: DataFrame, k: int) -> DataFrame:
    """One row: mean of preservation, trustworthiness and continuity from ranks that end at k + 1 (neighbour tables only)."""
    a = high_knn.where(F.col("rank") <= k).select("src_id", "nbr_id", F.col("rank").alias("h"))
    b = low_knn.where(F.col("rank") <= k).select("src_id", "nbr_id", F.col("rank").alias("l"))
    both = a.join(b, ["src_id", "nbr_id"], "full_outer")
    n = a.agg(F.countDistinct("src_id").alias("n"))
    s = both.agg(F.count(F.when(F.col("h").isNotNull() & F.col("l").isNotNull(), 1)).alias("shared"), F.count(F.when(F.col("h").isNull(), 1)).alias("foreign"), F.count(F.when(F.col("l").isNull(), 1)).alias("lost"))
    part = lambda c: 1 - F.col(c) / (F.col("n") * float(k))
    p, t, c = F.col("shared") / (F.col("n") * float(k)), part("foreign"), part("lost")
    return s.crossJoin(n).select(F.round((p + t + c) / 3, 6).alias("structure_score"))


def label_votes(knn: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """src_id, label, predicted: the majority label of each labelled row's k neighbours, at a tie the lowest; unlabelled neighbours don't vote."""
    near = knn.where(F.col("rank") <= k).join(labels.where("label IS NOT NULL").select(F.col("id").alias("nbr_id"), F.col("label").alias("vote")), "nbr_id")
    votes = near.groupBy("src_id", "vote").agg(F.count(F.lit(1)).alias("n"))
    # greatest count, then least label: one aggregate, no sort
    best = votes.groupBy("src_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "vote"))["vote"].alias("predicted"))
    return labels.where("label IS NOT NULL").select(F.col("id").alias("src_id"), "label").join(best, "src_id", "left")


def label_accuracy(votes: DataFrame) -> DataFrame:
    """label, n, correct, recall of each class."""
    hit = F.count(F.when(F.col("label") == F.col("predicted"), 1))
    return votes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), hit.alias("correct"), F.round(hit / F.count(F.lit(1)), 6).alias("recall"))


def rare_recall(per_class: DataFrame) -> DataFrame:
    """One row: mean recall of all classes and of the rare ones (count at most the 25 % quantile, type 1)."""
    limit = per_class.agg(F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY n)").alias("_q"))
    return per_class.crossJoin(F.broadcast(limit)).agg(F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.avg(F.when(F.col("n") <= F.col("_q"), F.col("recall"))), 6).alias("rare_recall"), F.count(F.when(F.col("n") <= F.col("_q"), 1)).alias("n_rare"))


def batch_mixing(knn: DataFrame, batches: DataFrame, k: int) -> DataFrame:
    """One row: mean entropy of the batches among each row's k neighbours, and that over ln(number of batches)."""
    near = knn.where(F.col("rank") <= k).join(batches.select(F.col("id").alias("nbr_id"), "batch"), "nbr_id").where("batch IS NOT NULL")
    c = near.groupBy("src_id", "batch").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.col("t")
    total = near.groupBy("src_id").agg(F.count(F.lit(1)).alias("t"))
    per = c.join(total, "src_id").groupBy("src_id").agg(F.sum(-share * F.log(share)).alias("h"))
    b = batches.agg(F.countDistinct("batch").alias("b"))
    return per.agg(F.avg("h").alias("h")).crossJoin(b).select(F.round("h", 6).alias("batch_entropy"), F.round(F.when(F.col("b") > 1, F.col("h") / F.log("b")), 6).alias("batch_mixing"))


def ari_nmi(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: adjusted Rand index and NMI (over the root of both entropies) of two partitions (id, community)."""
    t = a.select("id", F.col("community").alias("x")).join(b.select("id", F.col("community").alias("y")), "id").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    rows, cols = t.groupBy("x").agg(F.sum("n").alias("a")), t.groupBy("y").agg(F.sum("n").alias("b"))
    total = t.agg(F.sum("n").alias("t"), F.sum(pairs("n")).alias("sij"))
    si, sj = rows.agg(F.sum(pairs("a")).alias("si"), F.sum(F.col("a") * F.log("a")).alias("ha")), cols.agg(F.sum(pairs("b")).alias("sj"), F.sum(F.col("b") * F.log("b")).alias("hb"))
    mi = t.join(rows, "x").join(cols, "y").crossJoin(F.broadcast(total)).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"))
    one = total.crossJoin(si).crossJoin(sj).crossJoin(mi)
    expected = F.col("si") * F.col("sj") / (F.col("t") * (F.col("t") - 1) / 2)
    top = (F.col("si") + F.col("sj")) / 2
    hx, hy = F.log("t") - F.col("ha") / F.col("t"), F.log("t") - F.col("hb") / F.col("t")
    return one.select(F.round(F.when(top == expected, 1.0).otherwise((F.col("sij") - expected) / (top - expected)), 6).alias("ari"), F.round(F.when(hx * hy > 0, F.col("mi") / F.sqrt(hx * hy)).otherwise(0.0), 6).alias("nmi"))


def silhouette(layout: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: mean of (b - a) / max(a, b); a row alone in its class has a = 0; null with fewer than 2 classes.

    All distances of at most RANK_ROWS rows (bounded, broadcast); only one sum per row and class leaves a task.
    """
    spark = layout.sparkSession
    both = layout.join(labels.where("label IS NOT NULL").select("id", "label"), "id").select("id", "features", "label").orderBy("id").limit(RANK_ROWS + 1).collect()
    if len(both) > RANK_ROWS:
        raise ValueError(f"more than {RANK_ROWS} rows: sample first")
    names = sorted({r.label for r in both})
    code = np.array([names.index(r.label) for r in both], np.int64)
    y = np.array([r.features for r in both], float)
    counts = np.bincount(code, minlength=len(names))
    shared = spark.sparkContext.broadcast((y, code, counts))

    def run(batches):
        y, code, counts = shared.value
        for b in batches:
            out = []
            for i in b["at"].to_numpy():
                d = np.sqrt(((y - y[i]) ** 2).sum(1))
                sums = np.bincount(code, weights=d, minlength=len(counts))
                own = code[i]
                a = sums[own] / (counts[own] - 1) if counts[own] > 1 else 0.0
                rest = np.delete(sums / counts, own)
                low = rest.min() if len(rest) else 0.0
                out.append((low - a) / max(a, low) if max(a, low) > 0 else 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], ["s"])

    per = spark.range(0, len(both), 1, max(1, min(2 * spark.sparkContext.defaultParallelism, len(both) or 1))).withColumnRenamed("id", "at").mapInArrow(run, "s double")
    return per.agg(F.round(F.when(F.lit(len(names) >= 2), F.avg("s")), 6).alias("silhouette"))


def sampled_pairs(ids: DataFrame, limit: int = GLOBAL_PAIRS, seed: int = 4) -> DataFrame:
    """a < b: all pairs of ids, or about ``limit`` seeded ones if there are more.

    Pairs are numbers of a range that are taken apart again, so nothing is joined with itself.
    """
    spark = ids.sparkSession
    # numbers rows within range partitions first, so that no task sorts all ids
    placed = cut(ids.select("id").repartitionByRange("id").withColumn("_p", F.spark_partition_id()), "numbered").withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy("id")))
    offsets = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).withColumn("_o", F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c"))
    numbered = placed.join(offsets.select("_p", "_o"), "_p").select("id", (F.col("_i") + F.col("_o") - 1).cast("bigint").alias("at"))
    n = ids.count()
    total = n * (n - 1) // 2
    t = F.col("t").cast("double")
    if total <= limit:
        base = spark.range(0, total).withColumnRenamed("id", "t")
        j = F.floor((1 + F.sqrt(1 + 8 * t)) / 2)
        j = F.when(j * (j - 1) / 2 > F.col("t"), j - 1).when((j + 1) * j / 2 <= F.col("t"), j + 1).otherwise(j).cast("bigint")
        at = base.select((F.col("t") - j * (j - 1) / 2).cast("bigint").alias("i"), j.alias("j"))
    else:
        base = spark.range(0, limit).withColumnRenamed("id", "t")
        one, two = F.pmod(F.xxhash64("t", F.lit(seed)), F.lit(n)), F.pmod(F.xxhash64("t", F.lit(seed + 1)), F.lit(n))
        at = base.select(F.least(one, two).alias("i"), F.greatest(one, two).alias("j")).where("i < j").distinct()
    return at.join(numbered.select(F.col("id").alias("a"), F.col("at").alias("i")), "i").join(numbered.select(F.col("id").alias("b"), F.col("at").alias("j")), "j").select("a", "b")


def pair_distances(pairs: DataFrame, high: DataFrame, low: DataFrame) -> DataFrame:
    """a, b, dh, dl: Euclidean distances of given pairs in both tables."""
    h, y = high.select("id", F.col("features").alias("h")), low.select("id", F.col("features").alias("y"))
    both = h.join(y, "id")
    one = both.select(F.col("id").alias("a"), F.col("h").alias("ha"), F.col("y").alias("ya"))
    two = both.select(F.col("id").alias("b"), F.col("h").alias("hb"), F.col("y").alias("yb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", V.euclidean(F.col("ha"), F.col("hb")).alias("dh"), V.euclidean(F.col("ya"), F.col("yb")).alias("dl"))


def _guarded(value, x: str, y: str):
    """Null with fewer than 3 pairs or without spread."""
    return F.when((F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)) >= 3) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), value)


def distance_metrics(distances: DataFrame) -> DataFrame:
    """One row: Pearson and Spearman (average ranks) correlation and normalized stress of (dh, dl)."""
    avg_rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2
    r = distances.withColumn("rh", avg_rank("dh")).withColumn("rl", avg_rank("dl"))
    norms = distances.agg(F.sqrt(F.sum(F.col("dh") * F.col("dh"))).alias("nh"), F.sqrt(F.sum(F.col("dl") * F.col("dl"))).alias("nl"))
    gap = F.col("dh") / F.col("nh") - F.col("dl") / F.col("nl")
    return r.crossJoin(F.broadcast(norms)).agg(F.round(_guarded(F.corr("dh", "dl"), "dh", "dl"), 6).alias("pearson"), F.round(_guarded(F.corr("rh", "rl"), "dh", "dl"), 6).alias("spearman"), F.round(F.sqrt(F.sum(gap * gap)), 6).alias("normalized_stress"))


def density_metrics(high_knn: DataFrame, low_knn: DataFrame, k: int) -> DataFrame:
    """One row about the distances of the k-th neighbours in both spaces (radii): correlations of their logs by value and by
    average rank, RMSE of the logs after (x - median) / MAD (sd if the MAD is 0), means, and the number of rows.

    Radii that are null, NaN, infinite or negative don't count; a zero radius counts as a millionth of the least positive one.
    With fewer than 3 rows there are only the means and the number.
    """
    h = high_knn.where(F.col("rank") == k).select("src_id", F.col("distance").alias("rh"))
    y = low_knn.where(F.col("rank") == k).select("src_id", F.col("distance").alias("ry"))
    fine = lambda c: (F.col(c) >= 0) & (F.col(c) < float("inf"))
    radii = cut(h.join(y, "src_id").where(fine("rh") & fine("ry")), "radii")
    positive = lambda c: F.min(F.when(F.col(c) > 0, F.col(c)))
    least = radii.agg((F.coalesce(F.least(positive("rh"), positive("ry")), F.lit(1.0)) * 1e-6).alias("_eps"))
    both = radii.crossJoin(F.broadcast(least)).select("src_id", "rh", "ry", F.log(F.greatest("rh", "_eps")).alias("h"), F.log(F.greatest("ry", "_eps")).alias("y"))
    med = both.agg(F.median("h").alias("mh"), F.median("y").alias("my"))
    avg_rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2
    # a sample of bounded size, so one task may rank it
    dev = both.withColumn("ph", avg_rank("h")).withColumn("py", avg_rank("y")).crossJoin(F.broadcast(med))
    mad = dev.agg(F.median(F.abs(F.col("h") - F.col("mh"))).alias("ah"), F.median(F.abs(F.col("y") - F.col("my"))).alias("ay"), F.stddev_samp("h").alias("sh"), F.stddev_samp("y").alias("sy"))
    scale = lambda a, s: F.when(F.col(a) > 0, F.col(a)).when(F.col(s) > 0, F.col(s)).otherwise(1.0)
    gap = (F.col("h") - F.col("mh")) / scale("ah", "sh") - (F.col("y") - F.col("my")) / scale("ay", "sy")
    enough = lambda value: F.when(F.count(F.lit(1)) >= 3, value)
    return dev.crossJoin(F.broadcast(mad)).agg(
        F.round(_guarded(F.corr("ph", "py"), "h", "y"), 6).alias("density_spearman"),
        F.round(_guarded(F.corr("h", "y"), "h", "y"), 6).alias("density_pearson"),
        F.round(enough(F.sqrt(F.avg(gap * gap))), 6).alias("density_log_radius_rmse"),
        F.round(F.avg("rh"), 6).alias("density_radius_high_mean"),
        F.round(F.avg("ry"), 6).alias("density_radius_embedding_mean"),
        F.count(F.lit(1)).alias("density_sample_size"),
    )


def centroid_corr(high: DataFrame, low: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: Pearson correlation of the distances between class centroids in both tables; null below 3 classes."""
    def centroids(df):
        long = df.select("id", "features").join(labels.where("label IS NOT NULL").select("id", "label"), "id").select("label", F.posexplode("features").alias("pos", "x"))
        return long.groupBy("label", "pos").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("c"))

    both = centroids(high).withColumnRenamed("c", "h").join(centroids(low).withColumnRenamed("c", "y"), "label")
    a = both.select(F.col("label").alias("la"), F.col("h").alias("ha"), F.col("y").alias("ya"))
    # one row per class on either side
    pairs = a.join(both, F.col("la") < F.col("label")).select(V.euclidean(F.col("ha"), F.col("h")).alias("dh"), V.euclidean(F.col("ya"), F.col("y")).alias("dl"))
    return pairs.agg(F.round(_guarded(F.corr("dh", "dl"), "dh", "dl"), 6).alias("centroid_corr"))


def least_sample(n: int, max_k: int, asked: int) -> int:
    return min(n, max(asked, math.floor((3 * max_k + 1) / 2) + 1))
