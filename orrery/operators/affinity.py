"""t-SNE affinities: conditional probabilities of given perplexity, their symmetric form, gradient and cost."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import kernels
from orrery.plans.cut import cut
from orrery.plans.sizing import heavy_partitions

COST_EPS = 1e-9  # fixed value of the method


def neighbour_policy(n: int, perplexity: float | None = None) -> tuple[int, float]:
    """(k, perplexity): with a perplexity k is its ceiling, at most a third of n - 1; without, k is 15 and the perplexity a third of it."""
    limit = (n - 1) // 3
    if perplexity is not None:
        if not 0 < perplexity <= max(1, limit):
            raise ValueError(f"perplexity must be above 0 and at most {max(1, limit)}")
        return max(1, math.ceil(perplexity)), float(perplexity)
    k = min(15, n - 1)
    return k, float(max(1, min(30, limit, k // 3)))


def conditional(knn: DataFrame, perplexity: float) -> DataFrame:
    """src, dst, p: p(dst | src) proportional to exp(-beta d^2), beta such that the entropy of each row is ln(perplexity).

    One short list per row goes to numpy in Arrow batches, where all rows of a batch are searched in step; as nested
    higher-order functions the same search is interpreted row by row.
    """

    def run(batches):
        for b in batches:
            d, mask = kernels.padded(b["d"].to_pylist())
            p = kernels.perplexity_rows(d, perplexity, mask)
            yield pa.RecordBatch.from_arrays([b["src_id"], b["ids"], pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(mask.sum(1))]).astype(np.int32)), pa.array(p[mask]))], ["src", "ids", "p"])

    lists = knn.groupBy("src_id").agg(F.sort_array(F.collect_list(F.struct("distance", "nbr_id"))).alias("near")).select("src_id", F.col("near.nbr_id").alias("ids"), F.col("near.distance").alias("d"))
    solved = lists.mapInArrow(run, "src bigint, ids array<bigint>, p array<double>")
    return solved.select("src", F.explode(F.arrays_zip("ids", "p")).alias("c")).select("src", F.col("c.ids").alias("dst"), F.col("c.p").alias("p"))


def symmetric(cond: DataFrame) -> DataFrame:
    """src, dst, p in both directions: the two conditionals of a pair added, the whole of mass 1."""
    pair = cond.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("p").alias("s"))
    total = pair.agg(F.sum("s").alias("_t"))
    half = pair.crossJoin(F.broadcast(total)).select("a", "b", (0.5 * F.col("s") / F.col("_t")).alias("p"))
    return half.select(F.col("a").alias("src"), F.col("b").alias("dst"), "p").unionByName(half.select(F.col("b").alias("src"), F.col("a").alias("dst"), "p"))


#: Rows of a block of a layout; a task holds two blocks and a strip of their pairs.
BLOCK_ROWS, STRIP = 8192, 256


def repulsion(layout: DataFrame) -> DataFrame:
    """id, q, r1, r2: for each row the sums of q, q^2 D1 and q^2 D2 over all other rows; q = 1 / (1 + d^2).

    Rows are hashed into blocks, and each pair of blocks (joined by their numbers) is one task's work; what leaves a task is
    one row per row of a block. ``layout``: id, y1, y2.
    """
    blocks = max(1, math.ceil(layout.count() / BLOCK_ROWS))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    placed = layout.select("id", "y1", "y2", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    n = heavy_partitions(layout.sparkSession, blocks * blocks)
    left = placed.withColumn("side", every).repartition(n, "block", "side")
    right = placed.select("id", "y1", "y2", F.col("block").alias("side"), every.alias("block")).repartition(n, "block", "side")

    def run(key, a, b):
        out = np.zeros((a.num_rows, 3))
        u1, u2 = (b[c].to_numpy() for c in ("y1", "y2"))
        ids, other = a["id"].to_numpy(), b["id"].to_numpy()
        v1, v2 = (a[c].to_numpy() for c in ("y1", "y2"))
        for s in range(0, len(ids), STRIP):
            d1, d2 = np.subtract.outer(v1[s : s + STRIP], u1), np.subtract.outer(v2[s : s + STRIP], u2)
            q = np.where(ids[s : s + STRIP, None] == other[None], 0.0, 1 / (1 + d1 * d1 + d2 * d2))
            out[s : s + STRIP, 0] = q.sum(1)
            q *= q
            out[s : s + STRIP, 1], out[s : s + STRIP, 2] = (q * d1).sum(1), (q * d2).sum(1)
        return pa.table({"id": ids, "q": out[:, 0], "r1": out[:, 1], "r2": out[:, 2]})

    met = left.groupBy("block", "side").cogroup(right.groupBy("block", "side")).applyInArrow(run, "id bigint, q double, r1 double, r2 double")
    return met.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("q", "r1", "r2")])


def _ends(p: DataFrame, layout: DataFrame) -> DataFrame:
    """p with the positions of both ends (x1, x2 and y1, y2)."""
    a = layout.select(F.col("id").alias("src"), F.col("y1").alias("x1"), F.col("y2").alias("x2"))
    return p.join(a, "src").join(layout.select(F.col("id").alias("dst"), "y1", "y2"), "dst")


def kl_cost(p: DataFrame, layout: DataFrame) -> DataFrame:
    """One row, kl: sum of p ln((p + 1e-9) / (q + 1e-9)) over the pairs with p; q = (1 / (1 + d^2)) / its sum over all ordered pairs.

    The normalizer needs all pairs of the layout (id, y1, y2), in blocks: see :func:`repulsion`.
    """
    d1, d2 = F.col("x1") - F.col("y1"), F.col("x2") - F.col("y2")
    pairs = _ends(p, layout).crossJoin(F.broadcast(cut(repulsion(layout), "repulsion").agg(F.sum("q").alias("z"))))
    q = 1.0 / (1.0 + d1 * d1 + d2 * d2) / F.col("z")
    return pairs.agg(F.sum(F.col("p") * F.log((F.col("p") + COST_EPS) / (q + COST_EPS))).alias("kl"))


def exact_gradient(p: DataFrame, layout: DataFrame, exaggeration: float = 1.0) -> DataFrame:
    """id, g1, g2: one exact gradient step's direction, attraction ex p q D minus repulsion q^2 D / Z, q = 1 / (1 + d^2)."""
    d1, d2 = F.col("x1") - F.col("y1"), F.col("x2") - F.col("y2")
    q = 1.0 / (1.0 + d1 * d1 + d2 * d2)
    repel = cut(repulsion(layout), "repulsion")
    att = _ends(p, layout).groupBy(F.col("src").alias("id")).agg(F.sum(exaggeration * F.col("p") * q * d1).alias("a1"), F.sum(exaggeration * F.col("p") * q * d2).alias("a2"))
    both = repel.join(att, "id", "left").crossJoin(F.broadcast(repel.agg(F.sum("q").alias("z"))))
    return both.select("id", *[(F.coalesce(f"a{c}", F.lit(0.0)) - F.col(f"r{c}") / F.col("z")).alias(f"g{c}") for c in (1, 2)])
