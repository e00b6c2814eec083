"""Principal components of a feature table, and the start layouts made of them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.plans.cut import cut

#: Columns up to which the exact Gram matrix is formed; wider tables use a random sketch.
GRAM_COLUMNS = 2048
OVERSAMPLE = 20
INIT_SD = 1e-4  # fixed value: standard deviation of a t-SNE start


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


#: Partial sums that one task adds up.
FAN = 8


def _summed(df: DataFrame, kernel) -> np.ndarray:
    """Sum over all Arrow batches of ``kernel(x)`` (an array of fixed size): partly in tasks, then FAN at a time, in as many
    rounds as the number of partial sums asks for. One array reaches the driver."""

    def part(batches):
        total = None
        for b in batches:
            if b.num_rows:
                v = kernel(_matrix(b["features"]))
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], ["v"])

    def add(key, t):
        total = 0.0
        for v in t["v"]:
            total = total + np.frombuffer(v.as_buffer(), "<f8")
        return pa.table({"g": [key[0].as_py()], "v": pa.array([total.tobytes()], pa.binary())})

    parts = cut(df.select("features").mapInArrow(part, "v binary").withColumn("g", F.spark_partition_id().cast("bigint")), "partial-sums")
    left = (parts.agg(F.max("g")).first()[0] or 0) + 1
    while left > 1:
        parts = parts.select((F.col("g") / FAN).cast("bigint").alias("g"), "v").groupBy("g").applyInArrow(add, "g bigint, v binary")
        left = -(-left // FAN)
    row = parts.select("v").first()
    if row is None:
        raise ValueError("no rows")
    return np.frombuffer(bytes(row.v), "<f8")


def signed(loadings: np.ndarray) -> np.ndarray:
    """Each component turned so that its loading of greatest magnitude is positive."""
    top = np.abs(loadings).argmax(0)
    return loadings * np.where(loadings[top, np.arange(loadings.shape[1])] < 0, -1.0, 1.0)


@dataclass(frozen=True)
class Pca:
    loadings: np.ndarray
    singular_values: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    n_rows: int

    @property
    def ncomp(self) -> int:
        return self.loadings.shape[1]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with its features replaced by scores ((x - center) / scale) . loadings; fitted and new rows alike."""
        spark = df.sparkSession
        shared = spark.sparkContext.broadcast((self.center, self.scale, self.loadings))  # columns x components

        def run(batches):
            c, s, w = shared.value
            for b in batches:
                scores = ((_matrix(b["features"]) - c) / s) @ w if b.num_rows else np.zeros((0, w.shape[1]))
                yield pa.RecordBatch.from_arrays([b["id"], pa.FixedSizeListArray.from_arrays(pa.array(scores.ravel()), w.shape[1]).cast(pa.list_(pa.float64()))], ["id", "features"])

        scores = df.select("id", "features").mapInArrow(run, "id bigint, features array<double>")
        rest = [c for c in df.columns if c != "features"]
        return scores if rest == ["id"] else scores.join(df.select(*rest), "id")

    def __repr__(self) -> str:
        return f"Pca(n={self.n_rows}, columns={len(self.center)}, ncomp={self.ncomp}, singular_values={np.round(self.singular_values, 4).tolist()})"


def fit_pca(df: DataFrame, ncomp: int = 2, center: bool = True, scale: bool = False, seed: int = 4, method: str | None = None) -> Pca:
    """The first min(ncomp, n - 1, p) components.

    Up to GRAM_COLUMNS columns the Gram matrix is summed over the partitions and decomposed exactly; wider tables use
    subspace iteration from a seeded Gaussian sketch of ncomp + 20 columns, two power rounds (one up to 20 components).
    Only arrays of columns x columns, or columns x sketch, reach the driver, whatever the number of rows.
    """
    p = df.select(F.size("features").alias("p")).first()
    if p is None:
        raise ValueError("no rows")
    p = p.p
    sums = _summed(df, lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    n = int(sums[0])
    mean = sums[1 : p + 1] / n
    mu = mean if center else np.zeros(p)
    sd = np.ones(p)
    if scale:
        var = np.maximum((sums[p + 1 :] - n * mean**2) / max(1, n - 1), 0) if center else sums[p + 1 :] / max(1, n - 1)
        sd = np.where(var > 0, np.sqrt(var), 1.0)
    rank = max(1, min(ncomp, n - 1, p))
    if (method or ("gram" if p <= GRAM_COLUMNS else "sketch")) == "gram":
        gram = _summed(df, lambda x: (((x - mu) / sd).T @ ((x - mu) / sd)).ravel()).reshape(p, p)
        values, vectors = np.linalg.eigh(gram)
        order = np.argsort(values)[::-1][:rank]
        values, vectors = np.maximum(values[order], 0), vectors[:, order]
    else:
        width = min(p, rank + OVERSAMPLE)
        basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((p, width)))[0]
        for _ in range(2 if rank > 20 else 1):
            z = _summed(df, lambda x, q=basis: (((x - mu) / sd).T @ (((x - mu) / sd) @ q)).ravel()).reshape(p, width)
            basis = np.linalg.qr(z)[0]
        z = _summed(df, lambda x, q=basis: (((x - mu) / sd).T @ (((x - mu) / sd) @ q)).ravel()).reshape(p, width)
        values, small = np.linalg.eigh(basis.T @ z)
        order = np.argsort(values)[::-1][:rank]
        values, vectors = np.maximum(values[order], 0), basis @ small[:, order]
    return Pca(signed(vectors), np.sqrt(values), mu, sd, n)


def scaled_scores(scores: DataFrame) -> DataFrame:
    """Scores centred, and scaled so that the largest standard deviation of a component is 1e-4."""
    long = scores.select(F.posexplode("features").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    one = long.agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("_m"), F.max("s").alias("_s"))
    factor = F.when(F.col("_s") > 0, INIT_SD / F.col("_s")).otherwise(1.0)
    return scores.crossJoin(F.broadcast(one)).select("id", F.zip_with("features", "_m", lambda x, m: (x - m["m"]) * factor).alias("features"))


def opentsne_pca_init(df: DataFrame, n_components: int = 2, seed: int = 4) -> DataFrame:
    """A t-SNE start: the first components, centred and scaled."""
    return scaled_scores(fit_pca(df, n_components, seed=seed).transform(df.select("id", "features")))


def random_init(ids: DataFrame, n_components: int = 2, seed: int = 4) -> DataFrame:
    """A t-SNE start of N(0, 1e-4) numbers made of each id's hash, so that partitioning doesn't matter; centred by column."""
    u = lambda j, k: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(j), F.lit(k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    z = [F.sqrt(-2 * F.log(u(j, 0))) * F.cos(2 * np.pi * u(j, 1)) * INIT_SD for j in range(n_components)]
    raw = ids.select("id", *[c.alias(f"_{j}") for j, c in enumerate(z)])
    means = raw.agg(*[F.avg(f"_{j}").alias(f"_m{j}") for j in range(n_components)])
    return raw.crossJoin(F.broadcast(means)).select("id", F.array(*[F.col(f"_{j}") - F.col(f"_m{j}") for j in range(n_components)]).alias("features"))
