"""UMAP and t-SNE layouts of feature tables or neighbour tables.

Neighbours, graphs and affinities are distributed plans. The descent itself is sequential, and a layout is small (a few
numbers a row), so one task runs one (seed, configuration) over a graph of at most FIT_ROWS rows; several seeds or
configurations run side by side. Larger tables are fitted on landmarks and projected (:mod:`.landmarks`), which is linear.
"""

from __future__ import annotations

import hashlib
import math
import time
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import affinity, fuzzy, graph, kernels
from orrery.operators.knn import exact_knn, precompute_knn, supplied_knn
from orrery.operators.pca import opentsne_pca_init, random_init
from orrery.operators.preprocess import auto_k, prepared
from orrery.operators.projection import AT_ONCE, padded
from orrery.plans.cut import cut
from orrery.sources.layouts import cached, content_key, load_layout

FIT_ROWS = 1_000_000
#: Reference rows that projected rows are pushed from.
PUSHERS = 100_000


@dataclass(frozen=True)
class Embedding:
    """layout: id, features (coordinates); with the parameters, stage timings in seconds and, if kept, the neighbours."""

    layout: DataFrame
    method: str
    parameters: dict
    timings: dict = field(default_factory=dict)
    knn: DataFrame | None = None
    costs: tuple[float, ...] = ()

    def __repr__(self) -> str:
        return f"Embedding({self.method}, parameters={self.parameters}, timings={ {k: round(v, 3) for k, v in self.timings.items()} })"

    def plot_data(self, labels: DataFrame | None = None, rows: int = 5000):
        """At most ``rows`` points (least hash) as pandas, x and y with the label, for any plotting tool."""
        y = self.layout.select("id", F.col("features")[0].alias("x"), F.col("features")[1].alias("y"))
        y = y.join(labels.select("id", "label"), "id", "left") if labels is not None else y
        return y.orderBy(F.xxhash64("id")).limit(rows).toPandas()


@dataclass(frozen=True)
class UmapInit:
    """A reusable start: the graph (src, dst, weight, epochs_per_sample), the layout, the parameters."""

    layout: DataFrame
    edges: DataFrame
    parameters: dict
    timings: dict

    def __repr__(self) -> str:
        return f"UmapInit(graph={self.parameters['graph_mode']}, parameters={self.parameters}, timings={ {k: round(v, 3) for k, v in self.timings.items()} })"


class _Clock:
    def __init__(self):
        self.at, self.spent = time.perf_counter(), {}

    def mark(self, name: str) -> None:
        now = time.perf_counter()
        self.spent[name], self.at = now - self.at, now


def _one_task(edges: DataFrame, start: DataFrame, configs: list[dict], kernel) -> DataFrame:
    """run, id, features: ``kernel(n, src, dst, columns, start, config)`` in one task per configuration."""
    n = start.count()
    if n > FIT_ROWS:
        raise ValueError(f"{n} rows are too many for one fit: use landmarks")
    each = F.explode(F.array(*[F.lit(i) for i in range(len(configs))])).alias("run")
    names = [c for c in edges.columns if c not in ("src", "dst")]

    def one(key, e, s):
        s = s.sort_by("id")
        ids = s["id"].to_numpy()
        e = e.sort_by([("src", "ascending"), ("dst", "ascending")])
        src, dst = (np.searchsorted(ids, e[c].to_numpy()) for c in ("src", "dst"))
        column = s["features"].combine_chunks()
        y0 = np.asarray(column.flatten(), float).reshape(len(ids), -1) if column.null_count == 0 and len(column.flatten()) else None
        y = kernel(len(ids), src, dst, {c: e[c].to_numpy() for c in names}, y0, configs[key[0].as_py()])
        return pa.table({"run": pa.array(np.full(len(ids), key[0].as_py(), np.int32)), "id": ids, "features": pa.array(y.tolist(), pa.list_(pa.float64()))})

    left = edges.select("src", "dst", *names, each)
    right = start.select("id", "features", each)
    return left.groupBy("run").cogroup(right.groupBy("run")).applyInArrow(one, "run int, id bigint, features array<double>")


def _ids(knn: DataFrame) -> DataFrame:
    return knn.select(F.col("src_id").alias("id")).distinct()


def _blank(ids: DataFrame) -> DataFrame:
    return ids.select("id", F.array().cast("array<double>").alias("features"))


def _umap_parameters(knn: DataFrame, ids: DataFrame, overrides: dict | None) -> dict:
    prof = fuzzy.distance_profile(knn).first()
    ratio = prof.median_50 / prof.median_15 if prof.median_50 and prof.median_15 else None
    params = fuzzy.umap_parameters(prof.n_rows, prof.cv or 0.0, ratio)
    if prof.n_rows >= 10_000:
        c = graph.connectivity(knn, ids).first()
        params["spectral_iterations"] = fuzzy.spectral_iterations(prof.n_rows, c.n_components, c.largest_share)
    params |= overrides or {}
    params["a"], params["b"] = fuzzy.find_ab(params["spread"], params["min_dist"])
    return params


def _spectral(n, src, dst, cols, y0, config):
    y = kernels.spectral_init(n, src, dst, cols["weight"], config["n_components"], config["spectral_iterations"], np.random.default_rng(config["seed"]))
    if config.get("init_sd"):
        y *= config["init_sd"] / max(y.std(0).max(), 1e-12)
    return y


def _sgd(n, src, dst, cols, y0, config):
    rng = np.random.default_rng(config["seed"])
    return kernels.umap_optimize(y0, src, dst, cols["epochs_per_sample"], config["a"], config["b"], config["n_epochs"], rng, config["learning_rate"], config["negative_samples"])


def umap_init(knn: DataFrame, n_components: int = 2, graph_mode: str = "fuzzy", seed: int = 4, parameters: dict | None = None) -> UmapInit:
    """Graph and spectral start of a neighbour table, to be reused over optimizations."""
    clock = _Clock()
    knn = cut(knn, "umap-knn")
    ids = cut(_ids(knn), "umap-ids")
    params = _umap_parameters(knn, ids, parameters) | {"n_components": n_components, "seed": seed, "graph_mode": graph_mode}
    clock.mark("profile")
    edges = cut(fuzzy.prepare_umap_knn(knn, graph_mode), "umap-graph")
    clock.mark("graph")
    layout = cut(_one_task(edges, _blank(ids), [params], _spectral).drop("run"), "umap-start")
    clock.mark("initialization")
    return UmapInit(layout, edges, params, clock.spent)


def umap_knn(knn: DataFrame, n_components: int = 2, seed: int = 42, graph_mode: str = "fuzzy", init: UmapInit | None = None, parameters: dict | None = None) -> Embedding:
    """UMAP of a neighbour table (or of a prepared start)."""
    start = init or umap_init(knn, n_components, graph_mode, seed, parameters)
    clock = _Clock()
    config = start.parameters | {"seed": seed}
    layout = cut(_one_task(start.edges, start.layout, [config], _sgd).drop("run"), "umap-layout")
    clock.mark("optimization")
    return Embedding(layout, "umap", config, start.timings | clock.spent)


def umap(df: DataFrame, n_neighbors: int | None = None, n_components: int = 2, standardize: bool = False, pca_dims: int | None = None, metric: str = "euclidean", nn: DataFrame | None = None, seed: int = 4, keep_knn: bool = False, graph_mode: str = "fuzzy", parameters: dict | None = None) -> Embedding:
    """UMAP of a feature table (id, features); ``nn`` are neighbours found elsewhere."""
    clock = _Clock()
    data = cut(prepared(df, standardize, pca_dims, seed), "umap-data")
    clock.mark("preprocess")
    k = n_neighbors or auto_k(data.count())
    knn = cut(supplied_knn(nn, data, k) if nn is not None else precompute_knn(data, k, metric, seed=seed), "umap-knn")
    clock.mark("knn")
    e = umap_knn(knn, n_components, seed, graph_mode, parameters=parameters)
    return replace(e, timings=clock.spent | e.timings, knn=knn if keep_knn else None, parameters=e.parameters | {"n_neighbors": k, "metric": metric})


@dataclass(frozen=True)
class TsneKnn:
    """Neighbours stripped of self and trimmed to what the perplexity needs."""

    knn: DataFrame
    perplexity: float
    n_rows: int

    def __repr__(self) -> str:
        return f"TsneKnn(n={self.n_rows}, perplexity={self.perplexity})"


def prepare_opentsne_knn(knn: DataFrame, ids: DataFrame, n_neighbors: int | None = None, perplexity: float | None = None) -> TsneKnn:
    n = ids.count()
    k, perp = affinity.neighbour_policy(n, perplexity)
    kept = cut(supplied_knn(knn, ids, n_neighbors or k), "tsne-knn")
    return TsneKnn(kept, perp, n)


def tsne_schedule(n: int, early_iter: int | None = None, n_iter: int | None = None, learning_rate="auto", early_exaggeration="auto", exaggeration=None) -> dict:
    """250 early steps at exaggeration 12, then 500; learning rate n / 12 in both phases unless given."""
    return {"early_iter": 250 if early_iter is None else early_iter, "n_iter": 500 if n_iter is None else n_iter, "learning_rate": n / 12 if learning_rate == "auto" else float(learning_rate), "early_exaggeration": 12.0 if early_exaggeration == "auto" else float(early_exaggeration), "exaggeration": exaggeration or 1.0}


def _descend(n, src, dst, cols, y0, c):
    return kernels.tsne_optimize(y0, src, dst, cols["p"], c["early_iter"], c["n_iter"], c["early_exaggeration"], c["exaggeration"], c["learning_rate"], c["momentum"], method=c["negative_gradient_method"])[0]


def opentsne_knn(nn: TsneKnn, n_components: int = 2, init: DataFrame | None = None, seed: int = 4, initial_momentum: float = 0.8, final_momentum: float = 0.8, negative_gradient_method: str = "auto", **schedule) -> Embedding:
    """t-SNE of prepared neighbours; the start is random unless a layout (id, features) is given."""
    if not 1 <= n_components <= 3:
        raise ValueError("t-SNE layouts have 1 to 3 dimensions")
    clock = _Clock()
    p = cut(affinity.symmetric(cut(affinity.conditional(nn.knn, nn.perplexity), "conditional")), "affinity")
    clock.mark("affinity")
    start = cut(init if init is not None else random_init(_ids(nn.knn), n_components, seed), "tsne-start")
    config = tsne_schedule(nn.n_rows, **schedule) | {"momentum": (initial_momentum, final_momentum), "negative_gradient_method": negative_gradient_method, "perplexity": nn.perplexity, "seed": seed, "n_components": n_components}
    layout = cut(_one_task(p, start, [config], _descend).drop("run"), "tsne-layout")
    clock.mark("optimization")
    return Embedding(layout, "opentsne", config, clock.spent)


def opentsne(df: DataFrame, perplexity: float | None = None, n_components: int = 2, standardize: bool = False, pca_dims: int | None = None, metric: str = "euclidean", nn: DataFrame | None = None, init: DataFrame | str | None = None, seed: int = 4, keep_knn: bool = False, cache_dir: str | None = None, **options) -> Embedding:
    """t-SNE of a feature table; the start is the first principal components unless a layout, or the path of a saved one, is
    given. With ``cache_dir`` the components are read from there if they were written for the same rows before."""
    clock = _Clock()
    data = cut(prepared(df, standardize, pca_dims, seed), "tsne-data")
    n = data.count()
    k, perp = affinity.neighbour_policy(n, perplexity)
    clock.mark("preprocess")
    knn = cut(supplied_knn(nn, data, k) if nn is not None else precompute_knn(data, k, metric, seed=seed), "tsne-knn")
    clock.mark("knn")
    if isinstance(init, str):
        start = load_layout(df.sparkSession, init)
    elif init is not None:
        start = init
    else:
        components = lambda: opentsne_pca_init(data, n_components, seed)
        start = cached(data, cache_dir, ("pca_init", n_components, seed), components) if cache_dir else components()
    e = opentsne_knn(TsneKnn(knn, perp, n), n_components, start, seed, **options)
    return replace(e, timings=clock.spent | e.timings, knn=knn if keep_knn else None)


def embed_knn(knn: DataFrame, method: str = "umap", n_components: int = 2, seed: int = 4, **options) -> Embedding:
    """Either layout of a neighbour table."""
    if method == "umap":
        return umap_knn(knn, n_components, seed, **options)
    if method in ("opentsne", "tsne"):
        ids = _ids(knn)
        return opentsne_knn(prepare_opentsne_knn(knn, ids, perplexity=options.pop("perplexity", None)), n_components, seed=seed, **options)
    raise ValueError("method must be umap or opentsne")


def refine_rows(layout: DataFrame, knn: DataFrame, reference: DataFrame, seed: int = 4, n_epochs: int = 50, parameters: dict | None = None) -> DataFrame:
    """id, features: new rows moved by UMAP's forces among the reference rows, which stay fixed.

    The directed graph of the new rows has its own scales: each is pulled to its neighbours, whose positions come by an
    equi-join, and, with every pull, pushed from ``negative_samples`` rows. Those are drawn among at most PUSHERS reference rows
    (those of least hash; all of a smaller layout), which are broadcast. Rows don't feel one another, so a part of an Arrow
    batch is one numpy computation; each row draws its own numbers from its id, so any partitioning gives the same result.
    """
    c = {"learning_rate": 1.0, "negative_samples": 5} | dict(zip("ab", fuzzy.find_ab(1.0, 0.01), strict=True)) | (parameters or {})
    rows = reference.select("id", "features").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(PUSHERS).toArrow()
    shared = reference.sparkSession.sparkContext.broadcast(np.asarray(rows["features"].combine_chunks().flatten(), float).reshape(rows.num_rows, -1))
    edges = fuzzy.memberships(knn)
    top = edges.groupBy("src").agg(F.max("weight").alias("_top"))
    refs = reference.select(F.col("id").alias("dst"), F.col("features").alias("y"))
    lists = edges.join(top, "src").join(refs, "dst").groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", (F.col("_top") / F.greatest("weight", F.lit(1e-6))).alias("eps"), "y"))).alias("near"))
    both = layout.select("id", "features").join(lists, layout.id == lists.src).select("id", "features", F.col("near.eps").alias("eps"), F.col("near.y").alias("y"))

    def run(batches):
        for whole in batches:
            for s in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(s, AT_ONCE)
                width = int(np.diff(b["eps"].offsets.to_numpy()).max())
                at = np.asarray(b["features"].flatten(), float).reshape(b.num_rows, -1)
                y = kernels.umap_refine(at, padded(b["y"], width), padded(b["eps"], width, np.inf), b["id"].to_numpy(), shared.value, c["a"], c["b"], n_epochs, seed, c["learning_rate"], c["negative_samples"])
                yield pa.RecordBatch.from_arrays([b["id"], pa.array(y.tolist(), pa.list_(pa.float64()))], ["id", "features"])

    return both.mapInArrow(run, "id bigint, features array<double>")


#: Weights of the parts of a pilot's quality, without and with labels.
PILOT_WEIGHTS = {"trust": 0.25, "preserve50": 0.35, "continuity50": 0.25, "preserve": 0.15}
PILOT_LABEL_WEIGHTS = {"trust": 0.25, "preserve": 0.20, "continuity": 0.15, "label": 0.25, "rare": 0.15}


def pilot_quality(parts: dict[str, float | None], labelled: bool) -> float:
    """Weighted mean of the parts that there are."""
    weights = PILOT_LABEL_WEIGHTS if labelled else PILOT_WEIGHTS
    there = {c: w for c, w in weights.items() if parts.get(c) is not None}
    return sum(parts[c] * w for c, w in there.items()) / sum(there.values())


def tuned_umap(df: DataFrame, configs: list[dict], n_neighbors: int = 15, seed: int = 4, penalty: float = 0.01, cache_dir: str | None = None, labels: DataFrame | None = None) -> DataFrame:
    """run, parameters, quality, score: pilot fits of several configurations, one task each over one shared graph, best first.

    Quality is made of the neighbours kept among ``n_neighbors`` and among 50 and, given labels (id, label), of the label
    vote's accuracy and the recall of rare classes. The score is the quality less ``penalty`` * log1p(epochs / 100), the part
    of the time that a configuration decides. With ``cache_dir`` the result is read from there if it was written for the same
    rows and configurations before.
    """
    from orrery.operators import metrics

    if cache_dir:
        key = hashlib.sha256(repr((configs, n_neighbors, seed, penalty, content_key(labels) if labels is not None else None)).encode()).hexdigest()[:16]
        return cached(df.select("id", "features"), cache_dir, ("umap_pilot", key), lambda: tuned_umap(df, configs, n_neighbors, seed, penalty, None, labels)).orderBy(F.desc("score"))
    wide = min(50, df.count() - 1)
    far = cut(exact_knn(df, max(wide, n_neighbors)), "pilot-knn-50")
    knn = cut(far.where(F.col("rank") <= n_neighbors), "pilot-knn")
    start = umap_init(knn, seed=seed)
    full = []
    for c in configs:
        p = start.parameters | c
        p["a"], p["b"] = fuzzy.find_ab(p["spread"], p["min_dist"])
        full.append(p)
    runs = cut(_one_task(start.edges, start.layout, full, _sgd), "pilot-layouts")
    rows = []
    for i, c in enumerate(configs):
        low = cut(exact_knn(runs.where(F.col("run") == i).select("id", "features"), max(wide, n_neighbors)), "pilot-low")
        kept = {k: metrics.preservation(far, low, k).first()[0] for k in (n_neighbors, wide)}
        # two lists of one length lack as many neighbours as they have false ones, so the three parts agree
        parts = dict.fromkeys(("trust", "preserve", "continuity"), kept[n_neighbors]) | dict.fromkeys(("preserve50", "continuity50"), kept[wide])
        if labels is not None:
            per = cut(metrics.label_accuracy(metrics.label_votes(low.where(F.col("rank") <= n_neighbors), labels, n_neighbors)), "pilot-classes")
            parts |= {"label": per.agg(F.sum("correct") / F.sum("n")).first()[0], "rare": metrics.rare_recall(per).first().rare_recall}
        quality = float(pilot_quality(parts, labels is not None))
        rows.append((i, str(c), quality, quality - penalty * math.log1p(full[i]["n_epochs"] / 100)))
    return df.sparkSession.createDataFrame(rows, "run int, parameters string, quality double, score double").orderBy(F.desc("score"))
