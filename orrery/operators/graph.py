"""Undirected weighted graphs from neighbours: (src < dst, weight) edges, with the vertices in a table of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.knn import exact_knn
from orrery.plans.cut import cut

WEIGHTS = ("snn", "distance", "binary")


def knn_graph(knn: DataFrame, weight: str = "snn", mutual: bool = False, prune: float = 0.0) -> DataFrame:
    """src < dst, weight.

    snn: Jaccard index of the two rows' neighbour sets (without themselves); distance: 1 / (1 + d); binary: 1. ``mutual``
    keeps pairs that name each other. Weights <= prune go before the two directions are merged by the greatest weight.
    """
    if weight not in WEIGHTS:
        raise ValueError(f"weight must be one of {WEIGHTS}")
    e = knn.where("src_id <> nbr_id").select(F.col("src_id").alias("u"), F.col("nbr_id").alias("v"), "distance")
    if mutual:
        e = e.join(e.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"], "left_semi")
    if weight == "snn":
        sets = knn.where("src_id <> nbr_id").groupBy("src_id").agg(F.collect_set("nbr_id").alias("s"))
        e = e.join(sets.select(F.col("src_id").alias("u"), F.col("s").alias("su")), "u").join(sets.select(F.col("src_id").alias("v"), F.col("s").alias("sv")), "v", "left")
        shared = F.size(F.array_intersect("su", F.coalesce("sv", F.array().cast("array<bigint>"))))
        both = F.size("su") + F.coalesce(F.size("sv"), F.lit(0)) - shared
        w = F.when(both > 0, shared / both).otherwise(0.0)
    else:
        w = 1.0 / (1.0 + F.col("distance")) if weight == "distance" else F.lit(1.0)
    directed = e.select("u", "v", w.cast("double").alias("weight")).where(F.col("weight") > prune)
    return directed.groupBy(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).agg(F.max("weight").alias("weight"))


def graph_of(df: DataFrame, k: int = 30, metric: str = "euclidean", **options) -> DataFrame:
    """The neighbour graph of a feature table."""
    return knn_graph(exact_knn(df, k, metric), **options)


def validated_graph(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``edges`` if ends are known and different and weights finite and >= 0, repeats merged by the greatest; else ValueError."""
    w = F.col("weight")
    bad = edges.where(w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf")) | F.col("src").isNull() | F.col("dst").isNull()).limit(1).count()
    v = vertices.select("id")
    unknown = edges.join(v, edges.src == v.id, "left_anti").limit(1).count() + edges.join(v, edges.dst == v.id, "left_anti").limit(1).count()
    if bad or unknown:
        raise ValueError("graph: ends must be vertices, weights finite and not negative")
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """id, degree, strength of every vertex, isolated ones too; a loop counts twice."""
    d = both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))
    return vertices.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: modularity of the partition ``labels`` (id, community) - null without any weight - and n_communities.

    Three aggregations over edges joined with their ends' labels; a loop adds twice its weight to its vertex.
    """
    a, b = labels.select(F.col("id").alias("src"), F.col("community").alias("ca")), labels.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    e = edges.join(a, "src").join(b, "dst")
    inside = e.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.sum("weight").alias("w_in"))
    ends = e.select(F.col("ca").alias("c"), "weight").unionByName(e.select(F.col("cb").alias("c"), "weight"))
    volume = ends.groupBy("c").agg(F.sum("weight").alias("vol"))
    m = edges.agg(F.sum("weight").alias("m"))
    terms = volume.join(inside, "c", "left").crossJoin(F.broadcast(m))
    share = F.coalesce("w_in", F.lit(0.0)) / F.col("m") - resolution * F.pow(F.col("vol") / (2 * F.col("m")), 2)
    q = terms.where("m > 0").agg(F.sum(share).alias("modularity"))
    return q.crossJoin(F.broadcast(labels.agg(F.countDistinct("community").alias("n_communities"))))


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """id, component (least id of the component) of every vertex.

    Alternating large-star and small-star rounds: each joins nothing, regroups the edges around their least neighbour, and
    the number of rounds grows with the logarithm of the diameter. Stops when the edges no longer change.
    """
    e = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "star")
    seen = None
    while True:
        two = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = two.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = two.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = cut(small, "star")
        sign = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == seen:
            break
        seen = sign
    least = e.groupBy("u").agg(F.min("v").alias("component"))
    return vertices.select("id").join(least.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def connectivity(knn: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row: components of the neighbour graph, rows of the largest, its share, singletons, self and unknown edges."""
    known = knn.join(vertices.select(F.col("id").alias("nbr_id")), "nbr_id", "left_semi")
    comp = components(known.select(F.col("src_id").alias("src"), F.col("nbr_id").alias("dst")), vertices)
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    out = sizes.agg(F.count(F.lit(1)).alias("n_components"), F.max("n").alias("largest"), F.round(F.max("n") / F.sum("n"), 6).alias("largest_share"), F.count(F.when(F.col("n") == 1, 1)).alias("singletons"))
    loops = knn.agg(F.count(F.when(F.col("src_id") == F.col("nbr_id"), 1)).alias("self_edges"), F.count(F.lit(1)).alias("_all"))
    return out.crossJoin(loops).crossJoin(known.agg(F.count(F.lit(1)).alias("_known"))).select("n_components", "largest", "largest_share", "singletons", "self_edges", (F.col("_all") - F.col("_known")).alias("invalid_edges"))


def community_graph(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between communities: weights added up; inside ones become a loop."""
    a, b = labels.select(F.col("id").alias("src"), F.col("community").alias("ca")), labels.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    e = edges.join(a, "src").join(b, "dst")
    return e.groupBy(F.least("ca", "cb").alias("src"), F.greatest("ca", "cb").alias("dst")).agg(F.sum("weight").alias("weight"))


def communities_connected(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """community, size, connected: whether each community holds together by its own edges."""
    a, b = labels.select(F.col("id").alias("src"), F.col("community").alias("ca")), labels.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    inside = edges.join(a, "src").join(b, "dst").where("ca = cb AND weight > 0").select("src", "dst")
    comp = components(inside, labels)
    return labels.join(comp, "id").groupBy("community").agg(F.count(F.lit(1)).alias("size"), (F.countDistinct("component") == 1).alias("connected"))
