"""The named queries of this package: name -> (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.llm import density_peaks, packing, percentiles, rank_fusion, similar_vectors, token_ids, top_per_group, visual_form
from orrery.llm.sql import ORACLES
from orrery.plans.cut import cut
from orrery.sources.tables import table


def p1_found(spark, d):
    return similar_vectors.probe_pairs(similar_vectors.similar_rows(table(spark, d, "float_matrix")))


def p1_similar(spark, d):
    return similar_vectors.similar_rows(table(spark, d, "float_matrix")).drop("probe")


def p2_found(spark, d):
    return percentiles.slow_runs(table(spark, d, "compare_r_package_embeddings"))


def p2_percentiles(spark, d):
    values = cut(percentiles.measures(table(spark, d, "compare_r_package_embeddings")), "run-measures")
    return percentiles.radix_percentiles(values, percentiles.GROUP).drop("low", "high")


def p2_from_days(spark, d):
    """Percentiles read from one digest per day, added up: bounds that hold the exact value."""
    values = percentiles.measures(table(spark, d, "compare_r_package_embeddings"))
    days = percentiles.digest(values, [*percentiles.GROUP, "day"])
    return percentiles.digest_percentiles(percentiles.merge_digests(days, percentiles.GROUP), percentiles.GROUP)


def p4_found(spark, d):
    return top_per_group.nearest_nodes(table(spark, d, "node_distance")).select("search_id", "id")


def p4_top(spark, d):
    return top_per_group.nearest_nodes(table(spark, d, "node_distance"))


def _members(spark, d):
    return density_peaks.clusters(table(spark, d, "float_matrix"), table(spark, d, "graph_edges"))


def p5_found(spark, d):
    return density_peaks.cluster_pairs(_members(spark, d))


def p5_clusters(spark, d):
    return density_peaks.described(cut(_members(spark, d), "members"))


def p6_found(spark, d):
    return rank_fusion.ranking(table(spark, d, "score_accum"), by="mean").where(F.col("position") <= 5).select("panel_id", "item_id")


def p6_ranking(spark, d):
    return rank_fusion.ranking(table(spark, d, "score_accum"))


def p7_ids(spark, d):
    return token_ids.token_ids(table(spark, d, "documents"))


def p7_round_trip(spark, d):
    return token_ids.round_trips(table(spark, d, "documents"))


def p8_pack(spark, d):
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_plan"))


def p8_fill(spark, d):
    return packing.fill(packing.pack(table(spark, d, "documents"), table(spark, d, "pack_plan")))


def p9_found(spark, d):
    return visual_form.look_alikes(table(spark, d, "documents"))


def p9_classes(spark, d):
    return visual_form.look_classes(table(spark, d, "documents"))


def p9_texts(spark, d):
    return visual_form.consistent_texts(table(spark, d, "documents"))


QUERIES = {name: f for name, f in list(globals().items()) if name[:1] == "p" and name[1:2].isdigit() and callable(f)}

__all__ = ["ORACLES", "QUERIES"]
