"""Following chains of pointers by doubling, in a number of joins that grows with the logarithm of the longest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.plans.cut import cut


def follow(pointers: DataFrame, node: str, to: str, end: str) -> DataFrame:
    """``node``, ``end``: where the chain that starts at each node ends (``to`` is null at an end; no cycles).

    ``pointers`` is read more than once: it should be a written table.
    """
    state = pointers.select(F.col(node).alias("_node"), F.coalesce(to, node).alias("_end"))
    while True:
        step = state.select(F.col("_node").alias("_end"), F.col("_end").alias("_next"))
        state = cut(state.join(step, "_end").select("_node", F.col("_next").alias("_end"), (F.col("_next") != F.col("_end")).alias("_moved")), "chain")
        if not state.where("_moved").limit(1).count():
            return state.select(F.col("_node").alias(node), F.col("_end").alias(end))
