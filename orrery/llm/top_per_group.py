"""Problem 4: the N best items of every group by two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.plans.cut import cut

#: Rows of a subgroup, about.
SPLIT_ROWS = 200_000


def subgroup_counts(df: DataFrame, group: str, split_rows: int) -> DataFrame:
    """group, n_sub for the groups of more than one subgroup: at most rows / split_rows groups.

    The counting reads one column and is combined before the shuffle, so a hot group costs one row per task.
    """
    counted = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split_rows)
    return cut(counted.select(group, F.ceil(F.col("n") / split_rows).cast("int").alias("n_sub")), "hot-groups")


def top_per_group(df: DataFrame, group: str, item: str, score: str, n: int = 10, usable: Column | None = None, descending: bool = False, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """The ``n`` items of best score in every group: group, item, score, position (from 1).

    Best is least, or greatest if ``descending``; at equal score the smaller item comes first. An item counts once in
    a group, with its best score; a group of fewer items gives all of them.

    Stage one hashes the items of a group into subgroups of about ``split_rows`` rows, so that all rows of an item meet in one
    task however many rows the group has; there repeats are folded and N items kept. Stage two ranks the survivors, at most N
    per subgroup, by score and item.

    Rows with a null group, item or score, a NaN score, or where ``usable`` is not true are left out. Ties, repeated
    rows, empty tables and further columns (ignored) are fine.
    """
    ok = F.col(group).isNotNull() & F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    rows = df.where(ok if usable is None else ok & usable).select(F.col(group).alias("_g"), F.col(item).alias("_i"), F.col(score).alias("_s"))
    hot = subgroup_counts(rows, "_g", split_rows)
    salted = rows.join(hot, "_g", "left").withColumn("_sub", F.pmod(F.xxhash64("_i"), F.coalesce("n_sub", F.lit(1))).cast("int"))
    best = F.max("_s") if descending else F.min("_s")
    # one exchange serves the folding of repeats and the ranking: both cluster on (_g, _sub)
    once = salted.select("_g", "_sub", "_i", "_s").repartition("_g", "_sub").groupBy("_g", "_sub", "_i").agg(best.alias("_s"))
    order = [F.col("_s").desc() if descending else F.col("_s"), F.col("_i")]
    nth = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = once.withColumn("_n", nth("_g", "_sub")).where(F.col("_n") <= n).select("_g", "_i", "_s")
    last = first.withColumn("_n", nth("_g")).where(F.col("_n") <= n)
    return last.select(F.col("_g").alias(group), F.col("_i").alias(item), F.col("_s").alias(score), F.col("_n").cast("bigint").alias("position"))


def nearest_nodes(node_distance: DataFrame, n: int = 10) -> DataFrame:
    """search_id, id, distance, position: the ids of least usable distance of every search.

    A distance is usable if it is neither null, NaN, infinite nor negative.
    """
    usable = (F.col("distance") >= 0) & (F.col("distance") < float("inf"))
    return top_per_group(node_distance, "search_id", "id", "distance", n, usable)
