"""Problem 6: one ranking of several scores by their ranks, not their ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.plans.cut import cut
from orrery.plans.ranged import summed_before

SCORES = ("trust", "continuity", "preservation", "label_accuracy")
#: Decimal digits below the first digit of an item's largest thread that a sum keeps (a double has 17 in all).
DIGITS = 27


def _exponent(x: Column) -> Column:
    """About the decimal exponent of a finite double; null for 0."""
    return F.when(x != 0, F.floor(F.log10(F.abs(x))).cast("int"))


def _shifted(x: Column, by: Column) -> Column:
    """The finite double ``x``, as it is written, times ten to the power ``by``, as a whole number."""
    text = x.cast("string")
    own = F.when(F.instr(text, "E") > 0, F.substring_index(text, "E", -1).cast("int")).otherwise(0)
    return F.concat(F.substring_index(text, "E", 1), F.lit("E"), own + by).cast("decimal(38,0)")


def item_scores(accum: DataFrame) -> DataFrame:
    """panel_id, item_id and the four mean scores, null where an item lacks one.

    Rows of one (panel, item, thread) are one row, that of the latest scored_at. Threads add up: a score is the sum of its
    sums over its count, label_accuracy_n for label accuracy, else scored. Threads with a count of null or 0 add nothing to
    that score. A null sum adds nothing; a NaN or infinite one makes the item's score a missing one. Items whose trust,
    continuity and preservation are all missing don't count. Rows without panel_id or item_id are left out. Sums are taken
    in decimals relative to the item's own largest thread, whatever the scale, so they don't depend on the order of the rows;
    what lies DIGITS digits below that thread is rounded.
    """
    sums = {"trust": "trust_sum", "continuity": "continuity_sum", "preservation": "preservation_sum", "label_accuracy": "label_accuracy_sum"}
    counts = {s: "label_accuracy_n" if s == "label_accuracy" else "scored" for s in SCORES}
    cols = ["panel_id", "item_id", "thread_id", "scored_at", "scored", "label_accuracy_n", *sums.values()]
    rows = accum.select(*cols).where("panel_id IS NOT NULL AND item_id IS NOT NULL")
    w = Window.partitionBy("panel_id", "item_id", "thread_id").orderBy(F.col("scored_at").desc_nulls_last(), F.xxhash64(*cols))
    rows = cut(rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n"), "threads")
    item = ["panel_id", "item_id"]
    used = {s: (F.col(counts[s]) > 0) & F.col(sums[s]).isNotNull() for s in SCORES}
    finite = {s: used[s] & ~F.isnan(F.col(sums[s])) & (F.abs(F.col(sums[s])) < float("inf")) for s in SCORES}
    top = rows.groupBy(*item).agg(*[F.max(F.when(finite[s], _exponent(F.col(sums[s])))).alias(f"_{s}_top") for s in SCORES])
    parts = []
    for s in SCORES:
        parts += [
            F.sum(F.when(finite[s], _shifted(F.col(sums[s]), F.lit(DIGITS) - F.col(f"_{s}_top")))).alias(f"_{s}"),
            F.max(f"_{s}_top").alias(f"_{s}_top"),
            F.sum(F.when(used[s], F.col(counts[s]).cast("bigint")).otherwise(0)).alias(f"_{s}_n"),
            F.max(F.when(used[s] & ~finite[s], 1).otherwise(0)).alias(f"_{s}_bad"),
        ]
    added = rows.join(top, item).groupBy(*item).agg(*parts)
    total = lambda s: F.coalesce(F.concat(F.col(f"_{s}").cast("string"), F.lit("E"), F.col(f"_{s}_top") - DIGITS).cast("double"), F.lit(0.0))
    mean = lambda s: F.when((F.col(f"_{s}_n") > 0) & (F.col(f"_{s}_bad") == 0), total(s) / F.col(f"_{s}_n")).alias(s)
    return added.select(*item, *[mean(s) for s in SCORES]).where("trust IS NOT NULL OR continuity IS NOT NULL OR preservation IS NOT NULL")


def places(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """``df`` with the place of each row in its group by ``value``, the highest first; equal values share the least place.

    Equal values are counted before they are put in order, and the order is made over ranges, so neither a hot group nor a
    hot value is held by one task.
    """
    keys = [*group, value]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    before = summed_before(counts, group, [F.col(value).desc()], "_c", "_before")
    return df.join(before.select(*keys, (F.col("_before") + 1).alias(out)), keys)


def fused(scores: DataFrame, names: Sequence[str] = SCORES, weights: dict[str, float] | None = None) -> DataFrame:
    """panel_id, item_id, median_rank, mean_rank, n_scores: the weighted median and mean of an item's positions.

    In each score the items that have it are placed, the highest first, equal ones at the same place. The weighted
    median is the least position at which half the weight is reached. A score an item lacks is left out of both.
    """
    weights = weights or {}
    stacked = ", ".join(f"'{n}', double(`{n}`), double({weights.get(n, 1.0)})" for n in names)
    long = scores.selectExpr("panel_id", "item_id", f"stack({len(names)}, {stacked}) AS (score_name, score, weight)").where("score IS NOT NULL AND weight > 0")
    placed = places(cut(long, "scores-long"), ["panel_id", "score_name"], "score", "place")
    half = F.aggregate("_all", F.lit(0.0), lambda a, s: a + s["weight"]) / 2
    walk = F.aggregate(
        "_all",
        F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("bigint").alias("at")),
        lambda a, s: F.struct((a["seen"] + s["weight"]).alias("seen"), F.when(a["at"].isNull() & (a["seen"] + s["weight"] >= F.col("_half")), s["place"]).otherwise(a["at"]).alias("at")),
    )
    # one entry per score, so the lists are as short as the list of names
    grouped = placed.groupBy("panel_id", "item_id").agg(F.sort_array(F.collect_list(F.struct(F.col("place").cast("bigint").alias("place"), "weight"))).alias("_all"), F.avg("place").alias("mean_rank"), F.count(F.lit(1)).alias("n_scores"))
    return grouped.withColumn("_half", half).select("panel_id", "item_id", walk["at"].cast("double").alias("median_rank"), "mean_rank", "n_scores")


def ranking(accum: DataFrame, by: str = "median") -> DataFrame:
    """panel_id, item_id, position, median_rank, mean_rank, n_scores of every item that counts.

    Ordered by the median rank, then the mean rank, then item_id; with ``by="mean"`` by the mean, then the median.
    """
    first, second = ("median_rank", "mean_rank") if by == "median" else ("mean_rank", "median_rank")
    items = fused(cut(item_scores(accum), "item-scores")).withColumn("_one", F.lit(1).cast("bigint"))
    placed = summed_before(items, ["panel_id"], [first, second, "item_id"], "_one", "_before")
    return placed.select("panel_id", "item_id", (F.col("_before") + 1).alias("position"), "median_rank", "mean_rank", "n_scores")
