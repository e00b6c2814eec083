"""Looking back in ordered groups without holding a group in one task.

Rows are range-partitioned by group and order, so a hot group is spread over many tasks. Each task looks back within its range;
what lies before a range comes from a small table: a group in several ranges has one row for each range but its first, so there
are fewer such rows than ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.plans.cut import cut

Order = Sequence[Column | str]


def _in_ranges(df: DataFrame, group: Sequence[str], order: Order) -> DataFrame:
    return cut(df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def _earlier(group: Sequence[str]):
    return Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def carried(df: DataFrame, group: Sequence[str], order: Sequence[str], values: dict[str, str], current: bool) -> DataFrame:
    """``df`` with, for each ``value: out`` of ``values``, the last non-null value before the row in its group (at or before
    it with ``current``). Group and order columns must not be null and must tell the rows of a group apart.
    """
    own = [c for c in df.columns if c not in values.values()]
    placed = _in_ranges(df, group, order)
    here = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    ends = placed.groupBy(*group, "_range").agg(*[F.max(F.when(F.col(v).isNotNull(), F.struct(*order, F.col(v).alias("_v"))))["_v"].alias(f"_end_{i}") for i, v in enumerate(values)])
    carry = ends.select(*group, "_range", *[F.last(f"_end_{i}", ignorenulls=True).over(_earlier(group)).alias(f"_carry_{i}") for i in range(len(values))])
    carry = cut(carry.where(" OR ".join(f"_carry_{i} IS NOT NULL" for i in range(len(values)))), "carry")
    near = placed.withColumns({f"_near_{i}": F.last(v, ignorenulls=True).over(here) for i, v in enumerate(values)})
    joined = near.join(carry, [*group, "_range"], "left")
    return joined.select(*own, *[F.coalesce(f"_near_{i}", f"_carry_{i}").alias(out) for i, out in enumerate(values.values())])


def summed_before(df: DataFrame, group: Sequence[str], order: Order, weight: str, out: str) -> DataFrame:
    """``df`` with the sum of ``weight`` (a bigint) over the rows before the row in its group, 0 for the first. Group columns
    must not be null; ``order`` must tell the rows of a group apart."""
    placed = _in_ranges(df, group, order)
    here = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.groupBy(*group, "_range").agg(F.sum(weight).alias("_end"))
    carry = cut(ends.select(*group, "_range", F.sum("_end").over(_earlier(group)).alias("_carry")).where("_carry IS NOT NULL"), "carry")
    before = F.coalesce(F.sum(weight).over(here), F.lit(0)) + F.coalesce("_carry", F.lit(0))
    return placed.join(carry, [*group, "_range"], "left").withColumn(out, before).select(*[c for c in df.columns if c != out], out)


def first_rows(df: DataFrame, order: Order, count: int) -> DataFrame:
    """The first ``count`` rows of ``df`` in an order that tells its rows apart, however many these are: no task holds them."""
    ranked = summed_before(df.withColumns({"_all": F.lit(0), "_one": F.lit(1).cast("bigint")}), ["_all"], order, "_one", "_nth")
    return ranked.where(F.col("_nth") < count).drop("_all", "_one", "_nth")
