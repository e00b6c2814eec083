"""Problem 2: percentiles per group by radix selection, and digests of days or files that can be combined.

A finite double becomes an order-preserving bigint. Selection histograms its leading digit per group, finds the digit
that holds each target rank, and then looks only at values below that digit, until the value is exact. A digest is the
histogram of the leading bits; digests add up, and a percentile read from one is off by at most 2**-(52 - shift) of
itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.ordering import from_ordered_bits, ordered_bits
from orrery.plans.cut import cut

#: Bits below each pass's digit: sign, exponent and 6 bits of mantissa first, then 14, 16 and 16 bits.
SHIFTS = (46, 32, 16, 0)
#: A digest keeps 16 bits of the mantissa: percentiles read from it are right to 1 in 65536.
DIGEST_SHIFT = 36
PERMILLE = (500, 900, 950, 990)


def measures(runs: DataFrame) -> DataFrame:
    """run_id, dataset, implementation, day, measure_name, value of the runs that count.

    A run_id counts once, with its latest loaded_at. Only status success, a non-null implementation and finite values
    above 0 count; a run without run_id can't be told from its repeats and is left out. A null dataset is a group.
    """
    cols = ["run_id", "dataset", "implementation", "run_at", "loaded_at", "status", "embedding_time_sec", "total_time_sec"]
    once = (
        runs.select(*cols)
        .where("run_id IS NOT NULL")
        .withColumn("_n", F.row_number().over(Window.partitionBy("run_id").orderBy(F.col("loaded_at").desc_nulls_last(), F.xxhash64(*cols))))
        .where("_n = 1 AND status = 'success' AND implementation IS NOT NULL")
    )
    long = once.selectExpr("run_id", "dataset", "implementation", "to_date(run_at) AS day", "stack(2, 'embedding_time_sec', embedding_time_sec, 'total_time_sec', total_time_sec) AS (measure_name, value)")
    return long.where((F.col("value") > 0) & (F.col("value") < float("inf")))


def _matches(keys: Sequence[str], left: str, right: str):
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return on


def radix_percentiles(values: DataFrame, keys: Sequence[str], value: str = "value", permille: Sequence[int] = PERMILLE, shifts: Sequence[int] = SHIFTS) -> DataFrame:
    """keys, permille, n, value, low, high: for each group the value of rank ceil(n * permille / 1000), from 1.

    ``low`` and ``high`` bound the value: they differ by less than 2**-(52 - last shift) of it, and are equal if the
    last shift is 0. Null, NaN and infinite values don't count; a group without values has no row; null keys are groups.

    Each pass shuffles histogram rows only (combined before the shuffle), so a group with a third of all values costs
    at most one row per digit and task.
    """
    keys = list(keys)
    # the integers are worked out once and written; every pass reads them
    coded = cut(values.select(*keys, ordered_bits(F.col(value)).alias("_key")).where("_key IS NOT NULL"), "radix-keys")
    state = None
    for i, shift in enumerate(shifts):
        digit = F.shiftright("_key", shift)
        if state is None:
            hist = coded.select(*keys, digit.alias("_digit")).groupBy(*keys, "_digit").agg(F.count(F.lit(1)).alias("_c"))
            hist = cut(hist, "radix")
            n = hist.groupBy(*keys).agg(F.sum("_c").alias("n"))
            targets = n.withColumn("permille", F.explode(F.array(*[F.lit(int(q)) for q in permille]))).withColumn("_rank", F.greatest(F.lit(1), F.expr("(n * permille + 999) div 1000")))
            paired = targets.alias("t").join(hist.alias("h"), _matches(keys, "t", "h"))
        else:
            wanted = state.select(*keys, "_prefix").distinct()
            below = coded.withColumn("_prefix", F.shiftright("_key", shifts[i - 1]))
            inside = below.alias("v").join(wanted.alias("w"), _matches([*keys, "_prefix"], "v", "w"), "left_semi")
            hist = inside.select(*keys, "_prefix", digit.alias("_digit")).groupBy(*keys, "_prefix", "_digit").agg(F.count(F.lit(1)).alias("_c"))
            paired = state.alias("t").join(hist.alias("h"), _matches([*keys, "_prefix"], "t", "h"))
        paired = paired.select(*[F.col(f"t.{k}").alias(k) for k in keys], "t.n", "t.permille", "t._rank", "h._digit", "h._c")
        w = Window.partitionBy(*keys, "permille").orderBy("_digit")
        cumulated = paired.withColumn("_upto", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        chosen = cumulated.where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_c") < F.col("_rank")))
        state = cut(chosen.select(*keys, "n", "permille", (F.col("_rank") - (F.col("_upto") - F.col("_c"))).alias("_rank"), F.col("_digit").alias("_prefix")), "radix")
    last = shifts[-1]
    base = F.shiftleft("_prefix", last)
    low, high = from_ordered_bits(base), from_ordered_bits(base + F.lit((1 << last) - 1))
    return state.select(*keys, "permille", "n", high.alias("value"), low.alias("low"), high.alias("high"))


def digest(values: DataFrame, keys: Sequence[str], value: str = "value", shift: int = DIGEST_SHIFT) -> DataFrame:
    """keys, bucket, n: the mergeable summary of the values of each group (add a day or file to the keys)."""
    coded = values.select(*keys, F.shiftright(ordered_bits(F.col(value)), shift).alias("bucket")).where("bucket IS NOT NULL")
    return coded.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge_digests(digests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One digest of several: counts of equal buckets add up."""
    return digests.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def digest_percentiles(merged: DataFrame, keys: Sequence[str], permille: Sequence[int] = PERMILLE, shift: int = DIGEST_SHIFT) -> DataFrame:
    """keys, permille, n, low, high: bounds of each percentile of a merged digest."""
    w = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = merged.withColumn("_upto", F.sum("n").over(w)).withColumn("_all", F.sum("n").over(whole))
    ranked = upto.withColumn("permille", F.explode(F.array(*[F.lit(int(q)) for q in permille]))).withColumn("_rank", F.greatest(F.lit(1), F.expr("(_all * permille + 999) div 1000")))
    base = F.shiftleft("bucket", shift)
    chosen = ranked.where("_upto >= _rank AND _upto - n < _rank")
    return chosen.select(*keys, "permille", F.col("_all").alias("n"), from_ordered_bits(base).alias("low"), from_ordered_bits(base + F.lit((1 << shift) - 1)).alias("high"))


GROUP = ["dataset", "implementation", "measure_name"]


def slow_runs(runs: DataFrame, permille: int = 950, times: float = 3.0) -> DataFrame:
    """run_id, measure_name of the runs above ``times`` the percentile of their group."""
    values = cut(measures(runs), "run-measures")
    limit = radix_percentiles(values, GROUP, permille=[permille]).select(*GROUP, (F.col("value") * times).alias("_limit"))
    over = values.alias("v").join(limit.alias("l"), _matches(GROUP, "v", "l"))
    return over.where("v.value > l._limit").select("v.run_id", "v.measure_name")
