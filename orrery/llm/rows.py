"""Which rows of float_matrix hold, and their distinct vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.vectors import all_finite, any_nonzero
from orrery.plans.cut import cut


def latest_rows(matrix: DataFrame) -> DataFrame:
    """The version of each row_id with the latest loaded_at: row_id, dataset, probe, v, usable, k1, k2.

    A version without loaded_at is the oldest; of versions loaded at one time the one with the greater vector hash
    holds. Rows without row_id or dataset are left out (they can be nobody's neighbour). ``usable`` says whether v
    has exactly ncol elements, all finite, none null, not all zero. k1 and k2 are a 128-bit hash of dataset and vector.
    """
    v = F.col("matrix_values")
    order = [F.col("loaded_at").desc_nulls_last(), F.xxhash64("dataset", "matrix_values").desc()]
    newest = (
        matrix.select("row_id", "dataset", "ncol", "probe", "loaded_at", "matrix_values")
        .where(F.col("row_id").isNotNull())
        .withColumn("_nth", F.row_number().over(Window.partitionBy("row_id").orderBy(*order)))
        .where("_nth = 1 AND dataset IS NOT NULL")
    )
    usable = F.coalesce(F.size(v) == F.col("ncol"), F.lit(False)) & all_finite(v) & any_nonzero(v)
    keys = [F.xxhash64("dataset", v).alias("k1"), F.xxhash64(v, F.lit(1), "dataset").alias("k2")]
    return newest.select("row_id", "dataset", F.coalesce("probe", F.lit(False)).alias("probe"), v.alias("v"), usable.alias("usable"), *keys)


def doubles_of(rows: DataFrame) -> DataFrame:
    """row_id, rep, n_copies of the usable rows of :func:`latest_rows` (cut) whose dataset and vector come more than once.

    ``rep`` is the smallest row_id of the copies. Only hashes and numbers are shuffled, and a vector that a third of all rows
    share is counted before the shuffle.
    """
    keyed = rows.where("usable").select("row_id", "k1", "k2")
    shared = keyed.groupBy("k1", "k2").agg(F.min("row_id").alias("rep"), F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")
    return keyed.join(shared, ["k1", "k2"]).select("row_id", "rep", "n_copies")


def points_of(rows: DataFrame, doubles: DataFrame) -> DataFrame:
    """dataset, rep, v, n_copies: one row per distinct vector of the usable rows; ``doubles`` is :func:`doubles_of` (cut)."""
    points = rows.where("usable").select("row_id", "dataset", "v").join(doubles, "row_id", "left").where("rep IS NULL OR rep = row_id")
    return points.select("dataset", F.col("row_id").alias("rep"), "v", F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def copies(rows: DataFrame, keep: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of :func:`latest_rows` (cut) -> (points, owned, multi) of the usable ones.

    points: see :func:`points_of`. owned: row_id, dataset, rep of every row. multi: rep, ids - the ``keep`` smallest row_ids
    of the vectors that have copies; the window that numbers them stops at ``keep`` per task before anything is shuffled.
    """
    doubles = cut(doubles_of(rows), "row-copies")
    owned = rows.where("usable").select("row_id", "dataset").join(doubles.select("row_id", "rep"), "row_id", "left").select("row_id", "dataset", F.coalesce("rep", "row_id").alias("rep"))
    nth = F.row_number().over(Window.partitionBy("rep").orderBy("row_id"))
    few = doubles.select("rep", "row_id").withColumn("_nth", nth).where(F.col("_nth") <= keep)
    multi = few.groupBy("rep").agg(F.sort_array(F.collect_list("row_id")).alias("ids"))
    return points_of(rows, doubles), owned, multi
