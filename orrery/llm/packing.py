"""Problem 8: filling containers of fixed capacity with texts, best two fit."""

from __future__ import annotations

import math
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.token_ids import TOKENIZERS, token_counts
from orrery.plans.cut import cut
from orrery.plans.sizing import heavy_partitions

#: Texts that one task packs. Each such share leaves at most one container badly filled.
SHARE_ROWS = 20_000


class _Stock:
    """Items by size: which sizes are left, in order, and how many items of each."""

    def __init__(self, sizes: np.ndarray):
        values, counts = np.unique(sizes, return_counts=True)
        self.left = dict(zip(values.tolist(), counts.tolist(), strict=True))
        self.sizes = values.tolist()

    def take(self, size: int) -> None:
        self.left[size] -= 1
        if not self.left[size]:
            self.sizes.pop(bisect_right(self.sizes, size) - 1)

    def give(self, size: int) -> None:
        if not self.left.get(size):
            insort(self.sizes, size)
            self.left[size] = 0
        self.left[size] += 1

    def two(self, room: int, more_than: int) -> tuple[int, int] | None:
        """The two items of the greatest sum that fits into ``room`` and is more than ``more_than``."""
        lo, hi, best, found = 0, bisect_right(self.sizes, room) - 1, more_than, None
        while lo <= hi and best < room:
            a, b = self.sizes[lo], self.sizes[hi]
            if a + b > room or (lo == hi and self.left[a] < 2):
                hi -= 1
                continue
            if a + b > best:
                best, found = a + b, (b, a)
            lo += 1
        return found


def best_two_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers, as lists of sizes, for items of 1..capacity.

    A container is filled greedily with the largest item that still fits. If room is left, its smallest item gives way to
    two unpacked ones that fill the room and its place more tightly, if there are such.
    """
    stock, bins = _Stock(sizes), []
    while stock.sizes:
        held, room = [], capacity
        while (i := bisect_right(stock.sizes, room) - 1) >= 0:
            size = stock.sizes[i]
            stock.take(size)
            held.append(size)
            room -= size
        if room and stock.sizes:
            small = held[-1]
            if pair := stock.two(room + small, small):
                held.pop()
                for size in pair:
                    stock.take(size)
                stock.give(small)
                held.extend(pair)
        bins.append(held)
    return bins


OUT = "plan_name string, capacity int, container_id bigint, doc_id bigint, part_no int, n_tokens int"


def _pack_share(key, t):
    name, share, capacity = key[0].as_py(), key[1].as_py(), t["capacity"][0].as_py()
    doc, size, part = (t[c].to_numpy() for c in ("doc_id", "n_tokens", "part_no"))
    order = np.lexsort((part, doc, size))
    doc, size, part = doc[order], size[order], part[order]
    where = np.zeros(len(doc), np.int64)
    solid = np.flatnonzero((size > 0) & (size < capacity))
    full = np.flatnonzero(size == capacity)
    bins = best_two_fit(size[solid], capacity) if len(solid) else []
    # the items of one size are handed out in order of doc_id
    values, start = np.unique(size[solid], return_index=True)
    following = dict(zip(values.tolist(), start.tolist(), strict=True))
    for n, held in enumerate(bins):
        for s in held:
            where[solid[following[s]]] = n
            following[s] += 1
    where[full] = len(bins) + np.arange(len(full))
    return pa.table(
        {"plan_name": pa.array([name] * len(doc)), "capacity": pa.array(np.full(len(doc), capacity, np.int32)), "container_id": pa.array(where + (np.int64(share) << 32)), "doc_id": pa.array(doc), "part_no": pa.array(part.astype(np.int32)), "n_tokens": pa.array(size.astype(np.int32))}
    )


def pack(documents: DataFrame, plans: DataFrame, folder: str = TOKENIZERS, share_rows: int = SHARE_ROWS) -> DataFrame:
    """plan_name, capacity, container_id, doc_id, part_no, n_tokens: for every plan a place for every text.

    Sizes are tokens of the plan's tokenizer. A text is split only if it alone exceeds the capacity: into parts that each
    fill a container, and a rest that is packed like any other text (parts are numbered from 0 in reading order). Null and
    empty texts have 0 tokens and lie in the first container of their share. Rows without doc_id are left out; a repeated
    doc_id is packed as often as it comes. Plans without a name, tokenizer or positive capacity are left out. Plans are
    a table of settings, read by the driver; documents are hashed into shares of about ``share_rows`` that are packed
    side by side, so the work stays linear and containers never depend on other shares.
    """
    spark = documents.sparkSession
    settings = [r for r in plans.select("plan_name", "capacity", "tokenizer").distinct().collect() if r.plan_name is not None and r.tokenizer and (r.capacity or 0) > 0]
    if not settings:
        return spark.createDataFrame([], OUT)
    counts = None
    for tokenizer in sorted({r.tokenizer for r in settings}):
        mine = [F.struct(F.lit(r.plan_name).alias("plan_name"), F.lit(int(r.capacity)).alias("capacity")) for r in settings if r.tokenizer == tokenizer]
        sized = token_counts(documents.where("doc_id IS NOT NULL"), tokenizer, folder).withColumn("plan", F.explode(F.array(*mine)))
        counts = sized if counts is None else counts.unionByName(sized)
    sized = cut(counts.select("plan.plan_name", "plan.capacity", "doc_id", "n_tokens"), "sizes")
    shares = max(1, math.ceil(sized.count() / len(settings) / share_rows))
    whole, rest = F.floor(F.col("n_tokens") / F.col("capacity")).cast("int"), F.col("n_tokens") % F.col("capacity")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")).cast("int") - 1, F.lit(0))), lambda i: F.struct(i.alias("part_no"), F.when(i < whole, F.col("capacity")).otherwise(rest).alias("n_tokens")))
    items = sized.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(shares)).cast("int")).select("plan_name", "share", "capacity", "doc_id", F.explode(parts).alias("p")).select("plan_name", "share", "capacity", "doc_id", "p.part_no", "p.n_tokens")
    return items.repartition(heavy_partitions(spark, 2 * shares * len(settings)), "plan_name", "share").groupBy("plan_name", "share").applyInArrow(_pack_share, OUT)


def fill(packed: DataFrame) -> DataFrame:
    """plan_name, capacity, containers, texts, tokens, unused, fill: how well each plan's containers are used."""
    per = packed.groupBy("plan_name", "capacity", "container_id").agg(F.sum("n_tokens").alias("held"), F.count(F.when(F.col("part_no") == 0, 1)).alias("texts"))
    out = per.groupBy("plan_name", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("texts").alias("texts"), F.sum("held").alias("tokens"))
    room = F.col("containers") * F.col("capacity")
    return out.select("plan_name", "capacity", "containers", "texts", "tokens", (room - F.col("tokens")).alias("unused"), F.round(F.col("tokens") / room, 6).alias("fill"))
