"""Filling containers of fixed capacity with items, by hierarchical residual packing.

Each partition packs its own items best-fit, largest first. Containers that are
nearly full are done; the rest become items themselves and are packed again, best-fit,
over ever fewer partitions (a tree), until all have met in one or no two of them fit together,
as where every item fills over half a container. An item larger
than a container fills whole containers of its own and leaves a remainder, which is packed
like any other item; nothing else is split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweir.session import cut


@dataclass(frozen=True)
class PackSpec:
    capacity: int = 2048
    #: A container at least this full is done.
    nearly_full: float = 0.995
    #: Items that one task packs at a time; bounds its memory.
    items_a_task: int = 200_000
    #: How many partitions' leftovers meet in one of the next round's.
    fan_in: int = 8


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best fit, largest first: the bin of each item and the fill of each bin.

    Bins are kept by room left; one integer has a bit for each room that some bin has,
    so the tightest bin that takes an item is found by a shift.
    """
    order = np.argsort(-sizes, kind="stable")
    bins = np.empty(len(sizes), dtype=np.int64)
    by_room: dict[int, list[int]] = {}
    rooms, fills = 0, []
    for i in order.tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            held = by_room[room]
            b = held.pop()
            if not held:
                rooms ^= 1 << room
                del by_room[room]
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        fills[b] += size
        bins[i] = b
        left = room - size
        if left:
            by_room.setdefault(left, []).append(b)
            rooms |= 1 << left
    return bins, np.array(fills, dtype=np.int64)


def _pack_partition(spec: PackSpec, level: int):
    """(item, size) -> (item, size, bin, fill, first): ``first`` marks one row of each bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (level << 56) | ((TaskContext.get().partitionId() & 0xFFFFFF) << 32)
        made = 0
        items: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            nonlocal made
            item, size = np.concatenate(items), np.concatenate(sizes)
            order = np.lexsort((item, -size))
            item, size = item[order], size[order]
            bins, fills = best_fit(size, spec.capacity)
            _, firsts = np.unique(bins, return_index=True)
            first = np.zeros(len(item), dtype=bool)
            first[firsts] = True
            out = [pa.array(item), pa.array(size), pa.array(base + made + bins), pa.array(fills[bins]), pa.array(first)]
            made += len(fills)
            items.clear()
            sizes.clear()
            return pa.record_batch(out, names=["item", "size", "bin", "fill", "first"])

        for batch in batches:
            items.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            sizes.append(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
            if sum(map(len, items)) >= spec.items_a_task:
                yield packed()
        if items:
            yield packed()

    return run


_DDL = "item long, size long, bin long, fill long, first boolean"


def _mergeable(bins: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """The containers that the smallest one fits into, and their number; no other can be merged."""
    smallest = bins.agg(F.min("fill")).first()[0]
    if smallest is None or 2 * smallest > capacity:
        return bins, 0
    some = bins.filter(F.col("fill") + smallest <= capacity)
    return some, some.count()


def pack(df: DataFrame, id_col: str, size_col: str, spec: PackSpec = PackSpec()) -> DataFrame:
    """(id, part, size, container) of every part of every row; ``fill`` is the container's total.

    ``part`` is 0 but for rows larger than a container, which have one part for each full
    container and one for the remainder. Rows of size 0, null or below have one part of size
    0 and a null container. Repeated rows are packed once each. Other columns are ignored.
    """
    c = spec.capacity
    rows = df.select(F.monotonically_increasing_id().alias("_uid"), F.col(id_col).alias("_id"), F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("long").alias("_size"))
    rows = cut(rows)
    whole = (F.col("_size") / c).cast("long")
    full = F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), lambda i: F.struct(i.cast("int").alias("part"), F.lit(c).cast("long").alias("size"))))
    rest = F.col("_size") % c
    last = F.when((rest > 0) | (F.col("_size") == 0), F.array(F.struct(whole.cast("int").alias("part"), rest.alias("size"))))
    none = F.array().cast("array<struct<part: int, size: bigint>>")
    parts = rows.select("_uid", "_id", F.explode(F.concat(F.coalesce(full, none), F.coalesce(last, none))).alias("p")).select("_uid", "_id", "p.part", "p.size")

    small = parts.filter((F.col("size") > 0) & (F.col("size") < c)).select(F.col("_uid").alias("item"), "size")
    spark = df.sparkSession
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    first = cut(small.repartition(width, "item").mapInArrow(_pack_partition(spec, 1), _DDL))
    least = int(np.ceil(spec.nearly_full * c))
    merged, level, met = None, 1, False
    open_bins, left = _mergeable(first.filter(F.col("first") & (F.col("fill") < least)), c)
    # The smallest container fits into all others, so that each round leaves fewer.
    while left > 1 and not met:
        # No task gets more than it can pack at a time.
        level, width = level + 1, max(-(-width // spec.fan_in), -(-left // spec.items_a_task))
        met = width == 1
        now = cut(open_bins.select("bin", "fill").repartition(width, "bin").mapInArrow(_pack_partition(spec, level), _DDL))
        step = now.select(F.col("item").alias("_from"), F.col("bin").alias("_to"), F.col("fill").alias("_fill"))
        if merged is None:
            merged = step
        else:
            again = step.select(F.col("_from").alias("_mid"), F.col("_to").alias("_to2"), F.col("_fill").alias("_fill2"))
            merged = merged.join(again, merged["_to"] == again["_mid"], "left").select("_from", F.coalesce("_to2", "_to").alias("_to"), F.coalesce("_fill2", "_fill").alias("_fill"))
        open_bins, left = _mergeable(now.filter(F.col("first") & (F.col("fill") < least)), c)
    placed = first.select(F.col("item").alias("_uid"), "bin", "fill")
    if merged is not None:
        placed = placed.join(merged, placed["bin"] == merged["_from"], "left").select("_uid", F.coalesce("_to", "bin").alias("bin"), F.coalesce("_fill", "fill").alias("fill"))

    own = parts.filter((F.col("size") == 0) | (F.col("size") == c))
    # A full part has a container to itself, numbered apart from the packed ones.
    alone = own.select("_id", "part", "size", F.when(F.col("size") > 0, -1 - F.xxhash64("_uid", "part").bitwiseAND(2**62 - 1)).alias("container"), F.when(F.col("size") > 0, F.col("size")).alias("fill"))
    rest_rows = parts.filter((F.col("size") > 0) & (F.col("size") < c)).join(placed, "_uid").select("_id", "part", "size", F.col("bin").alias("container"), "fill")
    return rest_rows.union(alone).withColumnRenamed("_id", id_col)
