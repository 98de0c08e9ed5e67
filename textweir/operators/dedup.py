"""Duplicate removal: exact, MinHash banding, connected components and greedy selection.

Buckets are never expanded into pairs: components link each member to its bucket's
smallest id, and the greedy rule is decided bucket by bucket.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweir.functions import text as T
from textweir.session import cut

_GAPS = re.compile(r"\s+")
PRIME = 4294967291  # the largest below 2**32


def normalised(c: Column) -> Column:
    """Stripped, lower-cased, white space collapsed."""
    return T.collapse(F.lower(T.strip(c)))


def exact_survivors(df: DataFrame, id_col: str, text_col: str, least: int = 10) -> DataFrame:
    """(id, sha) of the first row, by id, of each normalised text; texts under ``least`` characters are dropped as duplicates.

    An aggregate by hash, so equal texts meet already before the shuffle.
    """
    t = T.text_or_empty(text_col)
    return (
        df.filter(F.length(T.strip(t)) >= least)
        .groupBy(F.sha2(normalised(t), 256).alias("sha"))
        .agg(F.min(id_col).alias(id_col))
        .select(id_col, "sha")
    )


def dedup_ratio(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kept = exact_survivors(df, id_col, text_col).agg(F.count(F.lit(1)).alias("unique_rows"))
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    return total.join(kept).select("total_rows", "unique_rows", F.round(F.coalesce(F.try_divide("unique_rows", "total_rows"), F.lit(0.0)), 6).alias("unique_ratio"))


def word_ngrams(n: int) -> Callable[[str], Iterable[str]]:
    """Distinct runs of ``n`` words of the lower-cased text; none for shorter texts."""

    def run(text: str) -> Iterable[str]:
        w = text.lower().split()
        return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}

    return run


def words_and_trigrams(text: str) -> Iterable[str]:
    """Words longer than two characters and all character trigrams of the normalised text."""
    t = _GAPS.sub(" ", text.strip().lower())
    return {w for w in t.split() if len(w) > 2} | {t[i : i + 3] for i in range(len(t) - 2)}


@dataclass(frozen=True)
class Banding:
    bands: int = 25
    rows: int = 5
    #: Values of the signature; more than bands times rows are computed where given.
    permutations: int = 128

    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        """Multipliers and offsets by rule, the same in SQL: ((j 2654435761 + 1) mod 2**30, (j 40503 + 7) mod 2**30)."""
        j = np.arange(1, self.permutations + 1, dtype=np.uint64)
        return (j * np.uint64(2654435761) + np.uint64(1)) % np.uint64(2**30), (j * np.uint64(40503) + np.uint64(7)) % np.uint64(2**30)


#: Bands and rows that balance false positives and negatives of 128 values at thresholds 0.5 and 0.8.
AT_05, AT_08 = Banding(25, 5), Banding(9, 13)


def _signatures(banding: Banding, shingles: Callable[[str], Iterable[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = banding.coefficients()
        known: dict[str, int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out = np.full((batch.num_rows, banding.permutations), PRIME, dtype=np.int64)
                for i, text in enumerate(batch.column(1).to_pylist()):
                    items = shingles(text) if text else ()
                    if not items:
                        continue
                    if len(known) > 500_000:
                        known.clear()
                    for x in items:
                        if x not in known:
                            known[x] = int(hashlib.md5(x.encode()).hexdigest()[:8], 16)
                    low = np.full(banding.permutations, PRIME, dtype=np.uint64)
                    base = np.fromiter((known[x] for x in items), dtype=np.uint64, count=len(items))
                    for j in range(0, len(base), 4096):  # long texts in parts, so that memory stays bounded
                        low = np.minimum(low, ((base[j : j + 4096, None] * a + b) % np.uint64(PRIME)).min(0))
                    out[i] = low.astype(np.int64)
                offsets = np.arange(0, out.size + 1, banding.permutations, dtype=np.int32)
                yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))], names=["id", "signature"])

    return run


def signatures(df: DataFrame, id_col: str, text_col: str, shingles: Callable[[str], Iterable[str]], banding: Banding = AT_05) -> DataFrame:
    """(id, signature): MinHash values of a text's shingles; an empty set, a null text's too, has the prime everywhere."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_signatures(banding, shingles), "id long, signature array<long>")


def band_buckets(signed: DataFrame, banding: Banding, short_docs: str = "collapse") -> DataFrame:
    """(bucket, id): the band keys of each signature.

    Empty sets all share one signature. ``collapse`` keeps that in a single bucket,
    ``keep`` leaves them without any, so that they match nothing.
    """
    empty = F.col("signature")[0] == PRIME
    if short_docs == "keep":
        signed = signed.filter(~empty)
    bands = F.array(*[F.xxhash64(F.lit(i), F.slice("signature", i * banding.rows + 1, banding.rows)) for i in range(banding.bands)])
    keys = F.when(empty, F.slice(bands, 1, 1)).otherwise(bands)
    return signed.select("id", F.explode(keys).alias("bucket")).select("bucket", "id")


def bucket_stars(buckets: DataFrame) -> DataFrame:
    """(src, dst): each member of a bucket with its smallest one; the same components as all its pairs have."""
    lowest = buckets.groupBy("bucket").agg(F.min("id").alias("dst"), F.max("id").alias("_top")).filter("_top > dst").select("bucket", "dst")
    return buckets.join(lowest, "bucket").filter("id > dst").select(F.col("id").alias("src"), "dst").distinct()


def components(nodes: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, component): the smallest id that each node is connected with.

    Each round a node takes the smallest label among its neighbours and then the label of
    that label, so that the number of rounds grows with the logarithm of the
    longest path. Only nodes with an edge take part; each round is checkpointed.
    """
    both = cut(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(edges.select("dst", "src")).filter("u <> v").distinct())
    labels = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("n"), F.least("u", "low").alias("c"), F.lit(True).alias("moved"))
    while True:
        labels = cut(labels)
        if labels.filter("moved").isEmpty():
            break
        near = both.join(labels.select(F.col("n").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("low"))
        took = labels.join(near, F.col("n") == F.col("u")).select("n", F.col("c").alias("old"), F.least("c", "low").alias("c"))
        jump = labels.select(F.col("n").alias("via"), F.col("c").alias("far"))
        labels = took.join(jump, took["c"] == jump["via"], "left").select("n", F.least("c", "far").alias("c"), "old").select("n", "c", (F.col("c") < F.col("old")).alias("moved"))
    found = labels.select(F.col("n").alias("id"), F.col("c").alias("component"))
    return nodes.select(F.col(id_col).alias("id")).join(found, "id", "left").select(F.col("id").alias(id_col), F.coalesce("component", "id").alias("component"))


def component_survivors(nodes: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """The lowest id of each component."""
    return components(nodes, edges, id_col).filter(F.col("component") == F.col(id_col)).select(id_col)


def greedy_survivors(nodes: DataFrame, buckets: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids kept by going through them in order and dropping each that shares a bucket with a kept one.

    Exact, by rounds: an undecided id that is the lowest undecided one in all its buckets
    is kept; members of a bucket with a kept one are dropped. No pair is ever formed.
    """
    crowded = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    open_rows = cut(buckets.join(crowded, "bucket", "left_semi"))
    dropped: list[DataFrame] = []
    while not open_rows.isEmpty():
        lowest = open_rows.groupBy("bucket").agg(F.min("id").alias("low"))
        seen = open_rows.join(lowest, "bucket")
        verdict = seen.groupBy("id").agg(F.bool_and(F.col("id") == F.col("low")).alias("keep"))
        kept = verdict.filter("keep").select("id")
        hit = open_rows.join(kept, "id", "left_semi").select("bucket").distinct()
        gone = cut(open_rows.join(hit, "bucket", "left_semi").select("id").distinct().join(kept, "id", "left_anti"))
        dropped.append(gone)
        decided = kept.union(gone).distinct()
        open_rows = cut(open_rows.join(decided, "id", "left_anti").join(hit, "bucket", "left_anti"))
    every = nodes.select(F.col(id_col).alias("id"))
    return (every.join(reduce(DataFrame.union, dropped), "id", "left_anti") if dropped else every).withColumnRenamed("id", id_col)
