"""Training examples: labels by score, weighted category scorers, negatives, observed pipelines."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def labelled_examples(df: DataFrame, group: str, score: str, least: int = 10) -> DataFrame:
    """Adds ``label``: 1 for scores over 0.7, 0 under 0.3; other rows go, and groups of fewer than ``least`` examples."""
    s = F.col(score)
    label = F.when(s > 0.7, 1).when((s < 0.3) & (1 - s > 0.7), 0).cast("long")
    rows = df.withColumn("label", label).filter("label is not null")
    enough = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(group)
    return rows.join(enough, group, "left_semi")


def weighted_best(scores: Mapping[str, Column], weights: Mapping[str, float], least: float = 0.5) -> Column:
    """(overall, best, keep): mean of the weighted scores, the category of the highest, ties in order."""
    weighted = {k: c * F.lit(float(weights.get(k, 1.0))) for k, c in scores.items()}
    top = F.greatest(*weighted.values())
    best = F.lit(None).cast("string")
    for k, c in reversed(list(weighted.items())):
        best = F.when(c == top, k).otherwise(best)
    overall = sum(weighted.values(), F.lit(0.0)) / len(weighted)
    return F.struct(overall.alias("overall"), best.alias("best"), (overall > least).alias("keep"))


def improvement_weight(mean: Column) -> Column:
    """More weight for categories with a lower mean score."""
    return F.lit(1.0) + (F.lit(1.0) - mean)


def with_negative(df: DataFrame, id_col: str, bucket_rows: int = 1000) -> DataFrame:
    """(id, negative_id): for each row another one, fixed by hashes of the ids.

    Rows are dealt into buckets by hash and each takes the next of its bucket, the last one the
    first; so no row gets itself and nothing is ordered as a whole. A row alone in its bucket has none.
    """
    digest = F.md5(F.col(id_col).cast("string"))
    buckets = max(1, df.count() // bucket_rows)
    rows = df.select(F.col(id_col).alias("id"), digest.alias("h"), F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(buckets)).alias("b"))
    w = Window.partitionBy("b").orderBy("h", "id")
    other = F.coalesce(F.lead("id").over(w), F.first("id").over(Window.partitionBy("b").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select(F.col("id").alias(id_col), F.when(other != F.col("id"), other).alias("negative_id"))


def observed(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` with metrics collected while it runs: rows, and what is asked for, without another pass."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows"), *metrics), o
