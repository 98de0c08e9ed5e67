"""Aggregates and reports over texts, tokens, scores and labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS = ((0, 100, "0-100"), (100, 200, "100-200"), (200, 500, "200-500"), (500, 1000, "500-1k"), (1000, 2000, "1k-2k"), (2000, 3000, "2k-3k"), (3000, None, "3k+"))


def r6(c: Column) -> Column:
    return F.round(c, 6)


def share(a: Column, b: Column) -> Column:
    """a / b to six places, 0 where b is 0."""
    return r6(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)))


def length_stats(df: DataFrame, n: str) -> DataFrame:
    """Valid (over 0) and invalid rows, mean, median, least, most and population deviation of a length."""
    v = F.when(F.col(n) > 0, F.col(n))
    return df.agg(
        F.count(v).alias("valid_records"),
        F.count_if(F.col(n).isNull() | (F.col(n) <= 0)).alias("invalid_records"),
        r6(F.avg(v)).alias("mean_tokens"),
        r6(F.median(v)).alias("median_tokens"),
        F.min(v).cast("long").alias("min_tokens"),
        F.max(v).cast("long").alias("max_tokens"),
        r6(F.stddev_pop(v)).alias("std_tokens"),
    )


def length_histogram(df: DataFrame, n: str) -> DataFrame:
    """(bin, records, percentage) of the lengths over 0; bins are open to the right, but for the last."""
    label = F.lit(None).cast("string")
    for low, high, name in reversed(BINS):
        label = F.when(F.col(n) >= low, F.when(F.lit(high is None) | (F.col(n) < (high or 0)), name).otherwise(label)).otherwise(label)
    counted = df.filter(F.col(n) > 0).groupBy(label.alias("bin")).agg(F.count(F.lit(1)).alias("records"))
    total = F.sum("records").over(Window.partitionBy(F.lit(1)))  # at most seven rows
    return counted.select("bin", "records", r6(F.col("records") / total * 100).alias("percentage"))


def length_quality(df: DataFrame, n: str, shortest: int = 80, longest: int = 3000) -> DataFrame:
    v = F.col(n)
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(v.isNull() | (v <= 0)).alias("empty_records"),
        F.count_if(v > 0).alias("valid_records"),
        F.count_if((v > 0) & (v < shortest)).alias("short_records"),
        F.count_if(v > longest).alias("long_records"),
    )


def group_stats(df: DataFrame, key: str, n: str) -> DataFrame:
    """Count, sum, mean, least, most and population deviation by group; a null group is ``unknown``."""
    return df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias(key)).agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(n).cast("long").alias("total_tokens"),
        r6(F.avg(n)).alias("avg_tokens"),
        F.min(n).cast("long").alias("min_tokens"),
        F.max(n).cast("long").alias("max_tokens"),
        r6(F.stddev_pop(n)).alias("std_tokens"),
    )


def retention(df: DataFrame, n: str, shortest: int, longest: int) -> DataFrame:
    """(total, valid, kept, retention): rows, those with a length over 0, those within the limits, and their percentage of all rows."""
    kept = F.count_if(F.col(n).between(shortest, longest))
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(n) > 0).alias("valid"), kept.alias("kept"), share(kept * 100, F.count(F.lit(1))).alias("retention"))


def looked_up(df: DataFrame, key: str, wanted: Sequence[str]) -> DataFrame:
    """(key, records, error) of the wanted groups; one that isn't there has an error instead of records."""
    k = F.coalesce(F.col(key).cast("string"), F.lit("unknown"))
    held = df.filter(k.isin(list(wanted))).groupBy(k.alias(key)).agg(F.count(F.lit(1)).alias("n"))
    asked = df.sparkSession.createDataFrame([(w,) for w in wanted], f"{key} string")
    missing = F.concat(F.lit("Cluster '"), F.col(key), F.lit("' not found"))
    return asked.join(held, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("records"), F.when(F.col("n").isNull(), missing).alias("error"))


def group_totals(df: DataFrame, key: str, n: str) -> DataFrame:
    k = F.coalesce(F.col(key).cast("string"), F.lit("unknown"))
    return df.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.sum(n).cast("long").alias("total_tokens"),
        F.count_distinct(k).alias("clusters"),
        share(F.sum(n), F.count(F.lit(1))).alias("avg_tokens"),
    )


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, first): groups by their earliest row."""
    return df.groupBy(F.coalesce(F.col(key), F.lit("unknown")).alias(key)).agg(F.min(order).alias("first"))


def score_distribution(df: DataFrame, score: str, keep: str) -> DataFrame:
    s, n = F.col(score), F.count(F.lit(1))
    return df.agg(
        n.alias("total"),
        F.count_if(F.col(keep)).alias("kept"),
        r6(F.avg(s)).alias("mean_score"),
        r6(F.median(s)).alias("median_score"),
        r6(F.stddev_pop(s)).alias("std_score"),
        r6(F.min(s)).alias("min_score"),
        r6(F.max(s)).alias("max_score"),
        share(F.count_if(F.col(keep)) * 100, n).alias("retention"),
    )


def summary_by(df: DataFrame, key: str, value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("records"),
        r6(F.avg(v)).alias("mean"),
        r6(F.stddev_pop(v)).alias("std"),
        r6(F.min(v)).alias("min"),
        r6(F.max(v)).alias("max"),
        r6(F.median(v)).alias("median"),
    )


def distribution(df: DataFrame, labels: str, name: str = "category", none: str | None = None) -> DataFrame:
    """Rows by each element of an array column, and those without any under ``none``."""
    parts = F.when(F.size(labels) > 0, F.col(labels)).otherwise(F.array(F.lit(none))) if none else F.col(labels)
    return df.select(F.explode(parts).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("records"))


def map_totals(df: DataFrame, counts: str) -> DataFrame:
    """(key, total) of a map column's values."""
    return df.select(F.explode(counts).alias("key", "value")).groupBy("key").agg(F.sum("value").cast("long").alias("total"))


def funnel(df: DataFrame, stage: str, stages: Sequence[str]) -> DataFrame:
    """(stage, rejected, cleared): rows that first fail at each stage, and rows still in after it. A null stage passed all.

    One aggregate of a row: a join by stage would push its filter into the stage's expression and compute it again.
    """
    at = F.coalesce(stage, F.lit(""))
    one = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(at == s).alias(f"r{i}") for i, s in enumerate(stages)])
    lost = [F.col(f"r{i}") for i in range(len(stages))]
    rows = [F.struct(F.lit(s).alias("stage"), lost[i].alias("rejected"), (F.col("total") - sum(lost[: i + 1], F.lit(0))).cast("long").alias("cleared")) for i, s in enumerate(stages)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def compare_datasets(parts: Mapping[str, DataFrame], baseline: str, text_col: str = "text") -> DataFrame:
    """Rows, characters and mean length of datasets with retention and compression against a baseline."""
    one = None
    for name, df in parts.items():
        row = df.select(F.lit(name).alias("dataset"), F.length(F.coalesce(text_col, F.lit(""))).alias("n"))
        one = row if one is None else one.unionByName(row)
    stats = one.groupBy("dataset").agg(F.count(F.lit(1)).alias("records"), F.sum("n").cast("long").alias("characters"), F.avg("n").alias("avg"))
    base = stats.filter(F.col("dataset") == baseline).select(F.col("records").alias("base_records"), F.col("avg").alias("base_avg"))
    kept = F.col("records") * F.lit(100.0) / F.col("base_records")
    return stats.join(F.broadcast(base)).select(
        "dataset",
        "records",
        "characters",
        r6(F.col("avg")).alias("avg_length"),
        r6(kept).alias("retention"),
        r6(F.col("avg") / F.col("base_avg")).alias("compression"),
        F.when(kept > 50, "HIGH").when(kept > 25, "MODERATE").otherwise("LOW").alias("focus"),
    )


def readiness(df: DataFrame, category: str, every: Sequence[str], least: int = 100, wanted: int = 1000) -> DataFrame:
    """(category, records, ready, recommended) of every category, present or not."""
    spark = df.sparkSession
    counted = df.groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return (
        spark.createDataFrame([(c,) for c in every], "category string")
        .join(counted, "category", "left")
        .select("category", F.coalesce("n", F.lit(0)).cast("long").alias("records"))
        .select("category", "records", (F.col("records") >= least).alias("ready"), (F.col("records") >= wanted).alias("recommended"))
    )


def binary_metrics(df: DataFrame, truth: str, said: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of a boolean verdict; rows where either is null don't count."""
    t, p = F.col(truth), F.col(said)
    c = df.filter(t.isNotNull() & p.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn")
    )
    tp, fp, fn, n = (F.col(x) for x in ("tp", "fp", "fn", "n"))
    return c.select("n", share(n - fp - fn, n).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def toxicity_report(df: DataFrame) -> DataFrame:
    """One row of counts and conditional means over (is_toxic, confidence, text_length, label, raw_score, n_reasons)."""
    toxic, conf, n = F.col("is_toxic"), F.col("confidence"), F.col("text_length")
    rules = F.coalesce(F.col("n_reasons"), F.lit(0)) > 0
    model = (F.upper(F.trim("label")) == "TOXIC") & (F.col("raw_score") > 0.5)
    bands = {"very_low": conf < 0.3, "low": (conf >= 0.3) & (conf < 0.5), "medium": (conf >= 0.5) & (conf < 0.7), "high": (conf >= 0.7) & (conf < 0.9), "very_high": conf >= 0.9}
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(toxic).alias("toxic"),
        F.count_if(~toxic).alias("safe"),
        share(F.count_if(~toxic), F.count(F.lit(1))).alias("safe_ratio"),
        r6(F.avg(F.when(toxic, conf))).alias("toxic_confidence"),
        r6(F.avg(F.when(~toxic, conf))).alias("safe_confidence"),
        F.min(n).cast("long").alias("min_length"),
        F.max(n).cast("long").alias("max_length"),
        r6(F.avg(n)).alias("avg_length"),
        F.count_if(rules).alias("rule_catches"),
        F.count_if(model).alias("model_catches"),
        F.count_if(rules & model).alias("both_catches"),
        *[F.count_if(c).alias(f"band_{k}") for k, c in bands.items()],
    )


def top_counts(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The k commonest values with their counts, ties by value."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("records")).orderBy(F.desc("records"), key).limit(k)


def ranked_within(df: DataFrame, group: str, score: str, id_col: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), id_col)).cast("long"))


def running_totals(df: DataFrame, id_col: str, flag: str, every: int = 100, blocks_a_span: int = 100_000) -> DataFrame:
    """(block, seen, kept): totals up to the end of each block of ``every`` consecutive ids.

    Blocks are aggregated first and ordered within spans of ``blocks_a_span``; the spans' totals, fewer by that factor, are summed up
    apart and joined back. So no task orders more than a span, or all spans.
    """
    block = F.floor(F.col(id_col) / every).cast("long")
    blocks = df.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag)).alias("k")).withColumn("span", F.floor(F.col("block") / blocks_a_span))
    before = Window.partitionBy(F.lit(1)).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = blocks.groupBy("span").agg(F.sum("n").alias("sn"), F.sum("k").alias("sk")).select("span", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("sn", "sk")])
    w = Window.partitionBy("span").orderBy("block")
    within = blocks.select("span", "block", F.sum("n").over(w).alias("n"), F.sum("k").over(w).alias("k"))
    return within.join(spans, "span").select("block", (F.col("n") + F.col("sn")).cast("long").alias("seen"), (F.col("k") + F.col("sk")).cast("long").alias("kept"))


def conversation_context(df: DataFrame, conv: str, turn: str, text_col: str) -> DataFrame:
    """Adds ``recent`` (the last five turns, this one included) and ``adjustment`` of the quality threshold by its topic."""
    # Words that make a context.
    learning, work = ("learn", "study", "education", "teach", "school"), ("work", "business", "meeting", "project", "office")
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(-4, 0)
    recent = F.array_join(F.collect_list(F.coalesce(text_col, F.lit(""))).over(w), " ")
    low = F.lower("recent")

    def has(ws: Sequence[str]) -> Column:
        out = F.lit(False)
        for x in ws:
            out = out | low.contains(x)
        return out

    return df.withColumn("recent", recent).withColumn("adjustment", F.when(has(learning), -0.1).when(has(work), 0.1).otherwise(0.0))


def _value_at(rows: DataFrame, value: str, rank: int, low: float, high: float, bins: int, most: int) -> float:
    """The value of a rank from 0, by counting in ever narrower bins until one has few distinct values."""
    while True:
        few = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect() if low < high else [(low, rank + 1)]
        if len(few) <= most:
            for v, n in sorted(map(tuple, few)):
                if rank < n:
                    return v
                rank -= n
        width = (high - low) / bins
        bucket = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1))
        for _, n, low, high in sorted(map(tuple, rows.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)), F.min(value), F.max(value)).collect())):
            if rank < n:
                break
            rank -= n
        rows = rows.filter(F.col(value).between(low, high))


def exact_percentile(df: DataFrame, value: str, q: float = 0.5, bins: int = 4096, most: int = 10_000) -> float | None:
    """The interpolated percentile, exact, in passes that hold at most ``bins`` counts or ``most`` distinct values; null and NaN don't count, None without values."""
    rows = df.select(F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull() & ~F.isnan(value))
    n, low, high = rows.agg(F.count(F.lit(1)), F.min(value), F.max(value)).first()
    if not n:
        return None
    place = q * (n - 1)
    first = _value_at(rows, value, int(place), low, high, bins, most)
    part = place - int(place)
    return first if not part else first + part * (_value_at(rows, value, int(place) + 1, low, high, bins, most) - first)


def percentile_filter(df: DataFrame, score: str, q: float = 0.75) -> DataFrame:
    """Rows whose score is at or above the exact percentile."""
    least = exact_percentile(df, score, q)
    return df.filter(F.col(score) >= F.lit(least))


def hash_split(df: DataFrame, id_col: str, parts: int = 10, test: int = 0) -> DataFrame:
    """Adds ``is_test`` by a hash of the id: the same rows whatever the partitions."""
    digit = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("long")
    return df.withColumn("is_test", F.pmod(digit, F.lit(parts)) == test)
