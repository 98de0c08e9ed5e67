"""Writers: JSON lines, numbered shards, CSV, exports by category, vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite", rows_a_file: int = 0) -> None:
    """JSON lines; the commit protocol publishes files whole."""
    w = df.write.mode(mode)
    if rows_a_file:
        w = w.option("maxRecordsPerFile", rows_a_file)
    w.json(path)


def write_shards(df: DataFrame, path: str, shards: int, order: str) -> None:
    """At most ``shards`` files, each a contiguous range of the order column."""
    df.repartitionByRange(shards, order).sortWithinPartitions(order).write.mode("overwrite").json(path)


EXPORT_COLUMNS = ("text", "category", "quality_score", "timestamp")
EXPORT_DEFAULTS = {"text": "", "category": "uncategorized", "quality_score": 0.0, "timestamp": ""}


def export_rows(df: DataFrame) -> DataFrame:
    """The four columns of an export, with defaults for nulls and missing ones."""
    return df.select(*[F.coalesce(F.col(c).cast("double" if c == "quality_score" else "string"), F.lit(EXPORT_DEFAULTS[c])).alias(c) if c in df.columns else F.lit(EXPORT_DEFAULTS[c]).alias(c) for c in EXPORT_COLUMNS])


def write_split(df: DataFrame, flag: str, path: str) -> None:
    """Rows into two folders by a boolean column, in one pass."""
    df.write.mode("overwrite").partitionBy(flag).json(path)


def write_run(df: DataFrame, path: str, run: str, **facts: object) -> None:
    """A run's folder under ``path``: rows, and one row of metadata with their number and the given facts."""
    write_json_lines(df, f"{path}/{run}/rows")
    made = df.sparkSession.read.schema(df.schema).json(f"{path}/{run}/rows").agg(F.count(F.lit(1)).alias("rows"))
    write_json_lines(made.select(F.lit(run).alias("run"), "rows", *[F.lit(v).alias(k) for k, v in facts.items()]), f"{path}/{run}/metadata")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_by_category(df: DataFrame, path: str, category: str = "category", mode: str = "separate", enabled: Mapping[str, bool] | None = None) -> None:
    """``separate``: a folder for each category and a combined one; ``combined``: only that; ``none``: nothing. Anything else counts as separate."""
    if mode == "none":
        return
    names = [k for k, on in (enabled or {}).items() if not on]
    rows = df.filter(~F.col(category).isin(names)) if names else df
    rows.write.mode("overwrite").json(f"{path}/combined")
    if mode != "combined":
        # Hot categories are spread over files by a second key.
        rows.write.mode("overwrite").option("maxRecordsPerFile", 1_000_000).partitionBy(category).json(f"{path}/separate")


def training_records(df: DataFrame, tokens: str = "tokens", keep: Sequence[str] = ()) -> DataFrame:
    """(text, token_count) of token rows, and the columns ``keep``; rows without tokens keep their text and a null count."""
    n = F.size(tokens)
    has = F.coalesce(n > 0, F.lit(False))
    text = F.col("text") if "text" in df.columns else F.lit(None).cast("string")
    return df.select(*keep, F.when(has, F.array_join(F.col(tokens).cast("array<string>"), " ")).otherwise(text).alias("text"), F.when(has, n.cast("long")).alias("token_count"))


def write_vectors(df: DataFrame, path: str) -> None:
    """Vectors with their ids and other columns as Parquet."""
    df.write.mode("overwrite").parquet(path)


def write_group(df: DataFrame, path: str, key: str, value: str, n_tokens: str, least: int = 0, most: int = 0, limit: int = 0) -> None:
    """The rows of one group within token limits; 0 means no limit."""
    rows = df.filter(F.col(key) == value)
    if least:
        rows = rows.filter(F.col(n_tokens) >= least)
    if most:
        rows = rows.filter(F.col(n_tokens) <= most)
    (rows.limit(limit) if limit else rows).write.mode("overwrite").json(path)
