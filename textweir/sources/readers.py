"""Readers for record files: lenient and strict JSON lines, folders, Parquet, token tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = False) -> DataFrame:
    """JSON lines with a given schema. Malformed and blank lines are left out, or fail the job where ``strict``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return read_json_lines_audited(spark, path, schema).filter("NOT is_bad").drop("is_bad")


def read_json_lines_audited(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """All lines that aren't blank, with ``is_bad`` for those that don't parse, so that they can be counted."""
    kinds = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    wide = T.StructType([*kinds.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    parsed = lines.select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.select("r.*").withColumn("is_bad", F.col("_bad").isNotNull()).drop("_bad")


def read_folder(spark: SparkSession, path: str, schema: str | T.StructType, text_key: str = "text", default_metadata: Mapping[str, str] | None = None) -> DataFrame:
    """A folder of JSON lines, subfolders included, compression by file name: text, file and the columns of ``default_metadata``, which fill nulls."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("mode", "DROPMALFORMED").json(path)
    out = rows.withColumnRenamed(text_key, "text") if text_key != "text" else rows
    for name, value in (default_metadata or {}).items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in out.columns else F.lit(value))
    return out.withColumn("file", F.input_file_name())


def valid_tokens(df: DataFrame, tokens: str = "tokens", most: int = 100_000) -> DataFrame:
    """Rows whose token list has from 1 to ``most`` tokens."""
    return df.filter(F.size(tokens).between(1, most))


def first_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first ``n`` rows in a declared order; 0 or less means all."""
    return df.orderBy(order).limit(n) if n > 0 else df


def first_rows_each(df: DataFrame, group: str, n: int, order: str) -> DataFrame:
    from pyspark.sql.window import Window

    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("_n") <= n).drop("_n")
