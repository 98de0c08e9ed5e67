"""Command line: filter commands from JSON lines, or report on a corpus.

python -m textweir.cli commands IN OUT [--strictness moderate] [--threshold N] [--max-records N] [--explain]
python -m textweir.cli report IN
"""

from __future__ import annotations

import argparse
import dataclasses

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textweir.functions import categories as C
from textweir.functions.text import text_or_empty
from textweir.operators import stats
from textweir.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textweir", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="what", required=True)
    c = sub.add_parser("commands")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--strictness", choices=sorted(C.STRICTNESS), default="moderate")
    c.add_argument("--threshold", type=float)
    c.add_argument("--max-records", type=int, default=0)
    c.add_argument("--explain", action="store_true")
    sub.add_parser("report").add_argument("source")
    return p


def filter_commands(spark: SparkSession, source: str, target: str, strictness: C.Strictness, most: int = 0) -> dict[str, int]:
    """Write the kept records with score and reason; give the counts."""
    rows = readers.read_json_lines(spark, source, "text string").withColumn("t", text_or_empty("text"))
    # Files are read in order, so without a shuffle the first rows are the first lines.
    rows = rows.limit(most) if most else rows
    counted = rows.filter(F.length("t") >= strictness.least_length).select("text", F.length("t").alias("original_length"), C.command_counts(F.col("t")).alias("counts"))
    scored = counted.select("text", "original_length", C.command_scores(F.col("counts"), F.col("original_length"), strictness).alias("c"))
    kept = scored.filter("c.keep").select("text", F.col("c.score").alias("command_score"), F.col("c.reason").alias("keep_reason"), F.col("c.patterns").alias("detected_patterns"), "original_length")
    writers.write_json_lines(kept, target)
    return {"read": rows.count(), "kept": spark.read.schema("text string").json(target).count()}


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("textweir").getOrCreate()
    if a.what == "commands":
        if a.explain:
            for group, description, weight, pattern in C.COMMANDS:
                print(f"{group}\t{weight}\t{description}\t{pattern}")
        strictness = C.STRICTNESS[a.strictness]
        if a.threshold is not None:
            strictness = dataclasses.replace(strictness, acceptance=a.threshold)
        print(filter_commands(spark, a.source, a.target, strictness, a.max_records))
    else:
        rows = readers.read_json_lines(spark, a.source, "text string").withColumn("n", F.length(F.coalesce("text", F.lit(""))))
        stats.length_stats(rows, "n").show(truncate=False)
        stats.length_histogram(rows, "n").show(truncate=False)


if __name__ == "__main__":
    main()
