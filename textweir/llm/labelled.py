"""Hand labels: bounded, repeatable training samples and the Arrow pass that applies a fitted model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Characters of all training texts of one model together; bounds what the driver gets and holds.
MOST_TRAINING_CHARACTERS = 64_000_000


def training_rows(
    texts: DataFrame, labels: DataFrame, aspect: str, most: int, unanimous: str | None = None, characters: int = MOST_TRAINING_CHARACTERS, id_col: str = "record_id", text_col: str = "text"
) -> list[tuple[str, list[str]]]:
    """(text, answers) of at most ``most`` labelled records of one aspect, in an order set by a hash of the id.

    The bounds are on the training sample only and keep fitting on the driver small: at most
    ``most`` texts, and of these as many as have ``characters`` together, long ones among them. The fitted model is
    applied to all rows, whole. Answers are trimmed and lower-cased. With ``unanimous`` only records count whose annotators
    all gave that answer. Rows with a null id, answer or text don't count; a repeated id counts once;
    empty tables give no rows. Other columns are ignored.
    """
    answers = F.array_sort(F.collect_list(F.lower(F.trim("answer")))).alias("_answers")
    said = labels.filter((F.col("aspect") == aspect) & F.col("answer").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(answers)
    if unanimous:
        said = said.filter(F.forall("_answers", lambda a: a == unanimous))
    chosen = said.orderBy(F.xxhash64("_id"), "_id").limit(most)
    # At most `most` ids and answers: small enough to send to every task whatever the table's size.
    found = texts.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter("_text is not null").join(F.broadcast(chosen), "_id").dropDuplicates(["_id"])
    # One row for each chosen record, so this order is over few rows.
    before = F.sum(F.length("_text")).over(Window.partitionBy(F.lit(1)).orderBy(F.xxhash64("_id"), "_id"))
    rows = found.withColumn("_n", before).filter(F.col("_n") <= characters).select("_id", "_text", "_answers").toPandas().sort_values("_id")
    return list(zip(rows["_text"], map(list, rows["_answers"])))


def apply_in_batches(df: DataFrame, schema: str, kernel: Callable[[list, list], list[pa.Array]], chunk: int = 512) -> DataFrame:
    """Run ``kernel(ids, texts)`` over (id, text) rows, ``chunk`` at a time, so that memory doesn't follow the batch size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None
        for whole in batches:
            for at in range(0, whole.num_rows, chunk):
                part = whole.slice(at, chunk)
                out = kernel(part.column(0).to_pylist(), part.column(1).to_pylist())
                names = names or [x.strip().split()[0] for x in schema.split(",")]
                yield pa.record_batch(out, names=names)

    return df.mapInArrow(run, schema)
