"""The same operators over streams: stateless filters, exact duplicates, running statistics, near copies by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweir.functions import scores as S
from textweir.functions.text import with_features
from textweir.operators import dedup
from textweir.operators.dedup import normalised
from textweir.session import cut, ensure_checkpoint_dir


def read_files(spark: SparkSession, path: str, schema, kind: str = "parquet", files_a_batch: int = 4) -> DataFrame:
    """A stream over the files of a folder, or over a single file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).format(kind)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", where.getName()).load(where.getParent().toString())
    return reader.load(path)


def rewarded(df: DataFrame, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """Stateless: rows whose simple reward reaches ``least``."""
    return with_features(df, text_col).withColumn("reward", S.simple_reward()).filter(F.col("reward") >= least)


def distinct_texts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Exact duplicates dropped as they arrive; the state keeps one hash for each distinct text."""
    return df.withColumn("sha", F.sha2(normalised(F.coalesce(text_col, F.lit(""))), 256)).dropDuplicates(["sha"])


def running_counts(df: DataFrame, key: str, n: str) -> DataFrame:
    """Complete-mode totals by key."""
    return df.groupBy(F.coalesce(key, F.lit("unknown")).alias(key)).agg(F.count(F.lit(1)).alias("records"), F.sum(n).cast("long").alias("total"))


def windowed_counts(df: DataFrame, ts: str, key: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by tumbling window with a watermark for late rows."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), key).agg(F.count(F.lit(1)).alias("records")).select(F.col("w.start").alias("start"), key, "records")


def run_available(df: DataFrame, path: str | None = None, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and give its output. ``path`` is a new folder of the shared one by default; a later run on the same path goes on where this one ended."""
    spark = df.sparkSession
    base = path or f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "complete":
        def keep_last(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out")

        q = df.writeStream.outputMode("complete").foreachBatch(keep_last)
    else:
        q = df.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
    q.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


def drop_near_copies(df: DataFrame, id_col: str, text_col: str, path: str, banding: dedup.Banding = dedup.AT_05) -> DataFrame:
    """Run a stream and keep each text that shares no bucket with one kept before; gives the kept rows.

    Kept buckets are an index on disk, one folder a batch, written over when a batch is replayed;
    within a batch the greedy rule holds in the order of the ids.
    """
    spark = df.sparkSession

    def one_batch(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn(id_col, F.col(id_col).cast("long"))
        buckets = cut(dedup.band_buckets(dedup.signatures(rows, id_col, text_col, dedup.words_and_trigrams, banding), banding))
        fresh = rows.select(F.col(id_col).alias("id"))
        if number:
            kept_before = spark.read.schema("bucket long, id long, batch int").parquet(f"{path}/index").filter(F.col("batch") < number)
            seen = buckets.join(kept_before.select("bucket"), "bucket", "left_semi").select("id").distinct()
            fresh = fresh.join(seen, "id", "left_anti")
        fresh = cut(fresh.distinct())
        kept = cut(dedup.greedy_survivors(fresh, buckets.join(fresh, "id", "left_semi")))
        rows.join(kept.withColumnRenamed("id", id_col), id_col, "left_semi").write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        buckets.join(kept, "id", "left_semi").select("bucket", "id").write.mode("overwrite").parquet(f"{path}/index/batch={number}")

    q = df.writeStream.foreachBatch(one_batch).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    q.start().awaitTermination()
    return spark.read.parquet(f"{path}/out")
