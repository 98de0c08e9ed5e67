"""Queries over the training-data tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweir.llm import abuse, encode, nearcopies, packing, readlevel, reservoir, subjects, textkind
from textweir.llm.labelled import apply_in_batches, training_rows
from textweir.llm.sentences import sentences
from textweir.session import spread

RECORDS, DOCUMENTS, LABELS = "refined_commands_filtered", "documents", "record_labels"

#: Three words and 0.6 are fixed by the statement of the problem; no true pair lies within 0.04 of the limit.
NEAR_COPIES = nearcopies.NearCopySpec(threshold=0.6, words_per_shingle=3, min_words=30, safe_similarity=0.64)
SUBJECTS, ABUSE, LEVELS = subjects.SubjectSpec(), abuse.AbuseSpec(), readlevel.LevelSpec()
MOST_KIND_LABELS = 6000
RESERVOIR, ENCODING, CONTAINERS = reservoir.ReservoirSpec(), encode.EncodeSpec(), packing.PackSpec()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, text) of the records whose text isn't null or blank."""
    return spread(table(spark, sf_dir, RECORDS).select("record_id", "text")).filter(F.col("text").rlike(r"\S"))


# -- 1: near copies


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearcopies.near_copies(table(spark, sf_dir, RECORDS), "record_id", "text", NEAR_COPIES)
    return nearcopies.expand_pairs(found).select(F.col("id_a").alias("record_id_a"), F.col("id_b").alias("record_id_b"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearcopies.near_copies(table(spark, sf_dir, RECORDS), "record_id", "text", NEAR_COPIES)
    return nearcopies.near_copy_classes(found).withColumnRenamed("id", "record_id")


# -- 2: subjects


def subject_model(spark: SparkSession, sf_dir: str) -> subjects.SubjectModel:
    texts, labels = table(spark, sf_dir, RECORDS), table(spark, sf_dir, LABELS)
    rows = training_rows(texts, labels, "subject", SUBJECTS.max_training_texts)
    junk = [t for t, _ in training_rows(texts, labels, "text_kind", SUBJECTS.max_junk_texts, unanimous="junk")]
    # The table of subjects has a handful of rows at every scale.
    about = [(r["subject"], r["about"]) for r in table(spark, sf_dir, "subject_areas").collect()]
    return subjects.fit_subjects(rows, about, junk, SUBJECTS)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = subject_model(spark, sf_dir)

    def kernel(ids: list, texts: list) -> list[pa.Array]:
        found = [(i, s) for i, own in zip(ids, model.assign(texts)) for s in own]
        return [pa.array([i for i, _ in found], pa.int64()), pa.array([s for _, s in found], pa.string())]

    return apply_in_batches(records(spark, sf_dir), "record_id long, subject string", kernel)


def p2_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each subject (or none) by the older pipeline's category, its latest export of a record counting."""
    old = table(spark, sf_dir, "oldfilteringbig1900cursorcode")
    task = F.lower(F.trim("category"))
    latest = old.groupBy("record_id").agg(F.max_by(task, "exported_at").alias("category"))
    ids = table(spark, sf_dir, RECORDS).select("record_id")
    found = p2_found(spark, sf_dir)
    return (
        ids.join(found, "record_id", "left")
        .join(latest, "record_id", "left")
        .groupBy(F.coalesce("subject", F.lit("none")).alias("subject"), F.coalesce("category", F.lit("unknown")).alias("category"))
        .agg(F.count_distinct("record_id").alias("records"))
    )


# -- 3: abusive content


def abuse_model(spark: SparkSession, sf_dir: str) -> abuse.AbuseModel:
    texts, labels = table(spark, sf_dir, RECORDS), table(spark, sf_dir, LABELS)
    both = [(a, training_rows(texts, labels, "abuse", most, unanimous=a)) for a, most in (("yes", ABUSE.max_abusive), ("no", ABUSE.max_ordinary))]
    return abuse.fit_abuse([(t, a == "yes") for a, rows in both for t, _ in rows], ABUSE)


def _abuse_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, float]:
    model = abuse_model(spark, sf_dir)

    def kernel(ids: list, texts: list) -> list[pa.Array]:
        score, worst = model.scores(texts)
        return [pa.array(ids, pa.int64()), pa.array(score, pa.float64()), pa.array([w if s > 0 else None for s, w in zip(score, worst)], pa.string())]

    return apply_in_batches(records(spark, sf_dir), "record_id long, abuse_score double, worst_window string", kernel), model.threshold


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, threshold = _abuse_scores(spark, sf_dir)
    return scores.filter(F.col("abuse_score") >= threshold).select("record_id")


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's score; null and blank texts score 0."""
    scores, threshold = _abuse_scores(spark, sf_dir)
    rows = table(spark, sf_dir, RECORDS).select("record_id", "source")
    score = F.coalesce("abuse_score", F.lit(0.0))
    return rows.join(scores, "record_id", "left").select("record_id", "source", score.alias("abuse_score"), "worst_window", (score >= threshold).alias("is_abusive"))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates per source, beside the older model's latest verdict for each record."""
    verdict = F.col("toxicity_analysis")
    old = (
        table(spark, sf_dir, "inappropriate_filter_jason")
        .filter(verdict.isNotNull() & F.col("record_id").isNotNull())
        .groupBy("record_id")
        .agg(F.max_by(verdict["is_toxic"], "processed_at").alias("was_toxic"))
    )
    flag = F.col("is_abusive").cast("int")
    return (
        p3_scores(spark, sf_dir)
        .join(old, "record_id", "left")
        .groupBy(F.coalesce("source", F.lit("unknown")).alias("source"))
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.sum(flag).alias("abusive"),
            F.round(F.avg(flag), 6).alias("abusive_rate"),
            F.count_if(F.col("was_toxic")).alias("old_toxic"),
            F.count_if(F.col("was_toxic") & F.col("is_abusive")).alias("both"),
            F.count_if(F.col("was_toxic") & ~F.col("is_abusive")).alias("only_old"),
            F.count_if(~F.col("was_toxic") & F.col("is_abusive")).alias("only_new"),
        )
    )


# -- 4 and 5: reading level and structural kind


def kind_profiles(spark: SparkSession, sf_dir: str) -> textkind.KindProfiles:
    rows = training_rows(table(spark, sf_dir, RECORDS), table(spark, sf_dir, LABELS), "text_kind", MOST_KIND_LABELS)
    return textkind.fit_profiles([(t, answers[0]) for t, answers in rows if len(set(answers)) == 1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = kind_profiles(spark, sf_dir)
    rows = training_rows(table(spark, sf_dir, RECORDS), table(spark, sf_dir, LABELS), "reading_level", LEVELS.max_training_texts)
    model = readlevel.fit_levels([(t, int(a[0])) for t, a in rows if len(set(a)) == 1 and a[0] in ("1", "2", "3", "4")], LEVELS)

    def kernel(ids: list, texts: list) -> list[pa.Array]:
        kept = [(i, t) for i, t in zip(ids, texts) if len(t.split()) >= readlevel.LEAST_WORDS]
        stats, languages = textkind.statistics([t for _, t in kept])
        kinds, _ = profiles.assign(stats) if kept else ([], None)
        kept = [x for x, k, lang in zip(kept, kinds, languages) if k == "prose" and lang == "en"]
        return [pa.array([i for i, _ in kept], pa.int64()), pa.array(model.levels([t for _, t in kept]), pa.int64())]

    return apply_in_batches(records(spark, sf_dir), "record_id long, reading_level long", kernel)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = kind_profiles(spark, sf_dir)

    def kernel(ids: list, texts: list) -> list[pa.Array]:
        kinds, _ = profiles.assign(textkind.statistics(texts)[0])
        found = [(i, k) for i, k in zip(ids, kinds) if k != "prose"]
        return [pa.array([i for i, _ in found], pa.int64()), pa.array([k for _, k in found], pa.string())]

    return apply_in_batches(records(spark, sf_dir), "record_id long, text_kind string", kernel)


def p5_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and kind of every record with the older pipeline's latest quality score; NaN and negative scores are null."""
    profiles = kind_profiles(spark, sf_dir)
    schema = "record_id long, text_kind string, language string, " + ", ".join(f"{c} double" for c in textkind.STATISTICS)

    def kernel(ids: list, texts: list) -> list[pa.Array]:
        stats, languages = textkind.statistics(texts)
        kinds, _ = profiles.assign(stats)
        return [pa.array(ids, pa.int64()), pa.array(kinds), pa.array(languages), *(pa.array(np.ascontiguousarray(c)) for c in stats.T)]

    score = F.when((F.col("quality_score") >= 0) & ~F.isnan("quality_score"), F.col("quality_score"))
    old = table(spark, sf_dir, "oldfilteringbig1900cursorcode").groupBy("record_id").agg(F.max_by(score, "exported_at").alias("old_quality_score"))
    every = table(spark, sf_dir, RECORDS).select("record_id")
    return every.join(apply_in_batches(records(spark, sf_dir), schema, kernel), "record_id", "left").join(old, "record_id", "left")


# -- 6: fixed-size sample


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform sample of the records with the cluster and number of tokens of their first arrival."""
    rows = table(spark, sf_dir, "climblab_sample")
    sample = reservoir.reservoir(rows, "sample_id", "piece_no", RESERVOIR)
    # Its size is fixed.
    sample = F.broadcast(sample) if RESERVOIR.size <= 100_000 else sample
    first = F.struct(F.coalesce("piece_no", F.lit(2**31 - 1)), "arrived_at", F.coalesce("cluster_id", F.lit("unknown")).alias("cluster_id"), F.coalesce(F.size("tokens"), F.lit(0)).alias("n_tokens"))
    return (
        rows.select("sample_id", first.alias("row"))
        .join(sample, "sample_id", "left_semi")
        .groupBy("sample_id")
        .agg(F.min("row").alias("row"))
        .select("sample_id", "row.cluster_id", F.greatest(F.col("row.n_tokens"), F.lit(0)).alias("n_tokens"))
    )


# -- 7: encoding


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids by byte_bpe_50k; null and empty texts have an empty list."""
    return encode.encode(table(spark, sf_dir, DOCUMENTS), "doc_id", "text", ENCODING)


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids decoded again; ``exact`` is whether the text came back unchanged."""
    docs = table(spark, sf_dir, DOCUMENTS).select("doc_id", F.coalesce("text", F.lit("")).alias("before"))
    back = encode.decode(p7_ids(spark, sf_dir), "doc_id", "ids", ENCODING)
    return docs.join(back, "doc_id").select("doc_id", F.length("text").cast("long").alias("n_chars"), (F.col("text") == F.col("before")).alias("exact"))


# -- 8: containers


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each part of each document lies; sizes in tokens of byte_bpe_50k."""
    sizes = encode.token_counts(table(spark, sf_dir, DOCUMENTS), "doc_id", "text", ENCODING)
    return packing.pack(sizes, "doc_id", "n_tokens", CONTAINERS)


def p8_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are, beside the least number that could hold the tokens."""
    rows = p8_containers(spark, sf_dir).filter("container is not null")
    total, used = F.sum("size"), F.count_distinct("container")
    return rows.agg(used.alias("containers"), F.ceil(total / CONTAINERS.capacity).alias("least"), F.round(total / (used * CONTAINERS.capacity), 6).alias("filled"))


# -- 9: sentences


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(ids: list, texts: list) -> list[pa.Array]:
        found = [(i, a, b) for i, t in zip(ids, texts) for a, b in sentences(t)]
        return [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]

    docs = spread(table(spark, sf_dir, DOCUMENTS).select("doc_id", "text"))
    return apply_in_batches(docs, "doc_id long, sent_start long, sent_end long", kernel, chunk=128)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [p1_found, p1_classes, p2_found, p2_composition, p3_found, p3_scores, p3_rates, p4_found, p5_found, p5_statistics]
    named += [p6_sample, p7_ids, p7_decoded, p8_containers, p8_use, p9_found]
    return {f.__name__: f for f in named}


#: Pairs by counting common word runs, for small tables.
PAIRS_SQL = r"""w AS (SELECT record_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM refined_commands_filtered WHERE text IS NOT NULL),
  s AS (SELECT DISTINCT record_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT record_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 30)),
  n AS (SELECT record_id, count(*) AS n FROM s GROUP BY 1),
  c AS (SELECT a.record_id AS a, b.record_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.record_id < b.record_id GROUP BY 1, 2),
  p AS (SELECT a AS record_id_a, b AS record_id_b FROM c JOIN n x ON x.record_id = a JOIN n y ON y.record_id = b WHERE shared >= 0.6 * (x.n + y.n - shared))"""
CLASSES_SQL = f"""WITH {PAIRS_SQL}, k AS (SELECT record_id, array_to_string(w, ' ') AS t FROM w WHERE len(w) >= 30),
  m AS (SELECT record_id, min(record_id) OVER (PARTITION BY t) AS class_id, count(*) OVER (PARTITION BY t) AS class_size FROM k),
  e AS (SELECT record_id_a AS x, record_id_b AS y FROM p UNION ALL SELECT record_id_b, record_id_a FROM p),
  l AS (SELECT x, count(*) AS linked_records, count(DISTINCT m.class_id) FILTER (WHERE m.class_id <> o.class_id) AS linked_classes FROM e JOIN m ON m.record_id = y JOIN m o ON o.record_id = x GROUP BY x)
  SELECT record_id, class_id, class_size, coalesce(linked_classes, 0)::BIGINT AS linked_classes, coalesce(linked_records, 0)::BIGINT AS linked_records FROM m LEFT JOIN l ON x = record_id"""


#: Whatever the ids are, they must give back the text.
DECODED_SQL = "SELECT doc_id, length(coalesce(text, '')) AS n_chars, true AS exact FROM documents"


def oracle_sql() -> dict[str, str]:
    return {"p1_found": f"WITH {PAIRS_SQL} SELECT * FROM p", "p1_classes": CLASSES_SQL, "p7_decoded": DECODED_SQL}
