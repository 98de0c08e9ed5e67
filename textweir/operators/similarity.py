"""Vector and TF-IDF similarity."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textweir.functions import text as T


def normalise(v: Column) -> Column:
    """A vector of length one; a null vector of zeros stays as it is."""
    x = v.cast("array<double>")
    size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, e: a + e * e))
    return F.when(size > 0, F.transform(x, lambda e: e / size)).otherwise(x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, p: s + p)


@dataclass(frozen=True)
class TopK:
    k: int = 3
    metric: str = "dot"  # or "l2": squared distance, smaller is better
    #: Rows of a block; a task holds one block of queries and one of the corpus.
    block_rows: int = 8192
    keep_self: bool = True


def _block_top(spec: TopK):
    columns = ["query_id", "id", "score"]

    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        q = np.array(queries["vector"].tolist(), dtype=np.float64)
        ids, x = rows["id"].to_numpy(), np.array(rows["vector"].tolist(), dtype=np.float64)
        out = []
        for at in range(0, len(q), 512):
            part = q[at : at + 512]
            s = part @ x.T
            if spec.metric == "l2":
                s = -((part**2).sum(1)[:, None] + (x**2).sum(1) - 2 * s)
            for name, row in zip(queries["id"].to_numpy()[at : at + 512], s):
                if not spec.keep_self:
                    row = np.where(ids == name, -np.inf, row)
                best = np.lexsort((ids, -row))[: spec.k] if len(row) <= 4 * spec.k else _top(row, ids, spec.k)
                out += [(name, ids[j], row[j]) for j in best if row[j] > -np.inf]
        return pd.DataFrame(out, columns=columns)

    return run


def _top(row: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k best with ties at the edge settled by id."""
    edge = np.partition(row, len(row) - k)[len(row) - k]
    near = np.flatnonzero(row >= edge)
    return near[np.lexsort((ids[near], -row[near]))[:k]]


def top_k(queries: DataFrame, rows: DataFrame, spec: TopK = TopK(), lists: str | None = None) -> DataFrame:
    """(query_id, rank, id, score): the k best rows of each query, exact, ties to the smaller id.

    Both sides have (id, vector). Blocks of queries meet blocks of rows, one pair of blocks a
    task, and only each block's k best go on. With ``lists`` both sides also carry a column of that name, and only
    equal ones meet.
    """
    n_q, n_r = (max(1, -(-d.count() // spec.block_rows)) for d in (queries, rows))
    own = [F.col(lists).alias("list")] if lists else [F.lit(0).alias("list")]
    q = queries.select(F.col("id").cast("long").alias("id"), "vector", *own, F.pmod(F.xxhash64("id"), F.lit(n_q)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))).alias("rb"))
    r = rows.select(F.col("id").cast("long").alias("id"), "vector", *own, F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"), F.pmod(F.xxhash64("id"), F.lit(n_r)).alias("rb"))
    keys = ["list", "qb", "rb"]
    found = q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(_block_top(spec), "query_id long, id long, score double")
    if lists:
        found = found.distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= spec.k).select("query_id", "rank", "id", "score")


@dataclass(frozen=True)
class IvfSpec:
    lists: int = 100
    #: Lists that a query looks into. The reference's 10 lose a third of the true neighbours of these tables' vectors.
    probes: int = 60
    #: Rows that the centres are fitted on; every row is indexed.
    sample_rows: int = 50_000
    seed: int = 42


def _nearest_lists(centres: np.ndarray, n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.array(pdf["vector"].tolist(), dtype=np.float64)
            d = (centres**2).sum(1) - 2 * x @ centres.T
            yield pdf.assign(near=list(np.argsort(d, axis=1, kind="stable")[:, :n].astype(np.int32)))

    return run


def ivf_top_k(queries: DataFrame, rows: DataFrame, k: int = 5, ivf: IvfSpec = IvfSpec()) -> DataFrame:
    """Approximate (query_id, rank, id, score) by squared distance: rows are kept in lists by nearest centre, queries look into ``probes`` of them."""
    sample = rows.orderBy(F.xxhash64(F.lit(ivf.seed), F.col("id"))).limit(ivf.sample_rows)
    fitted = KMeans(k=ivf.lists, seed=ivf.seed, maxIter=10).fit(sample.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features")))
    centres = np.array(fitted.clusterCenters())
    ddl = "id long, vector array<float>, near array<int>"
    plain = [F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector")]
    listed = rows.select(*plain).mapInPandas(_nearest_lists(centres, 1), ddl).select("id", "vector", F.col("near")[0].alias("list_id"))
    probing = queries.select(*plain).mapInPandas(_nearest_lists(centres, ivf.probes), ddl).select("id", "vector", F.explode("near").alias("list_id"))
    return top_k(probing, listed, TopK(k=k, metric="l2"), lists="list_id")


def tfidf_similarity(df: DataFrame, id_col: str, text_col: str, described: Mapping[str, str]) -> DataFrame:
    """(id, category, similarity): cosine of each text with each description.

    Terms are lower-cased runs of two and more word characters; smooth idf over texts and
    descriptions, ln((1 + n) / (1 + df)) + 1; vectors of length one. Texts without a shared
    term get 0. Descriptions are few, so only their terms are joined.
    """
    spark = df.sparkSession
    # A handful of literal descriptions.
    notes = spark.createDataFrame(list(described.items()), "category string, note string")
    term = F.lit(r"[\p{L}\p{N}_]{2,}")
    texts = df.select(F.col(id_col).alias("id"), T.text_or_empty(text_col).alias("x"))
    terms = texts.select("id", F.explode(F.regexp_extract_all(F.lower("x"), term, F.lit(0))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    note_terms = notes.select("category", F.explode(F.regexp_extract_all(F.lower("note"), term, F.lit(0))).alias("term")).groupBy("category", "term").agg(F.count(F.lit(1)).alias("tf"))
    df_ = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    note_df = note_terms.groupBy("term").agg(F.count(F.lit(1)).alias("note_df"))
    n = df.select(F.count(F.lit(1)).alias("n"))
    idf = (
        df_.join(F.broadcast(note_df), "term", "left")
        .join(F.broadcast(n))
        .select("term", (F.log((F.lit(1.0) + F.col("n") + len(described)) / (F.lit(1.0) + F.col("df") + F.coalesce("note_df", F.lit(0)))) + 1).alias("idf"))
    )
    only_notes = note_df.join(df_, "term", "left_anti").join(F.broadcast(n)).select("term", (F.log((F.lit(1.0) + F.col("n") + len(described)) / (F.lit(1.0) + F.col("note_df"))) + 1).alias("idf"))
    weighted = terms.join(idf, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    note_w = note_terms.join(idf.join(F.broadcast(note_df.select("term")), "term", "left_semi").union(only_notes), "term").select("category", "term", (F.col("tf") * F.col("idf")).alias("nw"))
    note_norm = note_w.groupBy("category").agg(F.sqrt(F.sum(F.col("nw") * F.col("nw"))).alias("note_norm"))
    shared = weighted.join(F.broadcast(note_w), "term").groupBy("id", "category").agg(F.sum(F.col("w") * F.col("nw")).alias("dot"))
    cosine = shared.join(norms, "id").join(F.broadcast(note_norm), "category").select("id", "category", (F.col("dot") / (F.col("norm") * F.col("note_norm"))).alias("similarity"))
    every = texts.select("id", F.explode(F.array(*[F.lit(c) for c in described])).alias("category"))
    return every.join(cosine, ["id", "category"], "left").select(F.col("id").alias(id_col), "category", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
