"""Token-level language-model scores, and a trainable quality classifier.

Neural models can't be loaded here; a unigram model counted over the corpus stands in
for them behind the same operators. Such scores are the stand-in's, not a network's.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweir.functions import text as T
from textweir.session import cut

FLOOR = 1e-10


def unigrams(df: DataFrame, text_col: str) -> DataFrame:
    """(token, p): each lower-cased word's share of all words."""
    toks = df.select(F.explode(T.words(F.lower(T.text_or_empty(text_col)))).alias("token"))
    counted = toks.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(total)).select("token", (F.col("n") / F.col("total")).alias("p"))


def token_losses(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, losses): -ln p of each word in order. Words are joined once per text and distinct word, not once per place."""
    texts = df.select(F.col(id_col).alias("id"), T.words(F.lower(T.text_or_empty(text_col))).alias("ws"))
    model = unigrams(df, text_col)
    distinct = texts.select("id", F.explode(F.array_distinct("ws")).alias("token"))
    priced = distinct.join(model, "token").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("token", -F.log(F.greatest("p", F.lit(FLOOR)))))).alias("price"))
    none = F.array().cast("array<double>")
    return texts.join(priced, "id", "left").select(F.col("id").alias(id_col), F.coalesce(F.transform("ws", lambda w: F.col("price")[w]), none).alias("losses"))


def lm_scores(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, num_tokens, avg_score, perplexity): the first word is context only; fewer than two words score 0.

    A mean needs no order: each text's words are counted, then priced once per distinct word.
    """
    texts = df.select(F.col(id_col).alias("id"), T.words(F.lower(T.text_or_empty(text_col))).alias("ws"))
    counted = texts.select("id", F.posexplode("ws").alias("at", "token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("at") > 0).alias("n"))
    # The model comes from the same counts, whose exchange is used twice.
    totals = counted.groupBy("token").agg(F.sum("all").alias("all"))
    model = totals.join(F.broadcast(totals.agg(F.sum("all").alias("total")))).select("token", (F.col("all") / F.col("total")).alias("p"))
    loss = -F.log(F.greatest("p", F.lit(FLOOR)))
    summed = counted.join(model, "token").groupBy("id").agg(F.sum(F.col("n") * loss).alias("total"))
    rows = texts.select("id", F.size("ws").cast("long").alias("num_tokens")).join(summed, "id", "left")
    avg = F.when(F.col("num_tokens") < 2, F.lit(0.0)).otherwise(F.col("total") / (F.col("num_tokens") - 1))
    return rows.select(F.col("id").alias(id_col), "num_tokens", avg.alias("avg_score")).withColumn("perplexity", F.exp("avg_score"))


def rho_scores(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, rho): each word's loss over the text's greatest."""
    scored = token_losses(df, id_col, text_col)
    top = F.array_max("losses")
    return scored.select(id_col, F.when(top > 0, F.transform("losses", lambda x: x / top)).otherwise(F.transform("losses", lambda x: F.lit(0.0))).alias("rho"))


def clean_tokens(df: DataFrame, id_col: str, text_col: str, least: float = 0.1) -> DataFrame:
    """(id, cleaned): the words whose rho reaches ``least``, joined by a space."""
    rho = rho_scores(df, id_col, text_col)
    texts = df.select(id_col, T.words(T.text_or_empty(text_col)).alias("ws"))
    kept = F.filter(F.arrays_zip("ws", "rho"), lambda z: z["rho"] >= least)
    return texts.join(rho, id_col).select(id_col, F.array_join(F.transform(kept, lambda z: z["ws"]), " ").alias("cleaned"))


def fit_classifier(df: DataFrame, text_col: str, label_col: str, features: int = 1 << 14, most: int = 50_000) -> PipelineModel:
    """Hashed word counts and logistic regression on labels 0, 1, ..; text null counts as empty.

    Fitted on at most ``most`` labelled rows, chosen by a hash of the text, and these are held once, in few partitions, for all
    iterations. Save the model with its ``save`` and load it with ``PipelineModel.load`` to fit once and apply often.
    """
    rows = df.filter(F.col(label_col).isNotNull()).select(T.text_or_empty(text_col).alias("t"), F.col(label_col).cast("double").alias("label"))
    chosen = rows.orderBy(F.xxhash64("t"), "label").limit(most)
    rows = cut(chosen.select(T.words(F.lower("t")).alias("ws"), "label").repartition(max(1, most // 10_000), "ws"))
    stages = [HashingTF(inputCol="ws", outputCol="features", numFeatures=features), LogisticRegression(maxIter=20, regParam=0.01)]
    return Pipeline(stages=stages).fit(rows)


def classify_labels(model: PipelineModel, df: DataFrame, text_col: str, labels: Sequence[str]) -> DataFrame:
    """Adds ``category``, the most probable of the labels that the model was fitted on, and ``confidence``, its probability."""
    scored = model.transform(df.withColumn("ws", T.words(F.lower(T.text_or_empty(text_col)))))
    p = vector_to_array("probability")
    best = F.array_max(p)
    named = F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(p, best).cast("int"))
    return scored.withColumn("category", named).withColumn("confidence", best).drop("ws", "features", "rawPrediction", "probability", "prediction")


def best_of(df: DataFrame, score: str, low: float, high: float, first: int = 5, steps: int = 20, reward: Callable[[Column, Column], Column] | None = None, seed: int = 42) -> tuple[float, float]:
    """(threshold, value) of the best threshold in a bounded range: ``first`` random ones, then ``steps`` around the best so far, ever closer.

    ``reward`` makes the value from the scores and the threshold, an aggregate; by default the mean kept score times the share kept.
    Each batch of thresholds is one pass over the scores.
    """
    rng = random.Random(seed)
    value = reward or (lambda s, t: F.coalesce(F.avg(F.when(s >= t, s)), F.lit(0.0)) * F.count_if(s >= t) / F.greatest(F.count(s), F.lit(1)))

    def tried(ts: list[float]) -> list[tuple[float, float]]:
        row = df.agg(*[value(F.col(score), F.lit(t)).cast("double").alias(f"v{i}") for i, t in enumerate(ts)]).first()
        return [(row[i] if row[i] is not None else float("-inf"), t) for i, t in enumerate(ts)]

    best, reach = max(tried([rng.uniform(low, high) for _ in range(first)])), (high - low) / 4
    for at in range(0, steps, 5):
        near = [min(high, max(low, best[1] + rng.uniform(-reach, reach))) for _ in range(min(5, steps - at))]
        best, reach = max([best, *tried(near)]), reach / 2
    return best[1], best[0]


def classify(model: PipelineModel, df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``p1``, the probability of label 1."""
    scored = model.transform(df.withColumn("ws", T.words(F.lower(T.text_or_empty(text_col)))))
    return scored.withColumn("p1", vector_to_array("probability")[1]).drop("ws", "features", "rawPrediction", "probability", "prediction")


def threshold_sweep(df: DataFrame, score: str, grid: list[float]) -> DataFrame:
    """(threshold, kept, mean_score) for all thresholds of a short grid in one pass."""
    kept = [F.struct(F.lit(float(t)).alias("threshold"), F.count_if(F.col(score) >= t).alias("kept"), F.round(F.avg(F.when(F.col(score) >= t, F.col(score))), 6).alias("mean_score")) for t in grid]
    return df.agg(F.array(*kept).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
