"""Whole pipelines: ordered stages with the first failure, the comprehensive decision, combined preselection."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweir.functions import categories as C
from textweir.functions import rules as R
from textweir.functions import scores as S
from textweir.functions.text import with_features


@dataclass(frozen=True)
class PipelineConfig:
    domain: str = "general"
    use_preselect: bool = True
    use_rules: bool = True
    use_quality: bool = True
    use_category: bool = True
    table: C.KeywordTable | None = None


def first_failure(stages: Mapping[str, Column]) -> Column:
    """The name of the first stage that a row doesn't pass; null where it passes all. Cheap stages go first."""
    out = F.lit(None).cast("string")
    for name, passes in reversed(list(stages.items())):
        out = F.when(~F.coalesce(passes, F.lit(False)), name).otherwise(out)
    return out


CHAIN = ("word_count", "rules", "readability", "diversity", "perplexity", "category")


def chain(df: DataFrame, text_col: str = "text", log_perplexity: str | None = None, most_perplexity: float = 50.0, fallback: str | None = None) -> DataFrame:
    """Adds ``rejected_at``, the first of ``CHAIN`` that a row fails, and ``categories``.

    Word count 20 to 1024, rules, readability and diversity of 0.2 and more, a perplexity of at most ``most_perplexity``, and a category.
    ``log_perplexity`` and ``fallback`` name columns of a scorer: the logarithm of the perplexity (null rejects), and an array of labels
    that counts only where no keyword gives a category. Without them the stages go by what there is.
    """
    f = with_features(df, text_col).withColumns({"readability": S.readability(), "diversity": S.diversity(), "native": C.all_matching(F.lower("t"))})
    other = F.col(fallback) if fallback else F.array().cast("array<string>")
    f = f.withColumn("categories", F.when(F.size("native") > 0, F.col("native")).otherwise(F.coalesce(other, F.array().cast("array<string>"))))
    stages = {
        "word_count": F.col("n_words").between(20, 1024),
        "rules": R.passes_rules(),
        "readability": F.col("readability") >= 0.2,
        "diversity": F.col("diversity") >= 0.2,
        "perplexity": F.col(log_perplexity) <= math.log(most_perplexity) if log_perplexity else F.lit(True),
        "category": F.size("categories") > 0,
    }
    return f.withColumn("rejected_at", first_failure(stages))


DECISION = ("preselect", "rules", "quality", "category")


def comprehensive(df: DataFrame, text_col: str = "text", config: PipelineConfig = PipelineConfig(), adjustment: Column | None = None) -> DataFrame:
    """Adds the rule grade, the quality scores, the category, ``rejected_at`` and ``should_include``."""
    f = with_features(df, text_col).withColumns({**S.quality(), "hits": R.rule_hits(), "preselected": R.preselect()})
    f = f.withColumns({"grade": R.rule_grade(F.col("hits")), "overall_quality": S.overall_quality(), "category": C.best_weighted(F.lower("t"), config.table or C.PRESELECT_CATEGORIES)})
    threshold = F.lit(C.domain(config.domain).quality) + (F.lit(0.0) if adjustment is None else adjustment)
    wanted = {
        "preselect": (config.use_preselect, F.col("preselected")),
        "rules": (config.use_rules, F.col("grade.is_safe")),
        "quality": (config.use_quality, F.col("overall_quality") >= threshold),
        "category": (config.use_category, F.col("category") != "uncategorized"),
    }
    stages = {k: c if on else F.lit(True) for k, (on, c) in wanted.items()}
    return f.withColumn("rejected_at", first_failure(stages)).withColumn("should_include", F.col("rejected_at").isNull())


def confident(confidence: Column, label: Column | None = None, least: float = 0.6, negative: float = 0.8) -> Column:
    """A model's gate: its confidence reaches ``least``; with a sentiment ``label``, only a strongly negative one fails."""
    if label is None:
        return F.coalesce(confidence >= least, F.lit(False))
    return ~F.coalesce((F.upper(label) == "NEGATIVE") & (confidence > negative), F.lit(False))


def combined_preselect(rule: Column, similarity: Column, similarity_hint: Column, least: float = 0.3, confidence: Column | None = None) -> Column:
    """(passed, combined_score, hints): the rules, then a similarity, then a model's confidence, if given; each counts only if those before it passed."""
    near = rule["passed"] & F.coalesce(similarity >= least, F.lit(False))
    passed = near & confident(confidence) if confidence is not None else near
    scores = [F.when(rule["passed"], rule["quality_score"]), F.when(near, similarity)] + ([F.when(passed, confidence)] if confidence is not None else [])
    got = F.array_compact(F.array(*scores))
    hints = F.when(near, F.array_union(rule["hints"], F.array(similarity_hint))).when(rule["passed"], rule["hints"]).otherwise(F.array().cast("array<string>"))
    mean = F.when(F.size(got) > 0, F.aggregate(got, F.lit(0.0), lambda a, x: a + x) / F.size(got)).otherwise(0.0)
    return F.struct(passed.alias("passed"), mean.alias("combined_score"), hints.alias("hints"))
