"""Scores of a text as Columns over the features of ``text.with_features``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textweir.functions import text as T

# Word lists of the scores.
PRONOUNS = ("you", "your", "we", "our", "i", "my")
ACTIONS = ("do", "make", "create", "build", "learn", "discover")
TRANSITIONS = ("however", "therefore", "furthermore", "moreover", "additionally", "consequently", "meanwhile", "thus")
CALL_PARTS = ("function", "call", "api", "execute", "def", "(", ")", "=", "return")
CALL_WORDS = ("function", "call", "api", "execute", "def", "return")


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def readability() -> Column:
    """Reading ease by sentence and syllable counts, from 0 to 1; 0 without a sentence mark or word."""
    marks, n = F.col("n_marks"), F.col("n_words")
    ease = F.lit(206.835) - F.lit(1.015) * (n / marks) - F.lit(84.6) * (F.col("n_syllables") / n)
    return F.when((marks == 0) | (n == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), ease)) / 100.0)


def diversity() -> Column:
    """Share of distinct words with a bonus, or malus, for their mean length."""
    n = F.col("n_distinct")
    bonus = F.least(F.lit(0.3), (F.col("distinct_length") / n - 4) * F.lit(0.05))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), n / F.col("n_words") + bonus))


def engagement() -> Column:
    asked = F.regexp_count("t", F.lit(r"\?")).cast("long")
    return F.least(F.lit(1.0), _ratio(asked * 2 + T.count_in(F.col("tokens"), PRONOUNS + ACTIONS), F.col("n_words")))


def coherence() -> Column:
    """Transitions per sentence and evenness of sentence lengths; 0.5 for less than two sentences."""
    k, mean = F.col("n_sentences"), F.col("sentence_sum") / F.col("n_sentences")
    variance = F.col("sentence_squares") / k - mean * mean
    flow = F.least(F.lit(0.5), T.count_in(F.col("tokens"), TRANSITIONS) / k)
    return F.when(k < 2, F.lit(0.5)).otherwise(flow + F.lit(0.5) - F.least(F.lit(0.3), variance / 100))


def length_score() -> Column:
    return F.least(F.lit(1.0), F.col("n_words") / 50)


def quality() -> dict[str, Column]:
    """The five quality scores by name; their mean is the overall quality."""
    return {"readability": readability(), "engagement": engagement(), "diversity": diversity(), "coherence": coherence(), "length": length_score()}


def overall_quality(parts: tuple[str, ...] = ("readability", "engagement", "diversity", "coherence", "length")) -> Column:
    return sum((F.col(p) for p in parts), F.lit(0.0)) / len(parts)


def heuristic_quality() -> Column:
    """Length band, character and word diversity and sentence marks; 1 at most."""
    n = F.col("n_chars")
    band = F.when(n.between(50, 2000), 0.3).when((n >= 20) & (n <= 5000), 0.1).otherwise(0.0)
    chars = F.least(T.distinct_chars(F.col("t")) / F.greatest(n, F.lit(1)) * F.lit(0.3), F.lit(0.3))
    distinct = F.least(_ratio(F.col("n_distinct"), F.col("n_words")) * F.lit(0.2), F.lit(0.2))
    return F.least(band + chars + distinct + F.when(F.col("t").rlike("[.!?]"), 0.2).otherwise(0.0), F.lit(1.0))


def call_share(lower: Column) -> Column:
    return sum((lower.contains(p).cast("int") for p in CALL_PARTS), F.lit(0)) / len(CALL_PARTS)


def simple_reward(threshold: float = 0.2, shortest: int = 50, longest: int = 2000, weight: float = 1.0) -> Column:
    """Length, word diversity and signs of calls; 0 outside the lengths or under the threshold."""
    n = F.col("n_chars")
    distinct = _ratio(F.col("n_distinct"), F.col("n_words"))
    score = F.least(F.lit(1.0), n / 500) * F.lit(0.3) + distinct * F.lit(0.4) + call_share(F.lower("t")) * F.lit(weight) * F.lit(0.3)
    return F.when(~n.between(shortest, longest) | (F.col("n_words") == 0) | (score < threshold), F.lit(0.0)).otherwise(score)


def soft_length(n: Column, shortest: int = 50, longest: int = 2000) -> Column:
    def sigmoid(x: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))

    return sigmoid((n - shortest) / F.lit(150.0)) * sigmoid((F.lit(longest) - n) / F.lit(500.0))


def call_word_share() -> Column:
    """Share of nine signs of calls, words between boundaries and marks anywhere."""
    marks = sum((F.col("t").contains(m).cast("int") for m in "()="), F.lit(0))
    named = sum((F.array_contains("tokens", w).cast("int") for w in CALL_WORDS), F.lit(0))
    return (marks + named) / len(CALL_PARTS)


def corpus_reward(score: Column, accepted: Column) -> Column:
    """Aggregate: mean accepted score with a bonus for their number; 0 for less than three."""
    n = F.count_if(accepted)
    return F.when(n < 3, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.avg(F.when(accepted, score)) + F.least(F.lit(0.2), n / 100)))


def confidence_band(c: Column) -> Column:
    return F.when(c < 0.3, "very_low").when(c < 0.5, "low").when(c < 0.7, "medium").when(c < 0.9, "high").otherwise("very_high")


def response_score(source: Column, answer: Column, source_words: Column, answer_words: Column, patterns: tuple[str, ...]) -> Column:
    """How well an answer takes up a category: patterns in both texts and words in common."""
    hits = sum((F.lower(c).contains(p.lower()).cast("int") for c in (source, answer) for p in patterns), F.lit(0))
    shared = _ratio(F.size(F.array_intersect(source_words, answer_words)), F.size(F.array_distinct(source_words)))
    return hits / (2 * len(patterns)) * F.lit(0.7) + shared * F.lit(0.3)
