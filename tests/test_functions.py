"""Columns against plain Python restatements, on edge rows."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textweir.functions import categories as C
from textweir.functions import rules as R
from textweir.functions import scores as S
from textweir.functions import text as T

EDGES = [
    None, "", "  \t\n", "word", "a" * 14, "a b c d e f g h", "x" * 15, "ab " * 1333 + "a", "ab " * 1333 + "ab", "y" * 49, "z " * 25, "q " * 1000, "q " * 1000 + "q",
    "café été", "ÉÉÉ", "éyou and you", "a b\u0085c\rd", "THIS IS ALL UPPER CASE TEXT", "12345 67890 abcd", "!!!!!! ab", "aaaaaaaaaaa", "bbbbbbbbbbbbbbbb", "buy now or never",
    "a b c d a e a f a g h", "a b c d a e a f i g h", "However, we learn. Therefore you do it! What is it? It works.", "One sentence only", "def f(x): return x", "😀 emoji é text 😀",
    "# just a comment", "line one is long enough\nshort\nline three is long enough", "The doctor said sex is a medical term in this study of health", "kill kill murder", "@" * 60,
]


@pytest.fixture(scope="module")
def edges(spark):
    return T.with_features(spark.createDataFrame(list(enumerate(EDGES)), "id int, text string")).cache()


def check(edges, column, expected, digits=9):
    got = {r["id"]: r["x"] for r in edges.select("id", column.alias("x")).collect()}
    for i, text in enumerate(EDGES):
        want = expected(text or "")
        have = got[i]
        if isinstance(want, float):
            assert have == pytest.approx(want, abs=10**-digits), (text, have, want)
        else:
            assert have == want, (text, have, want)


def syllables(word):
    return max(1, len(re.findall("[aeiouy]+", word.lower())) - word.lower().endswith("e"))


def readability(t):
    s, w = len(re.findall("[.!?]+", t)), t.split()
    return max(0.0, min(100.0, 206.835 - 1.015 * len(w) / s - 84.6 * sum(map(syllables, w)) / len(w))) / 100 if s and w else 0.0


def diversity(t):
    w = t.lower().split()
    return min(1.0, len(set(w)) / len(w) + min(0.3, (sum(map(len, set(w))) / len(set(w)) - 4) * 0.05)) if w else 0.0


def engagement(t):
    w = t.split()
    hits = t.count("?") * 2 + len(re.findall(r"\b(?:you|your|we|our|I|my|do|make|create|build|learn|discover)\b", t, re.I))
    return min(1.0, hits / len(w)) if w else 0.0


def coherence(t):
    s = [x for x in re.split("[.!?]+", t) if x.strip()]
    if len(s) < 2:
        return 0.5
    n = [len(x.split()) for x in s]
    mean = sum(n) / len(n)
    flow = len(re.findall(r"\b(?:however|therefore|furthermore|moreover|additionally|consequently|meanwhile|thus)\b", t, re.I))
    return min(0.5, flow / len(s)) + 0.5 - min(0.3, sum((x - mean) ** 2 for x in n) / len(n) / 100)


def heuristic(t):
    n, w = len(t), t.split()
    s = 0.3 if 50 <= n <= 2000 else 0.1 if 20 <= n <= 5000 else 0.0
    s += min(len(set(t.lower())) / max(n, 1) * 0.3, 0.3) + (min(len({x.lower() for x in w}) / len(w) * 0.2, 0.2) if w else 0)
    return min(1.0, s + (0.2 if re.search("[.!?]", t) else 0))


def preselect(t):
    if not t or not 15 <= len(t) <= 4000:
        return False
    if sum(c.isdigit() for c in t) / len(t) > 0.5 or sum(c.isalnum() for c in t) / len(t) < 0.6:
        return False
    return not (len(set(t.lower())) <= 2 and len(t) > 10)


def passes(t):
    return not any(re.search(p, t, re.I) for p in (r"(.)\1{15,}", r"\b(click here|buy now|free money|urgent|limited time)\b", r"^.{1,5}$", r"^\s*$", r"[^\w\s]{50,}"))


def repetition(t):
    w = t.lower().split()
    return len(w) > 10 and max(Counter(w).values()) > len(t.split()) * 0.3


def test_scores(edges):
    check(edges, F.col("n_words"), lambda t: len(t.split()))
    check(edges, T.distinct_chars(F.col("t")), lambda t: len(set(t.lower())))
    check(edges, S.readability(), readability)
    check(edges, S.diversity(), diversity)
    check(edges, S.engagement(), engagement)
    check(edges, S.coherence(), coherence)
    check(edges, S.heuristic_quality(), heuristic)


def test_rules(edges):
    check(edges, R.preselect(), preselect)
    check(edges, R.passes_rules(), passes)
    flagged = edges.withColumn("flags", R.inappropriate_flags())
    check(flagged, F.array_contains(R.inappropriate_categories(F.col("flags")), "excessive_repetition"), repetition)
    check(flagged, F.array_contains(R.inappropriate_categories(F.col("flags")), "excessive_caps"), lambda t: len(t) > 20 and t.isupper())


def test_safety_context(edges):
    rows = {r["text"]: r["g"] for r in edges.withColumn("s", R.safety_shares()).select("text", R.safety_grade(F.col("s")).alias("g")).collect()}
    medical = rows["The doctor said sex is a medical term in this study of health"]
    assert medical["severity"] == pytest.approx(100 / 13 * 0.3) and medical["is_safe"] and medical["warnings"] == ["sexual"]
    assert rows["kill kill murder"]["violations"] == ["violence"] and not rows["kill kill murder"]["is_safe"]
    assert rows[None]["severity"] == 0.0


def test_enhanced_reasons(edges):
    rows = {r["text"]: r["g"] for r in edges.withColumn("c", R.enhanced_checks()).select("text", R.enhanced_preselect(F.col("c")).alias("g")).collect()}
    assert rows[None]["reason"] == rows["  \t\n"]["reason"] == "Empty text"
    assert rows["word"]["reason"] == "Too short (< 15 chars)"
    assert rows["line one is long enough\nshort\nline three is long enough"]["reason"] == "Low quality pattern detected"
    assert rows["However, we learn. Therefore you do it! What is it? It works."]["passed"]


HAND = [
    ("def call_api(endpoint, params): return requests.get(endpoint, params=params)", 0.678933, 0.912267),
    ("Execute database query with parameters: db.execute('SELECT * FROM users')", 0.543800, 0.643800),
    ("This is just regular text without any special patterns", 0.432400, 0.432400),
    ("function() method call with arguments and return values", 0.599667, 0.766333),
    ("Short text", 0.0, 0.0),
    ("API function call example with error handling and response parsing", 0.539600, 0.639600),
]


def test_reward_hand_values(spark):
    df = T.with_features(spark.createDataFrame([(t,) for t, *_ in HAND], "text string"))
    rows = {r["text"]: (r["a"], r["b"]) for r in df.select("text", S.simple_reward().alias("a"), S.simple_reward(0.1, weight=2.0).alias("b")).collect()}
    for text, a, b in HAND:
        assert rows[text] == (pytest.approx(a, abs=1e-6), pytest.approx(b, abs=1e-6))
    for kw, whole in (({}, 0.608880), ({"threshold": 0.1, "weight": 2.0}, 0.728880)):
        scored = df.select(S.simple_reward(**kw).alias("s"))
        assert scored.agg(S.corpus_reward(F.col("s"), F.col("s") > 0).alias("r")).first()["r"] == pytest.approx(whole, abs=1e-6)


COMMANDS = {
    "Turn on the lights at 8pm tonight.": True, "Please set a reminder for tomorrow at 9am.": True, "Play music in the living room.": True,
    "Send a message to John about the meeting.": True, "Order pizza for dinner from the local place.": True, "Hey Google, turn off the bedroom lights.": True,
    "Check the weather forecast for today.": True, "Set the thermostat to 72 degrees.": True, "This is just a regular sentence about mathematics.": False,
    "I need to study for my algebra exam tomorrow.": False, "Can you turn on the TV in the living room?": True, "The book explains differential equations very well.": False,
}


def test_command_filter(spark):
    df = spark.createDataFrame([(t,) for t in [*COMMANDS, ""]], "t string").withColumn("counts", C.command_counts(F.col("t")))
    rows = {r["t"]: r["c"] for r in df.select("t", C.command_scores(F.col("counts"), F.length("t")).alias("c")).collect()}
    assert {t: rows[t]["keep"] for t in COMMANDS} == COMMANDS
    assert rows[""]["score"] == 0.0 and not rows[""]["keep"]


def test_categories(spark):
    rows = spark.createDataFrame([("execute because",), ("according to the source: step by step",), ("",)], "t string")
    got = rows.select(C.best_weighted(F.lower("t"), {"function_calling": ("execute",), "reasoning": ("because",), "roleplay": ("zzz",), "rag": ("yyy",)}).alias("b"), C.first_matching(F.lower("t")).alias("f")).collect()
    assert [r["b"] for r in got] == ["function_calling", "uncategorized", "uncategorized"]
    assert [r["f"] for r in got] == ["uncategorized", "reasoning", "uncategorized"]
    assert C.domain("nowhere").quality == 0.4 and C.domain("children") == C.Domain(0.3, 0.9, 0.6)


def test_soft_length_is_a_probability(spark):
    for n, v in spark.range(0, 4000, 250).select("id", S.soft_length(F.col("id")).alias("v")).collect():
        want = 1 / (1 + math.exp(-(n - 50) / 150)) / (1 + math.exp(-(2000 - n) / 500))
        assert v == pytest.approx(want)


def test_text_helpers(spark):
    df = spark.createDataFrame([(1, None, ["a", "b"], None), (2, "", None, "body"), (3, "x", None, None)], "id int, text string, tokens array<string>, body string")
    got = {r["id"]: r["r"] for r in T.resolve_text(df, ("text", "content", "body", "tokens"), "r").collect()}
    assert got == {1: "a b", 2: "body", 3: "x"}
    assert {r["r"] for r in T.resolve_text(df, ("nothing",), "r").collect()} == {None}
    rows = spark.createDataFrame([("a" * 2001,), ("b" * 2000,)], "t string").select(F.length(T.head_and_tail(F.col("t"))).alias("n")).collect()
    assert [r["n"] for r in rows] == [1503, 2000]
