"""Reading level of English prose by regularised ordinal regression.

Features of a text: lexical diversity, word rarity (share of words outside the common
ones, word length, and a word grade learnt from graded texts), connectives, a proxy
for clause depth (subordinators, relatives and inner marks) and lengths. Sentence
features enter through medians and quartiles, so that a stray sentence of another level
changes nothing. A proportional-odds model with a quadratic penalty gives the level.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np

from textweir.llm.units import units

LEVELS = (1, 2, 3, 4)
LEAST_WORDS = 40
_WORD = re.compile(r"[a-z]+(?:['’][a-z]+)?")

# Connectives of argument and subordinating words of English.
CONNECTIVES = frozenset(
    "however although though because therefore thus hence moreover furthermore nevertheless nonetheless whereas while since unless until despite "
    "besides consequently accordingly conversely notwithstanding albeit insofar inasmuch whence thereby wherein whereby lest provided then so but and".split()
)
SUBORDINATORS = frozenset("that which who whom whose where when if because although though since unless until whereas while as than whether after before once lest".split())
# Endings of learned words.
LEARNED_ENDINGS = ("tion", "sion", "ment", "ance", "ence", "ity", "ism", "ical", "ious", "ology", "ate", "ise", "ize", "ness", "able", "ible", "ive", "ual")

FEATURES = (
    "grade_median grade_low grade_high grade_mean grade_top_words words_median words_low words_high length_median length_high long_words learned_words "
    "subordinators connectives inner_marks diversity log_words known_share grade_1 grade_2 grade_3 grade_4"
).split()


@dataclass(frozen=True)
class LevelSpec:
    #: Graded texts used for fitting, chosen by a hash of their ids.
    max_training_texts: int = 4000
    #: Weight of the prior in a word's grade, in texts.
    grade_prior: float = 1.0
    penalty: float = 0.02
    rounds: int = 400


def sentence_words(text: str) -> list[list[str]]:
    """Lower-cased words of each unit of two words and more; shorter units join the next one, at the end the one before."""
    out, short = [], []
    for u in units(text.lower()):
        short += _WORD.findall(u)
        if len(short) >= 2:
            out.append(short)
            short = []
    if short and out:
        out[-1] = out[-1] + short
    return out


@dataclass(frozen=True)
class WordGrades:
    """The mean level of the graded texts that use a word, drawn to the mean by a prior."""

    grades: dict[str, float]
    base: float

    @staticmethod
    def learn(docs: list[list[list[str]]], levels: np.ndarray, prior: float) -> "WordGrades":
        base = float(levels.mean()) if len(levels) else 2.5
        total, seen = defaultdict(float), defaultdict(float)
        for doc, level in zip(docs, levels):
            for w in {w for s in doc for w in s}:
                total[w] += level - base
                seen[w] += 1
        return WordGrades({w: base + total[w] / (seen[w] + prior) for w in seen}, base)


def features(docs: list[list[list[str]]], texts: list[str], grades: WordGrades) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    out = np.zeros((len(docs), len(FEATURES)))
    known, base = grades.grades, grades.base
    for d, (doc, text) in enumerate(zip(docs, texts)):
        if not doc:
            out[d, :5] = base
            continue
        flat = [w for s in doc for w in s]
        n = len(flat)
        sizes = np.array([len(s) for s in doc])
        g = np.array([known.get(w, base) for w in flat])
        length = np.array([len(w) for w in flat])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        by_grade = np.add.reduceat(g, starts) / sizes
        by_length = np.add.reduceat(length, starts) / sizes
        order = np.sort(by_grade)
        words = np.sort(sizes)
        k = len(order)
        distinct = set(flat)
        nearest = np.bincount(np.clip(np.rint(by_grade + 0.35 * (by_grade - base)), 1, 4).astype(int), sizes, minlength=5)[1:5] / n
        out[d] = (
            order[k // 2],
            order[k // 4],
            order[(3 * k) // 4],
            g.mean(),
            np.sort(g)[(9 * n) // 10],
            np.log(words[k // 2]),
            np.log(words[k // 4]),
            np.log(words[(3 * k) // 4]),
            np.sort(by_length)[k // 2],
            np.sort(by_length)[(3 * k) // 4],
            (length >= 8).mean(),
            sum(1 for w in distinct if len(w) > 6 and w.endswith(LEARNED_ENDINGS)) / len(distinct),
            sum(1 for w in flat if w in SUBORDINATORS) / k,
            sum(1 for w in flat if w in CONNECTIVES) / k,
            (text.count(",") + text.count(";") + text.count("(")) / k,
            len(distinct) / n**0.5 / 4,
            np.log(n),
            sum(1 for w in distinct if w in known) / len(distinct),
            *nearest,
        )
    return out


@dataclass(frozen=True)
class LevelModel:
    grades: WordGrades
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        """A position on the scale of levels; the cuts between the levels are in ``cuts``."""
        x = (features([sentence_words(t) for t in texts], texts, self.grades) - self.mean) / self.scale
        return x @ self.weights

    def levels(self, texts: list[str]) -> np.ndarray:
        """A level for each text, also for empty ones and other languages, where it says nothing; queries leave those out."""
        return 1 + (self.score(texts)[:, None] > self.cuts).sum(1) if texts else np.zeros(0, dtype=int)


def _ordinal(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportional odds: P(level > j) = sigmoid(x w - cut_j), fitted by Adam on the penalised likelihood."""
    n, m = x.shape
    # cuts are kept in order by exponentiated gaps
    share = np.array([(y > j).mean() for j in LEVELS[:-1]])
    first = np.sort(-np.log(np.clip(share, 0.02, 0.98) / (1 - np.clip(share, 0.02, 0.98))))
    theta = np.concatenate([np.zeros(m), [first[0]], np.log(np.maximum(np.diff(first), 0.05))])
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, gaps = theta[:m], np.exp(theta[m + 1 :])
        cuts = np.concatenate([[theta[m]], theta[m] + np.cumsum(gaps)])
        at = x @ w
        up = 1 / (1 + np.exp(-np.clip(at[:, None] - cuts, -30, 30)))
        full = np.column_stack([np.ones(n), up, np.zeros(n)])
        rows = np.arange(n)
        p = np.maximum(full[rows, y - 1] - full[rows, y], 1e-9)
        slope = np.column_stack([np.zeros(n), up * (1 - up), np.zeros(n)])
        d_at = -(slope[rows, y - 1] - slope[rows, y]) / p
        d_cut = np.zeros((n, len(LEVELS) + 1))
        np.add.at(d_cut, (rows, y - 1), slope[rows, y - 1] / p)
        np.add.at(d_cut, (rows, y), -slope[rows, y] / p)
        d_cut = d_cut[:, 1:-1].mean(0)
        grad = np.concatenate([x.T @ d_at / n + penalty * w, [d_cut.sum()], [gaps[j] * d_cut[j + 1 :].sum() for j in range(len(gaps))]])
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        theta = theta - 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return theta[:m], np.concatenate([[theta[m]], theta[m] + np.cumsum(np.exp(theta[m + 1 :]))])


def fit_levels(rows: list[tuple[str, int]], spec: LevelSpec = LevelSpec()) -> LevelModel:
    """Fit on graded texts. Word grades for the regression come from the other half of the texts."""
    texts, y = [t for t, _ in rows], np.array([k for _, k in rows], dtype=int)
    docs = [sentence_words(t) for t in texts]
    half = np.arange(len(rows)) % 2
    x = np.zeros((len(rows), len(FEATURES)))
    for side in (0, 1):
        own, other = np.flatnonzero(half == side), np.flatnonzero(half != side)
        learnt = WordGrades.learn([docs[i] for i in other], y[other], spec.grade_prior)
        x[own] = features([docs[i] for i in own], [texts[i] for i in own], learnt)
    if not len(rows):
        return LevelModel(WordGrades({}, 2.5), np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES)), np.array([-1.0, 0.5, 2.0]))
    mean, scale = x.mean(0), x.std(0) + 1e-3
    weights, cuts = _ordinal((x - mean) / scale, y, spec.penalty, spec.rounds)
    return LevelModel(WordGrades.learn(docs, y, spec.grade_prior), mean, scale, weights, cuts)
