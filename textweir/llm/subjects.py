"""Subject areas of documents by an anchored non-negative factorisation of the document-term matrix.

Each subject is one component, anchored by hand-labelled texts and by the words of
its description; one is anchored by texts labelled as junk, and free components take
up what has no subject. Alternating
multiplicative updates (Kullback-Leibler) keep the anchors, because a weight that
starts at nothing stays at nothing. A text's mixture then weighs the subjects of its
terms unit by unit; the subjects of at least a quarter of the units are the text's.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np

from textweir.llm.units import units

_TERM = re.compile(r"[^\W\d_]{2,}")


def unit_terms(text: str) -> list[list[str]]:
    """The distinct terms of each unit."""
    return [list(dict.fromkeys(_TERM.findall(u))) for u in units(text.lower())]


@dataclass(frozen=True)
class SubjectSpec:
    free_components: int = 1
    #: How many times more often than elsewhere a term must be used to start in a component.
    least_lift: float = 2.0
    rest_prior: float = 0.3
    rounds: int = 40
    fold_in_rounds: int = 12
    #: A unit deals with a subject when its terms speak for it with this weight ...
    term_part: float = 0.6
    #: ... and at least with this part of the weight of the unit's leading subject.
    beside: float = 0.5
    #: Texts with more of their terms' weight in the junk component have no subject.
    junk_part: float = 0.3
    #: Share of units that makes a subject one of the text's.
    unit_share: float = 0.25
    #: Labelled texts used for fitting, chosen by a hash of their ids.
    max_training_texts: int = 4000
    max_junk_texts: int = 2000
    seed: int = 3


@dataclass(frozen=True)
class SubjectModel:
    subjects: tuple[str, ...]
    terms: dict[str, int]
    weights: np.ndarray  # terms x components, each component sums to 1
    speaks: np.ndarray  # terms x subjects: the subject's part of a term's use
    cut: float
    spec: SubjectSpec

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text, the share of its units that deal with each subject, and its mixture of components."""
        known, n, k = self.terms, len(texts), len(self.subjects)
        ids, unit_of, doc_of, units_in = [], [], [], np.zeros(n)
        u = 0
        for d, text in enumerate(texts):
            rows = unit_terms(text)
            units_in[d] = len(rows)
            for row in rows:
                for t in row:
                    i = known.get(t)
                    if i is not None:
                        ids.append(i)
                        unit_of.append(u)
                        doc_of.append(d)
                u += 1
        ids, unit_of, doc_of = np.array(ids, dtype=np.int64), np.array(unit_of, dtype=np.int64), np.array(doc_of, dtype=np.int64)
        mixture = _fold_in(self.weights[ids], doc_of, n, self.spec.fold_in_rounds)
        if not len(ids):
            return np.zeros((n, k)), mixture
        # Terms of several subjects count for those that the whole text has.
        prior = mixture[:, :k] / np.maximum(mixture[:, :k].sum(1, keepdims=True), 1e-12) + 0.02
        said = self.speaks[ids] * prior[doc_of]
        said /= np.maximum(said.sum(1, keepdims=True), 1e-12)
        said *= self.speaks[ids].sum(1, keepdims=True)
        unit_doc = np.zeros(u, dtype=np.int64)
        unit_doc[unit_of] = doc_of
        weight = np.column_stack([np.bincount(unit_of, said[:, j], minlength=u) for j in range(k)])
        deals = (weight >= self.spec.term_part) & (weight >= self.spec.beside * weight.max(1, keepdims=True))
        counted = np.column_stack([np.bincount(unit_doc, deals[:, j], minlength=n) for j in range(k)])
        junk = mixture[:, k] / np.maximum(mixture[:, : k + 1].sum(1), 1e-12)
        counted[junk > self.spec.junk_part] = 0
        return counted / np.maximum(units_in, 1)[:, None], mixture

    def assign(self, texts: list[str]) -> list[list[str]]:
        """The subjects of each text in order of the alphabet; none for empty texts, junk and texts without a known term."""
        shares, _ = self.shares(texts)
        return [[self.subjects[j] for j in np.flatnonzero(row >= self.cut)] for row in shares]


def _fold_in(weights: np.ndarray, doc_of: np.ndarray, n: int, rounds: int) -> np.ndarray:
    """Mixtures that explain the terms of each document with fixed components."""
    k = weights.shape[1]
    h = np.full((n, k), 1.0 / k)
    flat = doc_of[:, None] * k + np.arange(k)
    for _ in range(rounds):
        part = weights * h[doc_of]
        part /= np.maximum(part.sum(1, keepdims=True), 1e-12)
        h = np.bincount(flat.ravel(), part.ravel(), minlength=n * k).reshape(n, k) + 1e-4
        h /= h.sum(1, keepdims=True)
    return h


def fit_subjects(rows: list[tuple[str, list[str]]], about: list[tuple[str, str]], junk: list[str] = [], spec: SubjectSpec = SubjectSpec()) -> SubjectModel:
    """Fit on labelled texts; ``about`` gives each subject's name and description. Works, poorly, without any label."""
    subjects = tuple(sorted(s for s, _ in about))
    at = {s.lower(): j for j, s in enumerate(subjects)}
    k, free = len(subjects), spec.free_components
    docs = [(unit_terms(t), {at[a] for a in answers if a in at}) for t, answers in rows]
    docs += [(unit_terms(t), {k}) for t in junk]
    for s, words in about:
        docs += [([_TERM.findall(f"{s} {words}".lower())], {at[s.lower()]})] * 3
    seen = Counter(t for units_, _ in docs for t in {x for u in units_ for x in u})
    terms = {t: i for i, t in enumerate(sorted(t for t, c in seen.items() if c >= 2))}
    ids, of, count = [], [], []
    for d, (units_, _) in enumerate(docs):
        for t, c in Counter(x for u in units_ for x in u if x in terms).items():
            ids.append(terms[t])
            of.append(d)
            count.append(c)
    ids, of, count = np.array(ids), np.array(of), np.array(count, dtype=float)
    n, m, comps = len(docs), len(terms), k + 1 + free
    rng = np.random.default_rng(spec.seed)
    h = np.full((n, comps), 1e-3)
    for d, (_, own) in enumerate(docs):
        h[d, k + 1 :] = 1.0 + 0.1 * rng.random(free)
        for j in own:
            h[d, j] = 1.0
    h /= h.sum(1, keepdims=True)
    # A component starts from the terms that its own texts use more than the rest do; the others stay out of it.
    own = np.zeros((n, comps))
    for d, (_, labels) in enumerate(docs):
        for j in labels:
            own[d, j] = 1 / len(labels)
    total = np.bincount(ids, count, minlength=m)
    w = np.zeros((m, comps))
    for j in range(comps):
        if j > k:
            w[:, j] = total + 0.1 * rng.random(m)
            continue
        inside = np.bincount(ids, count * own[of, j], minlength=m)
        rate = inside / max(inside.sum(), 1)
        rest = (total - inside + spec.rest_prior) / max((total - inside).sum(), 1)
        w[:, j] = np.where(rate > spec.least_lift * rest, inside, 0)
    w /= np.maximum(w.sum(0), 1e-12)
    anchor = h.copy()
    for _ in range(spec.rounds):
        part = w[ids] * h[of]
        part *= (count / np.maximum(part.sum(1), 1e-12))[:, None]
        h = np.column_stack([np.bincount(of, part[:, j], minlength=n) for j in range(comps)]) * (anchor > 2e-3) + 1e-6 + 0.02 * anchor
        w = np.column_stack([np.bincount(ids, part[:, j], minlength=m) for j in range(comps)])
        w[:, k + 1 :] += 1e-9
        used = np.maximum(w.sum(0), 1e-12)
        w /= used
        h /= h.sum(1, keepdims=True)
    mass = w * used
    speaks = mass[:, :k] / np.maximum(mass.sum(1, keepdims=True), 1e-12)
    model = SubjectModel(subjects, terms, w, speaks, spec.unit_share, spec)
    return model
