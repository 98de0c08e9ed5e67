"""Abusive, hateful or sexual passages by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary passages.
A window (a sentence or entry) that is shorter compressed with the toxic dictionary than
with the ordinary one is suspect; a logistic curve over both lengths calibrates how
much shorter, and the text's score is that of its worst window. Hand labels are per
text, so the toxic windows of a labelled text are found by turns: pick each text's
worst window, train, pick again.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import zstandard

from textweir.llm.units import units

# Passages of the three sorts in several languages, so that a dictionary exists where labels are few.
TOXIC_EXAMPLES = """
shut up you stupid idiot
you are a worthless piece of shit
go kill yourself nobody would miss you
fuck you and your whole family you fucking moron
what a pathetic loser you are, crawl back into your hole
i will find you and break every bone in your body
i hope you die alone
people like them are vermin and should be wiped out
those animals do not belong in our country, throw them out
they breed like rats and stink
all of them are thieves and parasites
send me nudes, i want to touch you all over
watch hot naked girls in hardcore sex videos, uncensored porn
she moaned as he pushed her onto the bed and pulled off her underwear
you dumb bitch, you filthy slut, you whore
shut your mouth you retard
you are too stupid to breathe
ferme ta gueule, espèce de connard
va te faire foutre, sale con
je vais te casser la gueule
tu es une merde, personne ne te supporte
halt die fresse, du dummes arschloch
verpiss dich, du wichser
ich schlage dir die zähne ein
du bist ein wertloses stück scheiße
cállate, imbécil, eres una mierda
vete a la mierda, hijo de puta
te voy a romper la cara
stai zitto, pezzo di merda, vaffanculo
cala a boca, seu idiota de merda
sexe gratuit, filles nues en vidéo, films pornographiques
geile frauen nackt im video, pornofilme kostenlos
sexo gratis, mujeres desnudas en vídeo, películas pornográficas
sesso gratis, donne nude in video
sexo grátis, mulheres nuas em vídeo
les gens comme eux sont des parasites, qu'on les mette dehors
solche leute sind parasiten und gehören rausgeworfen
esa gente son parásitos, hay que echarlos
""".strip().split("\n")
ORDINARY_EXAMPLES = """
the committee discussed the budget for next year
turn off the light in the kitchen please
kill the process before you restart the server
the patient complained about pain in the breast and the anus
sexual reproduction in plants needs pollen
the report describes threats and insults sent to members of the council
this damn printer is broken again
that exam killed me, i am dead tired
the villain shouted that he would destroy the city
cook the chicken breast for twenty minutes
do not be so hard on yourself, it was not a stupid question
le groupe compare les deux tableaux
die gruppe vergleicht die beiden tabellen
el grupo compara las dos tablas
""".strip().split("\n")

_SIGNS = str.maketrans({"@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "!": "i", "€": "e", "|": "l", "+": "t"})
_MIXED = re.compile(r"(?<![a-zà-ÿ])[a-zà-ÿ]*[@$013457!+|€][a-zà-ÿ@$013457!+|€]*")
_SPELT = re.compile(r"(?<![\w*@$])[a-zà-ÿ*@$]([ .\-_])[a-zà-ÿ*@$013457](?:\1[a-zà-ÿ*@$013457])+(?![\w*@$])")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_NUMBER = re.compile(r"\d+")
LONGEST, STEP, RUN = 14, 7, 6
#: Runs of words whose lengths a worker remembers: some 100 MB at most.
MOST_KNOWN = 400_000
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_WORDS = re.compile(r"[^\W\d_]+")
_TWO_LETTERS = re.compile(r"[^\W\d_].*?[^\W\d_]")
_LABEL = re.compile(r"\s*(?:[^\W\d_]+: |[-*>]+ |\d+[.)] )")


def _letters(m: re.Match) -> str:
    whole = m.group()
    word = whole.rstrip("!")
    letters = sum(map(str.isalpha, word))
    if letters < 2 or 2 * letters <= len(word):
        return whole
    return word.translate(_SIGNS) + whole[len(word) :]


def undisguised(text: str) -> str:
    """Lower case, without disguises: signs for letters, spelt-out words, stretched letters, invisible characters."""
    t = _INVISIBLE.sub("", text.lower())
    # A word is spelt out with one kind of separator; another one ends it.
    t = _SPELT.sub(lambda m: m.group().replace(m.group(1), ""), t)
    t = _MIXED.sub(_letters, t)
    t = _LONG.sub(r"\1", t)
    return _NUMBER.sub("0", t)


@cache
def _classes() -> np.ndarray:
    """By code point, a bit each: letter of a disguise, its sign, what is spelt out, separator, digit, invisible."""
    every = "".join(map(chr, range(0x110000)))
    out = np.zeros(len(every), dtype=np.uint8)
    for k, pattern in enumerate(("[a-zà-ÿ]", "[@$013457!+|€]", "[a-zà-ÿ*@$013457]", r"[ .\-_]", r"\d", _INVISIBLE.pattern)):
        out[[m.start() for m in re.finditer(pattern, every)]] |= 1 << k
    return out


def _disguised(t: str, lines: list[str]) -> np.ndarray:
    """Which of the lines of ``t`` (lower case, joined by line feeds) ``undisguised`` may change; it leaves all others as they are."""
    a = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    bits = _classes()[a]
    letter, sign, spelt, between, digit, invisible = ((bits & (1 << k)) != 0 for k in range(6))
    odd = invisible | (digit & (a != ord("0")))
    odd[1:] |= digit[1:] & digit[:-1]
    # An exclamation mark that ends a word stands for itself.
    mark = a == ord("!")
    other = sign & ~mark
    odd[1:] |= (other[1:] & (letter | mark)[:-1]) | (letter[1:] & sign[:-1])
    # Three equal characters in a row; or one that begins a word, a separator, one, the same separator, one.
    odd[2:] |= (a[2:] == a[1:-1]) & (a[1:-1] == a[:-2])
    begins = spelt.copy()
    begins[1:] &= ~spelt[:-1] | (a[:-1] == ord("÷"))
    odd[4:] |= spelt[4:] & between[3:-1] & spelt[2:-2] & (a[1:-3] == a[3:-1]) & begins[:-4]
    ends = np.cumsum([len(x) + 1 for x in lines])
    found = np.zeros(len(lines), dtype=bool)
    found[np.searchsorted(ends, np.flatnonzero(odd), side="right")] = True
    return found


def undisguised_lines(windows: list[str]) -> list[str]:
    """``undisguised`` of each window; the patterns only see those with a trace of a disguise. Windows hold no line feed, so all are looked through at once."""
    if not windows:
        return []
    t = "\n".join(windows).lower()
    lines = t.split("\n")
    at = np.flatnonzero(_disguised(t, lines)).tolist()
    if at:
        for i, bare in zip(at, undisguised("\n".join([lines[i] for i in at])).split("\n")):
            lines[i] = bare
    return lines


@dataclass(frozen=True)
class AbuseSpec:
    #: Labelled texts used for fitting, abusive and others, chosen by a hash of their ids.
    max_abusive: int = 4000
    max_ordinary: int = 8000
    dictionary_bytes: int = 256 * 1024
    turns: int = 3
    #: Log-odds from which a window of a text labelled as abusive is taken for a toxic one.
    pick_above: float = -1.0
    seed: int = 5


def _parameters() -> zstandard.ZstdCompressionParameters:
    # Matches from four bytes on, so that single words tell in short windows.
    return zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_DFAST, min_match=4, window_log=19, hash_log=16, chain_log=16, write_checksum=False, write_content_size=False, write_dict_id=False
    )


class _Compressor:
    """Compression with a dictionary's content. Its entropy tables are left out: the two sides have very different amounts to learn them from."""

    def __init__(self, content: bytes, known: dict[bytes, int] | None = None) -> None:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=_parameters())
        self.tool, self.known = zstandard.ZstdCompressor(dict_data=d, compression_params=_parameters()), known

    def __call__(self, text: bytes) -> bytes:
        return self.tool.compress(text)

    def lengths(self, texts: list[bytes]) -> list[int]:
        """Bytes of each text compressed; with ``known``, each is compressed only once."""
        if self.known is not None:
            new = [x for x in dict.fromkeys(texts) if x not in self.known]
            self.known.update(zip(new, self._all(new)))
            return [self.known[x] for x in texts]
        return self._all(texts)

    def _all(self, texts: list[bytes]) -> list[int]:
        if not all(texts):  # the tool takes no empty ones when given many
            return [len(self(x)) for x in texts]
        return [len(x) for x in self.tool.multi_compress_to_buffer(texts)] if texts else []


def _trained(windows: list[str], size: int) -> bytes:
    """The content of a dictionary trained on the windows, on both sides alike.

    The trainer takes too little from few short samples, so each window goes in whole and by
    its runs of words; what it picks has at most ``size`` bytes.
    """
    samples = [w.encode() for w in windows]
    for w in windows:
        tokens = w.split(" ")
        samples += [" ".join(tokens[i : i + RUN]).encode() for i in range(1, max(1, len(tokens) - RUN + 1))]
    return zstandard.train_dictionary(size, samples, level=3).as_bytes()


def windows_of(text: str) -> list[str]:
    """The windows of a text: its units, and overlapping runs of ``LONGEST`` words where a unit is longer; none of numbers and signs alone."""
    out = []
    for u in units(_NUMBER.sub("0", text.lower())):
        w = " ".join((u[label.end() :] if (label := _LABEL.match(u)) else u).split())
        if not _TWO_LETTERS.search(w):
            continue
        if len(w) < 6 * LONGEST:
            out.append(w)
            continue
        tokens = w.split(" ")
        if len(tokens) <= LONGEST + STEP:
            out.append(w)
        else:
            out += [" ".join(tokens[i : i + LONGEST]) for i in range(0, len(tokens) - STEP, STEP)]
    return out


def _lengths(windows: list[str], toxic, ordinary, known: dict[str, tuple[int, int, int]] | None = None) -> np.ndarray:
    """Bytes of each window: plain, with the toxic and with the ordinary dictionary, the frame's fixed bytes taken off.

    ``known`` keeps those of earlier calls with the same dictionaries while it has room.
    """
    known = {} if known is None else known
    if len(known) > MOST_KNOWN:
        known.clear()
    new = [w for w in dict.fromkeys(windows) if w not in known]  # equal ones are compressed once
    if new:
        raw = [w.encode() for w in new]
        known.update(zip(new, zip(map(len, raw), toxic.lengths(raw), ordinary.lengths(raw))))
    out = np.array(list(map(known.__getitem__, windows)), dtype=float).reshape(-1, 3)
    out[:, 1:] = np.maximum(out[:, 1:] - 6, 1)
    return out


def _bare(windows: list[str], toxic, ordinary) -> tuple[list[str], np.ndarray]:
    """All windows without disguises, and their lengths."""
    bare = undisguised_lines(windows)
    return bare, _lengths(bare, toxic, ordinary)


def _features(windows: list[str], lengths: np.ndarray, toxic, ordinary, known: dict[str, tuple[int, int, int]] | None = None) -> np.ndarray:
    """What the curve sees: both lengths of the window, and the best of its runs of a few words."""
    n, t, o = lengths[:, 0] + 6, lengths[:, 1], lengths[:, 2]
    runs, of, short = [], [], []
    for i, w in enumerate(windows):
        tokens = w.split(" ")
        if len(tokens) <= RUN:  # it is its only run
            short.append(i)
            continue
        for j in range(0, len(tokens) - RUN // 2, RUN // 2):
            runs.append(" ".join(tokens[j : j + RUN]))
            of.append(i)
    sub = np.concatenate([lengths[short], _lengths(runs, toxic, ordinary, known)])
    of = np.array(short + of, dtype=int)
    gain, ratio = (sub[:, 2] - sub[:, 1]) / 10, np.log(sub[:, 2] / sub[:, 1])
    best = np.full((len(windows), 2), -9.0)
    np.maximum.at(best[:, 0], of, gain)
    np.maximum.at(best[:, 1], of, ratio)
    nearer = np.bincount(of, gain > 0.15, minlength=len(windows)) / np.maximum(np.bincount(of, minlength=len(windows)), 1)
    total = np.bincount(of, np.maximum(gain, 0), minlength=len(windows))
    x = np.column_stack([t / n, o / n, (o - t) / n, np.log(o / t), np.log(n), (o - t) / 10, best, nearer, total])
    return np.column_stack([x, x[:, :4] ** 2, x[:, 2] * x[:, 4], x[:, 3] * x[:, 4], best[:, 0] * best[:, 1], best[:, 0] * x[:, 1]])


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + penalty * w
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x / len(y) + penalty * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


@dataclass(frozen=True)
class AbuseModel:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    threshold: float

    def _tools(self):
        # The model is held with its tools, so that another one at the same place in memory isn't taken for it.
        if _TOOLS.get("model") is not self:
            made = []
            for data in (self.toxic, self.ordinary):
                made.append(_Compressor(data))
            _TOOLS.update(model=self, made=made, known={})
        return _TOOLS["made"]

    def scores(self, texts: list[str]) -> tuple[np.ndarray, list[str]]:
        """The score of each text's worst window (0 to 1), and the window.

        Empty and blank texts have 0 and no window. Long texts are
        scored whole; equal windows score the same, the first of them is named.
        """
        found = [windows_of(t) for t in texts]
        flat = [w for f in found for w in f]
        value, worst = np.zeros(len(texts)), [""] * len(texts)
        if flat:
            toxic, ordinary = self._tools()
            of = np.repeat(np.arange(len(texts)), [len(f) for f in found])
            bare, lengths = _bare(flat, toxic, ordinary)
            z = _features(bare, lengths, toxic, ordinary, _TOOLS["known"]) @ self.weights[:-1] + self.weights[-1]
            for i, w, score in zip(of, bare, 1 / (1 + np.exp(-np.clip(z, -30, 30)))):
                if score > value[i]:
                    value[i], worst[i] = score, w
        return value, worst


_TOOLS: dict = {}


def fit_abuse(rows: list[tuple[str, bool]], spec: AbuseSpec = AbuseSpec()) -> AbuseModel:
    """Fit dictionaries, curve and threshold on labelled texts; empty ones don't count. Works from the written examples alone too."""
    texts = [(windows_of(t), y) for t, y in rows]
    texts = [(w, y) for w, y in texts if w]
    flat, ends = undisguised_lines([x for w, _ in texts for x in w]), np.cumsum([len(w) for w, _ in texts]).tolist()
    bare = [flat[a:b] for a, b in zip([0, *ends], ends)]
    negative = [w for w, (_, y) in zip(bare, texts) if not y]
    positive = [w for w, (_, y) in zip(bare, texts) if y]
    raw_negative = [w for w, y in texts if not y]
    rng = np.random.default_rng(spec.seed)
    side_n, side_p = rng.integers(0, 2, len(negative)), rng.integers(0, 2, len(positive))
    size = spec.dictionary_bytes

    def plain(side: int | None) -> list[str]:
        own = [w for s, ws in zip(side_n, raw_negative) if side is None or s == side for w in ws]
        return list(dict.fromkeys(own)) + ORDINARY_EXAMPLES

    # The ordinary side stays the same for all turns.
    ordinary = [_Compressor(_trained(plain(s), size), {}) for s in (0, 1)]
    toxic_now = [_Compressor(_trained(TOXIC_EXAMPLES, size))] * 2
    weights = np.zeros(0)
    unusual = _unusual(positive, raw_negative)
    plain_x: dict[int, np.ndarray] = {}

    def judged(windows: list[str], other: int) -> np.ndarray:
        """Features of windows without disguises, by the dictionaries of one half."""
        return _features(windows, _lengths(windows, toxic_now[other], ordinary[other]), toxic_now[other], ordinary[other])

    for _ in range(spec.turns):
        # Lengths always come from dictionaries of the other half, as they will for unseen texts.
        picked = []
        for s, ws, first in zip(side_p, positive, unusual):
            if not len(weights):
                picked.append(first)
                continue
            picked.append([w for w, z in zip(ws, judged(ws, 1 - s) @ weights[:-1] + weights[-1]) if z > spec.pick_above])
        toxic_now = [
            _Compressor(_trained(TOXIC_EXAMPLES + list(dict.fromkeys(w for s, ws in zip(side_p, picked) if s == side for w in ws)), size))
            for side in (0, 1)
        ]
        x, y = [], []
        for side in (0, 1):
            good = [w for s, ws in zip(side_n, negative) if s == side for w in ws]
            bad = [w for s, ws in zip(side_p, picked) if s == side for w in ws]
            if good:
                x.append(judged(good, 1 - side))
                y.append(np.zeros(len(x[-1])))
                plain_x[side] = x[-1]
            if bad:
                x.append(judged(bad, 1 - side))
                y.append(np.ones(len(x[-1])))
        for windows, value in ((TOXIC_EXAMPLES, 1), (ORDINARY_EXAMPLES, 0)):
            half = len(windows) // 2
            other = _Compressor(_trained(windows[:half], size))
            pair = (other, ordinary[0]) if value else (toxic_now[0], ordinary[0])
            x.append(_features(windows[half:], _lengths(windows[half:], *pair), *pair))
            y.append(np.full(len(windows) - half, value))
        x, y = np.concatenate(x), np.concatenate(y)
        weights = _logistic(x, y)
    # The threshold with the best F1 over whole texts.
    z_all = []
    for group, sides, label in ((negative, side_n, 0), (positive, side_p, 1)):
        for side in (0, 1):
            own = [ws for s, ws in zip(sides, group) if s == side]
            if own:
                # The ordinary texts' features of the last turn still hold.
                seen = judged([w for ws in own for w in ws], 1 - side) if label else plain_x[side]
                z = seen @ weights[:-1] + weights[-1]
                starts = np.cumsum([0, *(len(ws) for ws in own[:-1])])
                z_all += [(float(v), label) for v in np.maximum.reduceat(z, starts)]
    threshold = _best_cut(z_all)
    final_t, final_o = TOXIC_EXAMPLES + list(dict.fromkeys(w for ws in picked for w in ws)), plain(None)
    return AbuseModel(_trained(final_t, size), _trained(final_o, size), weights, float(1 / (1 + np.exp(-threshold))))


def _unusual(positive: list[list[str]], negative: list[list[str]]) -> list[list[str]]:
    """Of each positive text, the window whose words most set positive texts apart; none where nothing does."""
    words = [[set(_WORDS.findall(w)) for w in ws] for ws in positive]
    plain, toxic = Counter(), Counter()
    for ws in negative:
        plain.update({x for w in ws for x in _WORDS.findall(w)})
    for ws in words:
        toxic.update(set().union(*ws))
    n, p = len(negative) + 1, len(positive) + 1
    odds = {x: np.log((c / p) / ((plain[x] + 0.5) / n)) for x, c in toxic.items() if c > 1}
    out = []
    for ws, sets in zip(positive, words):
        value = [sum(max(0.0, odds.get(x, 0.0)) for x in s) / (len(s) + 3) for s in sets]
        best = int(np.argmax(value))
        out.append([ws[best]] if value[best] > 0.5 else [])
    return out


def _best_cut(pairs: list[tuple[float, int]]) -> float:
    if not any(y for _, y in pairs):
        return 0.0
    ordered = sorted(pairs, reverse=True)
    total = sum(y for _, y in ordered)
    f1, cuts, hits = [], [], 0
    for i, (z, y) in enumerate(ordered):
        hits += y
        f1.append(2 * hits / (i + 1 + total))
        cuts.append((z + (ordered[i + 1][0] if i + 1 < len(ordered) else z - 1)) / 2)
    # Of the cuts that are as good within the labels' noise, the strictest, but none beyond even odds.
    return float(np.clip(next(c for c, f in zip(cuts, f1) if f >= max(f1) - 0.005), -1.5, 0.0))
