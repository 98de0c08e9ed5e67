"""Per-document text quality statistics and the structural kind of a text: prose, list, table or junk.

Function-word and character-class distributions are compared with prose profiles of
several languages by Jensen-Shannon divergence; with plain counts beside them they
make a vector, which is assigned to the nearest of the structural profiles.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

KINDS = ("prose", "list", "table", "junk")

# Common function words by language, most frequent first.
FUNCTION_WORDS = {
    "en": "the of and to a in is that it for was on with as be by at this from or are an not but have which they you we he his her has were their there had can will its if so more when who what she would than all one do how about some no my into our up your them these other then",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ou aux cette comme mais on nous sa elle été être leur ces tout si l d qu n c s y dont sans fait je vous",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde está nos porque qué",
    "it": "di e il la che in a per un è del non una sono con i si da le dei come al nel più lo gli della alla ma ha anche o su se dal questo",
    "pt": "de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito nos já eu também só pelo",
    "nl": "de van het een en in is dat op te zijn met voor niet aan er die om ook als bij maar door naar uit over dan nog was hij wordt heeft zij",
}
# Typical shares of character classes in prose (letters, capitals, digits, spaces, line ends, sentence marks, commas, quotes and brackets, dashes, cell marks, other symbols, odd characters).
PROSE_CLASSES = (0.77, 0.03, 0.008, 0.155, 0.004, 0.012, 0.009, 0.006, 0.003, 0.0005, 0.0015, 0.0005)
#: Zipf's exponent and offset give the profile's shares by rank: no table of measured frequencies.
ZIPF_OFFSET = 2.7

LETTER, CAPITAL, DIGIT, SPACE, LINE, STOP, COMMA, QUOTE, DASH, CELL, SYMBOL, ODD = range(12)
_ITEM = re.compile(r"^\s*(?:[-*•+–·▪◦]|\[[ xX]?\]|\(?\d{1,3}[.):]|\(?[a-zA-Z][.)])\s+\S")
_CELLS = re.compile(r"\||\t|;|,| {2,}|::| / ")
_STOPS = tuple(".!?…:。！？।؟\"'”’»)")
_VOWEL_RUN = re.compile(r"[aeiouyàâäáãåæéèêëíìîïóòôöõøœúùûüýÿ]+")
_LONG_SYMBOLS = re.compile(r"(\S)\1{7,}")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|&[a-z#0-9]{2,8};")


def _class_table() -> np.ndarray:
    table = np.full(0x10000, ODD, dtype=np.uint8)
    for c in range(0x10000):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind in ("Lu", "Lt"):
            table[c] = CAPITAL
        elif kind[0] in "LM":
            table[c] = LETTER
        elif kind[0] == "N":
            table[c] = DIGIT
        elif ch in "\n\r\v\f  \u0085":
            table[c] = LINE
        elif ch == "\t":
            table[c] = CELL
        elif kind == "Zs":
            table[c] = SPACE
        elif ch in ".!?…。！？।؟":
            table[c] = STOP
        elif ch in ",،、，":
            table[c] = COMMA
        elif kind in ("Pi", "Pf", "Ps", "Pe") or ch in "\"'":
            table[c] = QUOTE
        elif kind == "Pd":
            table[c] = DASH
        elif ch in "|;/":
            table[c] = CELL
        elif kind[0] in "PS":
            table[c] = SYMBOL
    # Signs of text decoded in the wrong charset.
    for ch in "�­¤¶ÂÃ":
        table[ord(ch)] = ODD
    return table


_CLASSES = _class_table()


def class_shares(texts: list[str]) -> np.ndarray:
    """Counts of character classes, one row a text, in one vectorised pass."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), dtype=np.uint32)
    codes = _CLASSES[np.minimum(points, 0xFFFF)]
    docs = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(docs * 12 + codes, minlength=len(texts) * 12).reshape(-1, 12).astype(float)


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Divergence in bits of distributions along the last axis."""
    m = (p + q) / 2

    def kl(a: np.ndarray) -> np.ndarray:
        return np.sum(np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0), axis=-1)

    return (kl(p) + kl(q)) / 2


def _profiles() -> tuple[dict[str, list[tuple[int, int]]], list[np.ndarray]]:
    where: dict[str, list[tuple[int, int]]] = {}
    shapes = []
    for k, listed in enumerate(FUNCTION_WORDS.values()):
        own = listed.split()
        for r, w in enumerate(own):
            where.setdefault(w, []).append((k, r))
        weight = 1 / (np.arange(len(own)) + 1 + ZIPF_OFFSET)
        shapes.append(np.append(0.45 * weight / weight.sum(), 0.55))
    return where, shapes


_WHERE, _SHAPES = _profiles()
_LANGS = list(FUNCTION_WORDS)
_WIDTHS = [len(s) for s in _SHAPES]
_OFFSETS = np.concatenate([[0], np.cumsum(_WIDTHS)])
_SLOTS = {w: [int(_OFFSETS[k]) + r for k, r in at] for w, at in _WHERE.items()}

STATISTICS = (
    "n_chars n_words n_lines mean_word_length symbol_ratio digit_ratio capital_ratio odd_ratio stop_ratio comma_ratio cell_ratio space_ratio quote_ratio "
    "lines_ending_in_punctuation item_lines mean_line_words line_word_spread cell_agreement number_ends common_words word_repetition vowelless_words "
    "language_divergence class_divergence long_runs mark_up words_per_stop mixed_words line_start_repeats short_lines common_pairs"
).split()


@lru_cache(200_000)
def _token(token: str) -> tuple[str, int, list[int] | None, bool] | None:
    """A token's bare word, its length, its places in the profiles and whether it mixes letters and digits."""
    bare = token.strip(".,;:!?\"'()[]«»“”¿¡…|*-")
    if not bare:
        return None
    joined = not bare.isalpha() and any(c.isdigit() for c in bare) and any(c.isalpha() for c in bare)
    return bare, len(bare), _SLOTS.get(bare), joined


@lru_cache(200_000)
def _odd_word(word: str) -> bool:
    """Whether a word in Latin letters has hardly any vowel or is very long."""
    return word.isascii() and (len("".join(_VOWEL_RUN.findall(word))) * 5 < len(word) or len(word) > 22)


def statistics(texts: list[str]) -> tuple[np.ndarray, list[str]]:
    """A row of ``STATISTICS`` for each text, and the language whose prose profile is nearest.

    Texts are taken whole. An empty or blank text has zeros for all shares and counts, 1 for ``n_chars`` at the least.
    """
    n = len(texts)
    if not n:
        return np.zeros((0, len(STATISTICS))), []
    classes = class_shares(texts)
    chars = np.maximum(classes.sum(1), 1)
    shares = classes / chars[:, None]
    slots = np.zeros((n, int(_OFFSETS[-1])))
    plain = np.zeros((n, 17))
    for i, text in enumerate(texts):
        common = pairs = length = mixed = odd_words = nw = 0
        before = False
        distinct = {}
        row = slots[i]
        for token in text.lower().split():
            word = _token(token)
            if word is None:
                continue
            bare, size, at, joined = word
            nw += 1
            length += size
            mixed += joined
            distinct[bare] = word
            if at:
                common += 1
                pairs += before
                before = True
                for s in at:
                    row[s] += 1
            else:
                before = False
        spelt = [_odd_word(w) for w in distinct if w.isalpha() and len(w) > 2]
        odd_words = sum(spelt)
        lines = [x for x in text.splitlines() if x.strip()]
        nl = max(1, len(lines))
        per_line = [len(x.split()) for x in lines] or [0]
        mean_line = sum(per_line) / nl
        spread = (sum((x - mean_line) ** 2 for x in per_line) / nl) ** 0.5 / (mean_line + 1)
        cells = [len(_CELLS.findall(x)) for x in lines] if nl > 1 else []
        agreement = 0.0
        if nl > 1:
            usual = max(set(cells), key=lambda c: (cells.count(c), c))
            agreement = cells.count(usual) / nl * min(usual, 4)
        starts = [x.split(None, 1)[0] for x in lines]
        plain[i] = (
            nw,
            len(lines),
            length / max(1, nw),
            sum(x.rstrip().endswith(_STOPS) for x in lines) / nl,
            sum(1 for x in lines if _ITEM.match(x)) / nl,
            mean_line,
            spread,
            agreement,
            sum(1 for x in lines if x.rstrip()[-1:].isdigit()) / nl,
            common / max(1, nw),
            1 - len(distinct) / max(1, nw),
            odd_words / max(1, len(spelt)),
            len(_LONG_SYMBOLS.findall(text)),
            len(_TAG.findall(text)) / max(1, nw),
            mixed / max(1, nw),
            1 - len(set(starts)) / nl if nl > 1 else 0,
            pairs / max(1, nw - 1),
        )
    nw = np.maximum(plain[:, 0], 1)
    divergences = np.empty((n, len(_SHAPES)))
    for k, shape in enumerate(_SHAPES):
        own = slots[:, _OFFSETS[k] : _OFFSETS[k + 1]].copy()
        own[:, -1] = np.maximum(0, nw - own[:, :-1].sum(1))
        divergences[:, k] = jensen_shannon(own / np.maximum(own.sum(1), 1)[:, None], shape)
    nearest = divergences.argmin(1)
    letters = classes[:, LETTER] + classes[:, CAPITAL]
    out = np.column_stack(
        [
            chars,
            plain[:, 0],
            plain[:, 1],
            plain[:, 2],
            shares[:, SYMBOL] + shares[:, CELL],
            shares[:, DIGIT],
            classes[:, CAPITAL] / np.maximum(letters, 1),
            shares[:, ODD],
            shares[:, STOP],
            shares[:, COMMA],
            shares[:, CELL],
            shares[:, SPACE],
            shares[:, QUOTE],
            plain[:, 3:12],
            divergences.min(1),
            jensen_shannon(shares, np.array(PROSE_CLASSES)),
            plain[:, 12],
            plain[:, 13],
            plain[:, 0] / (classes[:, STOP] + 1),
            plain[:, 14],
            plain[:, 15],
            1 / (1 + plain[:, 5]),
            plain[:, 16],
        ]
    )
    return out, [_LANGS[k] for k in nearest]


#: Written examples, so that every kind has a profile where few or no labels exist.
EXAMPLES = {
    "prose": [
        "The committee met on Tuesday to discuss the new road. Nobody could agree on the cost, so they decided to meet again next week.",
        "turn on the lights in the kitchen at eight",
        "Teacher: What did you find?\nStudent: I think the answer is twelve, because both sides are equal.",
        "On a besoin de temps pour comprendre la leçon. Le professeur explique la page suivante aux élèves.",
        "Wir haben die Aufgabe gestern nicht verstanden. Heute erklärt uns die Lehrerin das Kapitel noch einmal.",
        "Nos gusta leer en la biblioteca. El libro que compré ayer es más interesante que el otro.",
    ],
    "list": [
        "Shopping:\n- apples\n- brown bread\n- two lemons\n- washing powder\n- milk",
        "1. open the door\n2. take the key\n3. close the window\n4. call the office\n5. wait",
        "red chair\n\nsmall lamp\n\nold clock\n\nwooden table\n\ngreen carpet\n\nlong shelf",
    ],
    "table": [
        "name | age | town\nAnna | 31 | Bonn\nPeter | 28 | Lyon\nMaria | 44 | Rome",
        "item,price,number\npen,1.20,40\nbook,8.95,12\npaper,3.10,77\nink,4.00,9",
        "year\tsales\tcost\n2001\t34.2\t18.9\n2002\t36.0\t20.1\n2003\t31.7\t22.4",
        "alpha        12     45%     n/a\nbeta         9      51%     3.2\ngamma        14     -       7.7",
    ],
    "junk": [
        "xkq zzvr plmw qtrx hhgd wqpz nnbv ttrk jjfd sdfk ghjw",
        "Home | Login | Help | Search | Contact | Privacy | Terms | Home | Login | Share | Print",
        "the of and to a in is it for on with as by at from or an be this that are was",
        "cheap, free, best price, online, cheap, free, buy, online, best, free, top 10, near me",
        '<div class="a12"><span>&nbsp;</span></div><script>var x=1;</script><p class="b"></p>',
        "8837 2291 10 99384 5 77120 338 4 90021 66 1 29388 7710 3 8812",
        "aaaaaaaaaaaaaaaaaaaaaaaa 0f3c 88 e1 7d2 b 09",
        "SGVsbG8gd29ybGQhIFRoaXMgaXMgYmFzZTY0Cg\nQmFzZTY0IG5vaXNlIGxpbmUgdHdv",
        "Ã©tÃ© dÃ©jÃ  vu Â© Ã¼ber Ã¤hnlich Â» ï¿½ Ã± Ã³ � � Ã¶ Ã¨",
    ],
}


def _squeezed(stats: np.ndarray) -> np.ndarray:
    """Counts to logarithms, so that a profile doesn't depend on length in steps."""
    out = stats.copy()
    for name in ("n_chars", "n_words", "n_lines", "mean_word_length", "mean_line_words", "words_per_stop", "long_runs"):
        k = STATISTICS.index(name)
        out[:, k] = np.log1p(out[:, k])
    for name in ("symbol_ratio", "digit_ratio", "odd_ratio", "cell_ratio", "quote_ratio", "comma_ratio", "stop_ratio", "mark_up", "mixed_words", "vowelless_words"):
        k = STATISTICS.index(name)
        out[:, k] = np.sqrt(out[:, k])
    return out


@dataclass(frozen=True)
class KindProfiles:
    """Centres of the structural profiles in a space where the spread within a profile is one."""

    mean: np.ndarray
    turn: np.ndarray
    centres: np.ndarray
    kinds: np.ndarray

    def assign(self, stats: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The kind of the nearest profile, and how much nearer it is than the nearest of another kind."""
        z = (_squeezed(stats) - self.mean) @ self.turn
        d = np.sqrt(np.maximum((z**2).sum(1)[:, None] + (self.centres**2).sum(1) - 2 * z @ self.centres.T, 0))
        best = np.column_stack([d[:, self.kinds == k].min(1) if (self.kinds == k).any() else np.full(len(z), np.inf) for k in range(len(KINDS))])
        first = best.argmin(1)
        ordered = np.sort(best, axis=1)
        return [KINDS[k] for k in first], ordered[:, 1] - ordered[:, 0]


def _centres(z: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Spread-out starting points, then plain k-means."""
    picked = [int(rng.integers(len(z)))]
    near = ((z - z[picked[0]]) ** 2).sum(1)
    while len(picked) < min(k, len(z)) and near.sum() > 0:
        picked.append(int(rng.choice(len(z), p=near / near.sum())))
        near = np.minimum(near, ((z - z[picked[-1]]) ** 2).sum(1))
    c = z[picked].copy()
    for _ in range(25):
        own = ((z[:, None, :] - c[None]) ** 2).sum(2).argmin(1) if len(z) * len(c) < 4e5 else np.concatenate([((part[:, None] - c[None]) ** 2).sum(2).argmin(1) for part in np.array_split(z, 20)])
        new = np.array([z[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        if np.allclose(new, c):
            break
        c = new
    return c, own


def fit_profiles(rows: list[tuple[str, str]], per_kind: int = 14, seed: int = 7) -> KindProfiles:
    """Structural profiles from labelled texts and the written examples.

    Profiles most of whose nearest texts have another label are taken for wrong labels
    and left out.
    """
    pairs = [(t, k) for t, k in rows if k in KINDS and t.strip()] + [(t, k) for k, ts in EXAMPLES.items() for t in ts]
    stats, _ = statistics([t for t, _ in pairs])
    x, y = _squeezed(stats), np.array([KINDS.index(k) for _, k in pairs])
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - mean) / scale
    turn = np.diag(1 / scale)
    for _ in range(3):  # groups, then the spread within the groups, then groups again in that space
        parts = [(k, *_centres(z[y == k], max(1, min(per_kind, (y == k).sum() // 3 + 1)), rng)) for k in range(len(KINDS)) if (y == k).any()]
        rest = np.concatenate([z[y == k] - c[own] for k, c, own in parts])
        cov = rest.T @ rest / len(rest) + 0.05 * np.eye(z.shape[1])
        value, vector = np.linalg.eigh(cov)
        step = vector / np.sqrt(value)
        z, turn = z @ step, turn @ step
    centres, kinds = [], []
    parts = [(k, *_centres(z[y == k], max(1, min(per_kind, (y == k).sum() // 3 + 1)), rng)) for k in range(len(KINDS)) if (y == k).any()]
    every = np.concatenate([c for _, c, _ in parts])
    owner = np.concatenate([np.full(len(c), k) for k, c, _ in parts])
    near = ((z**2).sum(1)[:, None] + (every**2).sum(1) - 2 * z @ every.T).argmin(1)
    for j in range(len(every)):
        held = near == j
        # A profile most of whose texts are labelled otherwise came from wrong labels.
        if held.any() and (y[held] == owner[j]).mean() >= 0.5:
            centres.append(every[j])
            kinds.append(owner[j])
    return KindProfiles(mean, turn, np.array(centres), np.array(kinds))
