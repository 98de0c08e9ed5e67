"""Sentence boundaries across languages and scripts.

The rules go by Unicode's character properties: any script's sentence terminators
(property Sentence_Terminal, with the full stop as the ambiguous one), closing marks
and pictographs that follow them, and letter case where a script has it. On top of
that come abbreviations by language, initials, ordinals, quotations with their speakers,
brackets, list items, speaker turns and headings. Offsets count code points of the
unchanged text.
"""

from __future__ import annotations

from functools import lru_cache

import regex

from textweir.llm.textkind import FUNCTION_WORDS

# Fixed values, in lower case and without the last full stop.
# Titles and the like, which a name follows.
TITLES = frozenset(
    "mr mrs ms dr drs prof st ste rev gen capt cpt sgt lt col maj cmdr adm hon gov sen rep pres messrs mme mlle mm mgr me "
    "hr hrn fr frl dipl ing sr sra srta dra dña prof profa lic arq ing sig sigg dott avv ingg "
    "г-н г-жа проф акад им тов гр डॉ श्री प्रो".split()
)
# Words that run on whatever follows.
RUNNING = frozenset(
    "vs cf approx e.g i.e viz ca bzw ggf z.b d.h u.a u.ä vgl sog evtl inkl exkl bspw zzgl allg max min geb gest env ex ej p.ej p.ex c.-à-d núm nr abb bd kap "
    "hrsg aufl jh jhd std tel str resp incl excl pág págs pag cap gl гл рис табл стр см ср напр т.е т.к т.н ул пр обл св др.-греч opp ibid".split()
)
# References, which run on before a number or a lower-case letter.
NUMBERED = frozenset(
    "fig figs eq eqs no nos vol vols p pp ch chap chaps sec secs art arts ed éd eds par para nr abb bd kap s seite t tom núm n.º pág pt v ver max thm lem prop cor def "
    "п пп ст № рис табл т ч гл bldg rm apt jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun "
    "janv févr avr juil sept oct nov déc ene abr ago dic jän mär okt dez янв февр апр авг сент окт нояб дек h min".split()
)
# Words that may end a sentence: they do when a capital follows.
ENDING = frozenset(
    "etc inc ltd co corp jr sr bros esq dept est ave blvd rd univ assn govt al usw uvm osv ff a.m p.m u.s u.n u.k u.s.a ph.d b.a m.a m.d d.c r.i.p "
    "d.c a.c s.a s.l ee.uu г гг в вв тыс млн млрд руб коп д п др т.д т.п пр н.э и.о стр".split()
)
# Of these, the ones that are ordinary words elsewhere: the languages in which they are abbreviations, and how they are written there.
ONLY_IN = {
    "me": {"fr": "Capital"},
    "mm": {"fr": "CAPITALS"},
    "fr": {"de": "Capital"},
    "hr": {"de": "Capital"},
    "col": {"en": "Capital"},
    "rep": {"en": "Capital"},
    "sen": {"en": "Capital"},
    "hon": {"en": "Capital"},
    "gov": {"en": "Capital"},
    "maj": {"en": "Capital"},
    "pres": {"en": "Capital"},
    "gen": {"en": "Capital", "de": "Capital"},
    "sig": {"it": "any"},
    "ing": {"de": "Capital", "es": "any", "it": "any", "pt": "any"},
    "lic": {"es": "any"},
    "max": {"de": "small", "en": "number", "es": "small", "fr": "small", "it": "small", "nl": "small", "pt": "small"},
    "min": {"de": "small", "en": "number", "es": "small", "fr": "small", "it": "small", "nl": "small", "pt": "small"},
    "ex": {"es": "small", "fr": "small", "pt": "small"},
    "env": {"fr": "small"},
    "ej": {"es": "small"},
    "cap": {"es": "any", "it": "any", "pt": "any"},
    "tel": {"de": "any", "en": "any", "es": "any", "it": "any", "pt": "any"},
    "no": {"en": "number", "fr": "number"},
    "nos": {"en": "number", "fr": "number"},
    "art": {"de": "any", "en": "Capital", "es": "any", "fr": "any", "it": "any", "pt": "any"},
    "arts": {"en": "Capital", "es": "any", "fr": "any"},
    "par": {"en": "Capital"},
    "para": {"en": "any"},
    "sat": {"en": "Capital"},
    "sun": {"en": "Capital"},
    "mon": {"en": "Capital"},
    "mar": {"en": "Capital"},
    "ago": {"es": "small"},
    "ver": {"en": "any"},
    "tom": {"fr": "any"},
    "est": {"en": "any"},
}
# Verbs after which "no" is an answer, also before a number.
ANSWERS = frozenset("is was be are were been say says said answer answers answered mean means meant est était dit".split())
# Words that close an enumeration, which may end a sentence before a small letter too where a text has no capitals.
CLOSING_LIST = frozenset("etc usw uvm".split())
# Words that go on after an hour of the day.
AFTER_HOUR = frozenset("in on at with and or to for of from by until till but near every each sharp today tomorrow tonight yesterday con en de el la y o del para hasta por".split())
# Words before a number with a full stop that make it an ordinal, and months after it.
BEFORE_ORDINAL = frozenset("der die das dem den des am im vom zum zur ab bis ein einem einen eines jeder jedes jeden beim ins bis".split())
AFTER_ORDINAL = frozenset(
    "januar jänner februar märz april mai juni juli august september oktober november dezember januari februari maart mei augustus "
    "jahrhundert jh klasse band auflage kapitel stock mal".split()
)
# Verbs that give a quotation its speaker, and particles that do.
SPEECH = {
    "word": frozenset(
        "said says asked asks wrote writes replied answered shouted cried whispered added told explained called yelled muttered "
        "dit demanda demande demandé répond répondit écrit écrivit cria crie ajouta murmura "
        "dijo dice preguntó respondió escribió gritó añadió contestó "
        "sagte sagt fragte fragt rief ruft antwortete schrieb schreibt meinte flüsterte "
        "сказал сказала говорит спросил спросила ответил ответила написал написала крикнул крикнула "
        "कहा पूछा बोला बोली बोले कहती कहते लिखा चिल्लाया قال قالت سأل سألت أجاب أجابت صاح كتب كتبت وقال فقال".split()
    ),
    "part": tuple("说 道 问 答 喊 叫 写 回答 表示 說 問 寫 とい と言 と答 と聞 と叫 と書 と思 と彼 という って กล่าว พูด ถาม ตอบ บอก 라고 말했".split()),
}

_NEWLINE = r"(?:\r\n?|[\n\v\f\x85 ])"
_BLANK = regex.compile(rf"{_NEWLINE}[^\S\r\n\v\f\x85  ]*{_NEWLINE}\s*|\s* \s*")
_LINE = regex.compile(_NEWLINE)
_TERM = regex.compile(r"[\p{STerm}….․‥⋯]+(?:[\p{STerm}….․‥⋯]|(?<=[!?]) (?=[!?]))*")
_HARD = regex.compile(r"[^\P{STerm}!?.…․‥]")
_PICTURES = regex.compile(r"(?:[^\S\r\n\v\f\x85  ]*(?:\p{Extended_Pictographic}|\p{Regional_Indicator})[\p{Emoji_Modifier}️‍\p{Extended_Pictographic}\p{Regional_Indicator}⃣]*)+")
_BULLET = regex.compile(r"[^\S\n]*(?:[-*•+‣▪◦●○–—·](?=\s)|\[[ xX✓]?\](?=\s)|#{1,6}(?=\s))\s*")
_NUMBERED_ITEM = regex.compile(r"[^\S\n]*(?:\(?\p{Nd}{1,3}(?:\.\p{Nd}{1,3})*([.)、．])|\(?[\p{Ll}\p{Lu}](\)))(?=\s|(?<=[、．])\S)\s*")
_TURN = regex.compile(r"[^\S\n]*([\p{Lu}\p{Lo}\p{Lt}][\p{L}\p{M}'’.-]*(?: [\p{L}\p{M}\p{N}'’.-]+){0,2})(?:[^\S\n]?:[^\S\n]|：)\s*(?=\S)")
_THAI_GAP = regex.compile(r"(?<=[ก-๎])\s+(?=[ก-๎])")
_WORD_BEFORE = regex.compile(r"(?r)[\p{L}\p{M}\p{N}.'’ºª-]+")
_MARKS = regex.compile("[\"“”„«»‹›「」『』（）()\\[\\]{}【】《》〈〉〝〟]")
_PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "{": "}", "【": "】", "《": "》", "〈": "〉", "〝": "〟", '"': '"'}
_BRACKETS = "(（[{【"
_CLOSERS = regex.compile(r"[\p{Pe}\p{Pf}\"”»›」』’']+")
_FIRST_WORDS = regex.compile(r"[\p{L}\p{M}]+")
_CAPITAL = regex.compile(r"[\p{Lu}\p{Lt}]")
#: No word of these scripts lacks a vowel sign; what does is shortened.
_UNSPEAKABLE = regex.compile(r"[bcdfghjklmnpqrstvwxzßç]{2,}|[бвгджзклмнпрстфхцчшщ]{2,}")
_SMALL = regex.compile(r"\p{Ll}")
_UPPER = regex.compile(r"\p{Uppercase}")
_APOSTROPHE = regex.compile("['’]")
_LAST_WORD = regex.compile(r"(\p{L}+)\s*$")
_LAST_LETTER = regex.compile(r"(\p{L})\.?\s?$")
_INITIALS = regex.compile(r"(?:\p{L}\.)+\p{L}")
_STARTS = regex.compile(r"(?:^|[.!?][\"”»)]* |\n)[\"“„«¿¡(]*([\p{Lu}\p{Ll}])(?=\p{Ll}|\s)")


@lru_cache(10_000)
def _case(c: str) -> tuple[bool, bool]:
    """Whether a character is a capital, and whether it is a small letter."""
    return bool(_CAPITAL.match(c)), bool(_SMALL.match(c))


_LANGUAGES: dict[str, list[str]] = {}
for _name, _listed in FUNCTION_WORDS.items():
    for _w in _listed.split():
        _LANGUAGES.setdefault(_w, []).append(_name)


@lru_cache(16)
def _language(text: str) -> str | None:
    """The language whose function words fill most of the text; none where no language leads clearly."""
    score = dict.fromkeys(FUNCTION_WORDS, 0.0)
    for w in _FIRST_WORDS.findall(text.lower()):
        at = _LANGUAGES.get(w, ())
        for name in at:
            score[name] += 1 / len(at)
    best, second = sorted(score.values(), reverse=True)[:2]
    return max(score, key=score.get) if best >= 1 and best > 1.2 * second else None


def _meant(text: str, begin: int, end: int, at: int, word: str, digit: bool) -> bool:
    """Whether a word of ``ONLY_IN`` at ``at`` is an abbreviation: by the language of its line or list item, else of the text, and its letters."""
    language = _language(text[begin:end]) or _language(text)
    form = ONLY_IN[word.lower()].get(language)
    if form == "Capital":
        return word[0].isupper()
    if form == "CAPITALS":
        return word.isupper()
    if form == "small":
        return word.islower()
    if form == "number":
        before = _FIRST_WORDS.findall(text, max(begin, at - 20), at)
        return digit and not (word.islower() and before and before[-1].lower() in ANSWERS)
    return form == "any"


def _lines(text: str, start: int, end: int) -> list[tuple[int, int]]:
    out, at = [], start
    for m in _LINE.finditer(text, start, end):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, end))
    return out


def _ended(text: str, start: int, end: int) -> bool:
    tail = text[start:end].rstrip().rstrip("\"”»’')]）」』")
    return not tail or tail[-1] in ":：" or _TERM.match(tail[-1]) is not None


def _line_cuts(text: str, start: int, end: int) -> tuple[list[int], dict[int, int]]:
    """Starts of lines that begin a new unit within a block, and where the text after each item's marker begins."""
    lines = _lines(text, start, end)
    bullets = {s: m.end() for s, e in lines if (m := _BULLET.match(text, s, e)) and m.end() < e}
    numbered = {s: m for s, e in lines if (m := _NUMBERED_ITEM.match(text, s, e)) and m.end() < e}
    first = lines[0][0]
    items = dict(bullets)
    for s, m in numbered.items():
        # In wrapped prose a line may begin with the end of a reference; items stand first or in company.
        alike = sum(1 for x in numbered.values() if (x[1], bool(x[2])) == (m[1], bool(m[2])))
        if (s == first and (len(lines) == 1 or alike > 1)) or (alike > 1 and first in numbered):
            items[s] = m.end()
    if len(lines) == 1:
        return [], items
    turns = {s: m[1] for s, e in lines if s not in items and (m := _TURN.match(text, s, e))}
    cuts = []
    for (s0, e0), (s1, e1) in zip(lines, lines[1:]):
        if s1 in items or (s0 in items and s0 in bullets and text[s0:e0].lstrip().startswith("#")):
            cuts.append(s1)
        elif s1 in turns and first in turns:
            alone = " " not in turns[s1] and " " not in turns[first]
            if _ended(text, s0, e0) or alone or list(turns.values()).count(turns[s1]) > 1:
                cuts.append(s1)
        elif s0 == first and _heading(text[s0:e0]) and not _heading(text[s1:e1]):
            cuts.append(s1)
    return cuts, items


def _heading(line: str) -> bool:
    """A short line in capitals without an end mark."""
    letters = [c for c in line if c.isalpha()]
    return bool(letters) and len(line.split()) <= 8 and all(c.isupper() for c in letters) and len(letters) > 2 and not _ended(line, 0, len(line))


def _spans(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Outermost matched quotations and brackets."""
    stack: list[tuple[int, str]] = []
    spans: list[tuple[int, int]] = []
    for m in _MARKS.finditer(text, start, end):
        c, i = m.group(), m.start()
        at = next((k for k in range(len(stack) - 1, -1, -1) if c in _PAIRS[stack[k][1]]), None)
        if c == '"' and at is None and i > start and not text[i - 1].isspace() and i + 1 < end and text[i - 1].isalnum() and not text[i + 1].isalnum():
            continue  # inches and stray closing marks
        if at is not None:
            spans.append((stack[at][0], i + 1))
            del stack[at:]
        elif c in _PAIRS:
            stack.append((i, c))
    spans.sort()
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if not out or s >= out[-1][1]:
            out.append((s, e))
        elif e > out[-1][1]:
            out[-1] = (out[-1][0], e)
    return out


def _skip_space(text: str, at: int, end: int) -> int:
    while at < end and text[at].isspace():
        at += 1
    return at


def _speaker_follows(text: str, at: int, end: int) -> bool:
    """Whether the words from ``at`` name the speaker of the quotation before."""
    part = text[at : min(end, at + 60)]
    m = _TERM.search(part)
    clause = part[: m.start()] if m else part
    head = clause.lstrip("—–- ,，")
    words = _FIRST_WORDS.findall(head)[:4]
    if any(w.lower() in SPEECH["word"] for w in words):
        return True
    near = head[:14]
    return any(p in near for p in SPEECH["part"]) and not _CAPITAL.match(head)


def _stop_ends(text: str, begin: int, dot: int, after: int, nxt: int, end: int, capitals: bool) -> bool:
    """Whether the full stop at ``dot`` ends a sentence; ``after`` is behind it and its closing marks, ``nxt`` the next visible character."""
    m = _WORD_BEFORE.match(text, max(begin, dot - 60), dot)
    word = _APOSTROPHE.split(m.group())[-1].lstrip(".-") if m else ""
    degree = dot > len(word) and text[dot - len(word) - 1] in "°º"
    low = word.lower()
    c = text[nxt]
    upper, small = _case(c)
    digit = c.isnumeric()
    if nxt == after and nxt == dot + 1 and (c.isalnum() or c in "_/\\@"):
        if c.isdigit() or not word or word[-1].isdigit() or "." in word:
            return False
        if upper:
            whole = nxt + 1 < end and (_SMALL.match(text[nxt + 1]) or (c in "IAÀO" and text[nxt + 1].isspace()))
            return len(word) > 1 and word[-1].islower() and bool(whole)
        return not small and len(word) > 2 and not word[-1].isupper() and not _SMALL.match(word[-1]) and c.isalpha()
    if c in ",;:،؛、，；：" or (c in "-/" and nxt == after):
        return False
    if not word:
        return True
    if low in ONLY_IN and not _meant(text, begin, end, dot - len(word), word, digit):
        return True
    if low in TITLES:
        return False
    if low in CLOSING_LIST:
        return not small or not capitals
    if word.isdigit():
        before = _LAST_WORD.search(text[max(begin, m.start() - 20) : m.start()])
        following = _FIRST_WORDS.match(text, nxt)
        if following and following.group().lower() in AFTER_ORDINAL and len(word) < 3:
            return False
        if before and before.group(1).lower() in BEFORE_ORDINAL and len(word) < 3 and (upper or small):
            return False
        return True
    bare = low.replace(".", "")
    if len(bare) == 1 and bare.isalpha() and not degree:
        prior = _LAST_LETTER.search(text[max(begin, m.start() - 3) : m.start()])
        if prior and prior.group(1).lower() + bare in ("am", "pm", "тд", "тп", "нэ") or low in ENDING:
            return not small and not digit
        return False
    if low in RUNNING and low not in ENDING:
        return False
    if len(word) > 1 and _UNSPEAKABLE.fullmatch(low) and not word.isupper() and low not in ENDING:
        return False
    if low in NUMBERED and (digit or small or low in ("fig", "figs", "eq", "vol", "bldg", "pág", "núm", "nr", "abb")):
        return not (digit or small or c in "ivxlcIVXLC№(")
    if low in ("a.m", "p.m") and small and not capitals:
        # Without capitals to go by: a new sentence, unless the hour's phrase goes on.
        following = _FIRST_WORDS.match(text, nxt)
        return following is None or following.group() not in AFTER_HOUR
    if low in ENDING or _INITIALS.fullmatch(low):
        return not small and not digit and (low in ENDING or upper)
    return True


def _run_cuts(text: str, begin: int, start: int, end: int, capitals: bool) -> list[int]:
    """Ends of sentences within one run of text without hard line ends."""
    cuts: list[int] = []
    spans = _spans(text, start, end)
    marks: list[tuple[int, int, str]] = []
    for m in _TERM.finditer(text, start, end):
        marks.append((m.start(), m.end(), "mark"))
    k, kept = 0, []
    for s, e, kind in marks:
        while k < len(spans) and spans[k][1] <= s:
            k += 1
        if k < len(spans) and spans[k][0] < s < spans[k][1]:
            continue
        kept.append((s, e, kind))
    for s, e in spans:
        inside = text[s + 1 : e - 1].rstrip().rstrip("\"”»’')]）」』")
        if inside and _TERM.match(inside[-1]):
            kept.append((s, e, "span"))
    kept.sort()
    last = start
    owner = {s: e for s, e in spans}
    for s, e, kind in kept:
        if e <= last:
            continue
        after = e
        while True:
            m = _CLOSERS.match(text, after, end)
            if not m or after in owner:
                break
            after = m.end()
        m = _PICTURES.match(text, after, end)
        if m:
            after = m.end()
        nxt = _skip_space(text, after, end)
        if nxt >= end:
            break
        c = text[nxt]
        upper, small = _case(c)
        if kind == "span":
            opened = not text[last:s].strip()
            if c in ",;:،؛、，；：" or _TERM.match(c):
                continue
            dashed = c in "—–-" and nxt + 1 < end
            if text[s] in _BRACKETS:
                ends = opened and not small and not dashed
            elif dashed and (capitals or opened):
                follows = _skip_space(text, nxt + 1, end)
                ends = not (follows < end and not _CAPITAL.match(text[follows])) and not _speaker_follows(text, nxt, end)
            elif small:
                # A quotation that opens the sentence is followed by its speaker, if by a small letter.
                ends = opened and not capitals and not _speaker_follows(text, nxt, end)
            elif upper or not c.isalpha():
                ends = not _speaker_follows(text, nxt, end)
            else:
                ends = opened and not _speaker_follows(text, nxt, end)
        else:
            marks_ = text[s:e]
            if _HARD.search(marks_):
                ends = c not in ",;:،؛、，；："
            elif "!" in marks_ or "?" in marks_:
                ends = c not in ",;:،؛、，；：" and (nxt > after or not (small or c.isdigit() or c in "=&/_")) and not (c in "—–" and nxt + 1 < end and _SMALL.match(text[_skip_space(text, nxt + 1, end) % max(end, 1)] or " "))
            elif len(marks_) > 1 or marks_ in "…‥⋯":
                ends = upper and nxt > after
            else:
                ends = _stop_ends(text, begin, s, after, nxt, end, capitals)
        if ends:
            cuts.append(after)
            last = after
    thai = [m.start() for m in _THAI_GAP.finditer(text, start, end) if not any(a < m.start() < b for a, b in spans)]
    return sorted({*cuts, *thai}) if thai else cuts


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence, without surrounding white space. Null, empty and blank texts have none."""
    if not text:
        return []
    out: list[tuple[int, int]] = []
    capitals = len(_UPPER.findall(text)) > 0.004 * len(text) and _mixed_case(text)
    at = 0
    edges = []
    for m in _BLANK.finditer(text):
        edges.append((at, m.start()))
        at = m.end()
    edges.append((at, len(text)))
    for start, end in edges:
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        if start == end:
            continue
        line_cuts, items = _line_cuts(text, start, end)
        for s, e in zip([start, *line_cuts], [*line_cuts, end]):
            inner = items.get(s, s)
            left = s
            for cut in [*_run_cuts(text, s, inner, e, capitals), e]:
                a, b = left, cut
                while a < b and text[a].isspace():
                    a += 1
                while b > a and text[b - 1].isspace():
                    b -= 1
                if a < b:
                    out.append((a, b))
                left = cut
    return out


def _mixed_case(text: str) -> bool:
    """Whether sentences of the text begin with capitals: most first letters after end marks and at line starts do."""
    starts = _STARTS.findall(text)
    return not starts or sum(c.isupper() for c in starts) * 3 >= len(starts)
