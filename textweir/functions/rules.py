"""Rules that pass, reject or grade a text, as Columns over the features of ``text.with_features``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textweir.functions import text as T

# Phrases and words of the rules.
SPAM_PHRASES = ("click here", "buy now", "free money", "urgent", "limited time")
CLEAN_PHRASES = ("click here", "buy now", "free offer", "limited time", "act now")
SAFETY_WORDS = {
    "sexual": (
        "explicit", "graphic", "sexual", "nsfw", "xxx", "porn", "nude", "naked", "sex", "intercourse", "masturbat", "orgasm", "climax",
        "penis", "vagina", "breast", "breasts", "genital", "genitals",
    ),
    "violence": (
        "kill", "murder", "stab", "shoot", "assault", "attack", "violence", "blood", "gore", "torture", "abuse", "harm", "hurt",
        "weapon", "gun", "knife", "bomb", "explosive",
    ),
    "hate": ("hate", "racist", "nazi", "fascist", "supremacist", "slur", "derogatory", "offensive", "discriminat"),
    "profanity": ("fuck", "shit", "damn", "bitch", "ass", "hell", "crap", "piss", "bastard", "whore", "slut"),
}
MEDICAL_WORDS = (
    "medical", "anatomy", "biology", "health", "doctor", "patient", "education", "academic", "research", "study", "science",
    "textbook", "clinical", "therapeutic", "diagnosis",
)
INAPPROPRIATE = (
    ("profanity", ("fuck", "shit", "bitch", "asshole", "dick", "pussy", "cunt")),
    ("profanity", ("damn", "hell", "god damn")),
    ("hate_speech", ("kill yourself", "die", "hate you", "stupid", "idiot", "moron")),
    ("hate_speech", ("racist", "sexist", "homophobic")),
    ("violence", ("punch", "hit", "kill", "murder", "attack", "fight")),
    ("violence", ("weapon", "gun", "knife", "bomb")),
    ("sexual_content", ("sex", "porn", "nude", "naked", "penis", "vagina")),
    ("sexual_content", ("erotic", "sexual", "intimate")),
)
QUALITY_WORDS = (
    ("explain", "describe", "analyze", "demonstrate", "example", "because", "therefore", "however", "moreover"),
    ("solution", "answer", "result", "conclusion", "summary", "key", "important"),
    ("first", "second", "third", "finally", "step", "process", "method", "approach"),
)
EDUCATIONAL_WORDS = (
    "learn", "study", "understand", "knowledge", "concept", "theory", "principle", "research", "evidence", "data", "analysis", "findings",
    "conclusion", "question", "problem", "solution", "answer", "explanation",
)
CODE_WORDS = (
    "function", "class", "def", "import", "return", "if", "else", "for", "while", "python", "javascript", "java", "cpp", "html", "css", "sql",
)
#: Not a letter, digit, underscore or white space.
SIGN = rf"[^\p{{L}}\p{{N}}_{T.WS}]"


def preselect() -> Column:
    """Length from 15 to 4000, at most half digits, at least 0.6 letters and digits, more than two distinct characters."""
    t, n = F.col("t"), F.col("n_chars")
    digits = F.regexp_count(t, F.lit(r"\p{Nd}"))
    alnum = F.regexp_count(t, F.lit(r"[\p{L}\p{N}]"))
    return n.between(15, 4000) & (digits <= n * F.lit(0.5)) & (alnum >= n * F.lit(0.6)) & ~((T.distinct_chars(t) <= 2) & (n > 10))


def repeated_char(times: int) -> Column:
    """A character ``times`` times in a row, letter case ignored."""
    return F.col("t").rlike(rf"(?iu)(.)\1{{{times - 1},}}")


def poor_structure() -> Column:
    """A text of one to five characters, a blank one, or fifty signs in a row."""
    t = F.col("t")
    return t.rlike(r"^[^\n]{1,5}\n?$") | ~t.rlike(f"[^{T.WS}]") | t.rlike(f"{SIGN}{{50,}}")


def passes_rules() -> Column:
    return ~(repeated_char(16) | T.has_phrase(F.col("t"), SPAM_PHRASES) | poor_structure())


def rule_hits() -> Column:
    """(poor, spam): whether the structure is poor, and spam hits in a hundred words. Made a column before ``rule_grade``."""
    phrase = F.regexp_count(F.lower("t"), F.lit(f"{T.BEFORE}(?:{'|'.join(SPAM_PHRASES)}){T.AFTER}"))
    runs = F.regexp_count("t", F.lit(r"(?iu)(.)\1{15,}"))
    return F.struct(poor_structure().alias("poor"), ((phrase + runs) / F.greatest(F.lit(1), F.col("n_words")) * F.lit(100.0)).alias("spam"))


def rule_grade(hits: Column) -> Column:
    """(severity, is_safe, violations, warnings) of the spam and structure rules."""
    poor, spam = hits["poor"], hits["spam"]
    return F.struct(
        F.greatest(F.when(poor, 100.0).otherwise(0.0), spam).alias("severity"),
        (~poor & (spam <= 10)).alias("is_safe"),
        F.array_compact(F.array(F.when(poor, F.lit("quality")), F.when(spam > 10, F.lit("spam")))).alias("violations"),
        F.array_compact(F.array(F.when((spam > 3) & (spam <= 10), F.lit("spam")))).alias("warnings"),
    )


def safety_shares() -> Column:
    """Flagged words in a hundred by category; a medical context eases the sexual ones. Made a column before ``safety_grade``."""
    toks, shares = F.col("tokens"), []
    for name, listed in SAFETY_WORDS.items():
        share = F.coalesce(F.try_divide(T.count_in(toks, listed) * F.lit(100.0), F.col("n_words").cast("double")), F.lit(0.0))
        if name == "sexual":
            share = share * F.when(T.has_in(toks, MEDICAL_WORDS), 0.3).otherwise(1.0)
        shares.append(share.alias(name))
    return F.struct(*shares)


def safety_grade(shares: Column) -> Column:
    """(severity, is_safe, violations, warnings) by the shares of flagged words."""
    grades = {k: shares[k] for k in SAFETY_WORDS}
    worst = F.greatest(*grades.values())
    return F.struct(
        worst.alias("severity"),
        (worst <= 5).alias("is_safe"),
        F.array_compact(F.array(*[F.when(g > 5, F.lit(k)) for k, g in grades.items()])).alias("violations"),
        F.array_compact(F.array(*[F.when((g > 1) & (g <= 5), F.lit(k)) for k, g in grades.items()])).alias("warnings"),
    )


def _one_word_in(share: float) -> Column:
    """Whether a single word makes up more than this share of all words.

    In sorted order such a word stands at one of the places 1/share apart, so only those are counted.
    """
    ordered, n = F.array_sort("lwords"), F.col("n_words")
    places = int(1 / share) + 1
    at = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(places)), lambda i: F.floor(i * n / (places + 1)).cast("int") + 1))
    candidates = F.array_distinct(F.transform(at, lambda i: F.try_element_at(ordered, F.least(i, n.cast("int")))))
    return F.exists(candidates, lambda w: F.size(F.filter("lwords", lambda x: x == w)) > n * F.lit(share))


REASONS = tuple((name, 0.3) for name, _ in INAPPROPRIATE) + (("excessive_repetition", 0.2), ("excessive_caps", 0.1), ("too_short", 0.1), ("too_long", 0.1))


def inappropriate_flags() -> Column:
    """A flag for each of ``REASONS``: word groups, repetition, capitals, length. Made a column before the two below."""
    t, n = F.col("t"), F.col("n_chars")
    flags = [T.has_phrase(t, listed) for _, listed in INAPPROPRIATE]
    flags.append((F.col("n_words") > 10) & _one_word_in(0.3))
    flags += [(n > 20) & T.is_upper(t), (n < 10) & (n > 0), n > 5000]
    return F.array(*flags)


def inappropriate(flags: Column) -> Column:
    """(reasons, confidence): a reason for each hit, repeated where two groups of a category hit; empty text has none."""
    reasons = F.array_compact(F.array(*[F.when(flags[i], F.lit(name)) for i, (name, _) in enumerate(REASONS)]))
    total = sum((F.when(flags[i], F.lit(w)).otherwise(0.0) for i, (_, w) in enumerate(REASONS)), F.lit(0.0))
    return F.struct(reasons.alias("reasons"), F.least(total, F.lit(1.0)).alias("confidence"))


def inappropriate_categories(flags: Column) -> Column:
    """The reasons, each once; here an empty text is too short."""
    hit = [flags[i] | (F.col("n_chars") == 0) if name == "too_short" else flags[i] for i, (name, _) in enumerate(REASONS)]
    return F.array_distinct(F.array_compact(F.array(*[F.when(h, F.lit(name)) for h, (name, _) in zip(hit, REASONS)])))


LOW_QUALITY = (
    r"(?m)(?d)^.{1,10}$",
    r"(?iu)(.)\1{10,}",
    r"[A-Za-z]{20,}",
    r"\p{Nd}{50,}",
    SIGN + "{20,}",
)


def enhanced_checks() -> Column:
    """(early, late, quality_score, educational, code): first failing checks and hints. Made a column before ``enhanced_preselect``."""
    t, n = F.col("t"), F.col("n_chars")
    low = F.lit(False)
    for p in LOW_QUALITY:
        low = low | t.rlike(p)
    mean = F.try_divide(F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).cast("double"), F.col("n_words").cast("double"))
    early = (
        F.when(~t.rlike(f"[^{T.WS}]"), "Empty text")
        .when(n < 15, "Too short (< 15 chars)")
        .when(n > 4000, "Too long (> 4000 chars)")
        .when(low, "Low quality pattern detected")
    )
    late = F.when((mean < 2) | (mean > 15), "Unusual word length pattern").when((n > 50) & (T.distinct_chars(t) < 10), "Low character diversity")
    hits = sum((T.has_in(F.col("tokens"), ws).cast("int") for ws in QUALITY_WORDS), F.lit(0)) / len(QUALITY_WORDS)
    code = T.has_in(F.col("tokens"), CODE_WORDS) | t.rlike("[{}();]") | t.rlike(rf"^[{T.WS}]*#[^\n]*\n?$")
    return F.struct(early.alias("early"), late.alias("late"), hits.alias("hits"), T.has_in(F.col("tokens"), EDUCATIONAL_WORDS).alias("educational"), code.alias("code"))


def enhanced_preselect(checks: Column) -> Column:
    """(passed, reason, quality_score, hints) of the ordered checks; the first that fails gives the reason."""
    reason, looked = F.coalesce(checks["early"], checks["late"]), checks["early"].isNull()
    hints = F.array_compact(F.array(F.when(checks["educational"], F.lit("educational")), F.when(checks["code"], F.lit("code"))))
    return F.struct(
        reason.isNull().alias("passed"),
        reason.alias("reason"),
        F.when(looked, checks["hits"]).otherwise(0.0).alias("quality_score"),
        F.when(looked, hints).otherwise(F.array().cast("array<string>")).alias("hints"),
    )


def clean_for_safety(c: Column, keep_long_words: bool = False) -> Column:
    """Spam phrases, addresses, shouted words and repeated marks taken out, then every other sign.

    The shouted-word pattern ignores case, so it takes every word of five ASCII letters and more;
    ``keep_long_words`` restricts it to capitals.
    """
    out = F.trim(T.collapse(c))
    out = F.regexp_replace(out, f"(?i){T.BEFORE}(?:{'|'.join(CLEAN_PHRASES)}){T.AFTER}", "")
    out = F.regexp_replace(out, rf"(?i){T.BEFORE}(?:www\.|http://|https://)[^{T.WS}]+", "")
    out = F.regexp_replace(out, f"{'' if keep_long_words else '(?i)'}{T.BEFORE}[A-Z]{{5,}}{T.AFTER}", "")
    out = F.regexp_replace(F.regexp_replace(out, "!{2,}", ""), r"\?{2,}", "")
    return T.strip(F.regexp_replace(out, rf"[^\p{{L}}\p{{N}}_{T.WS}.,!?-]", ""))


def toxicity_decision(label: Column, raw: Column, reasons: Column, confidence: Column, n_chars: Column, threshold: float = 0.5) -> Column:
    """(is_toxic, confidence): rules above 0.5 decide alone; else the model's label and score, raised by rule hits."""
    by_rules = confidence > 0.5
    by_model = (F.upper(F.trim(label)) == "TOXIC") & (raw > threshold)
    toxic = F.when(n_chars < 3, F.lit(False)).when(by_rules, F.lit(True)).otherwise(F.coalesce(by_model, F.lit(False)))
    value = F.when(by_rules, confidence).when(F.size(reasons) > 0, F.least(F.lit(1.0), F.coalesce(raw, F.lit(0.0)) + F.lit(0.2) * confidence)).otherwise(F.coalesce(raw, F.lit(0.0)))
    return F.struct(toxic.alias("is_toxic"), F.when(n_chars < 3, F.lit(0.0)).otherwise(value).alias("confidence"))
