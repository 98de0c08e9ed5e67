"""Column builders for text. Every builder takes and gives Columns; null text counts as empty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Unicode has it, for a character class; Java and RE2 read it alike.
WS = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = f"[^{WS}]+"
#: A run of letters, digits and underscores: what stands between two word boundaries.
TOKEN = r"[\p{L}\p{N}_]+"
BEFORE, AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words(c: Column) -> Column:
    """Runs without white space."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD)).cast("long")


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, f"[{WS}]+", " ")


def count_in(toks: Column, listed: Sequence[str]) -> Column:
    """How many tokens are among ``listed``."""
    return F.size(F.filter(toks, lambda w: w.isin(list(listed)))).cast("long")


def has_in(toks: Column, listed: Sequence[str]) -> Column:
    return F.exists(toks, lambda w: w.isin(list(listed)))


def has_phrase(c: Column, phrases: Sequence[str]) -> Column:
    """Whether one of the phrases stands in the text between word boundaries; letter case is ignored."""
    return F.lower(c).rlike(f"{BEFORE}(?:{'|'.join(phrases)}){AFTER}")


def contains_any(lower: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | lower.contains(p)
    return out


def count_substring(c: Column, part: str) -> Column:
    """Occurrences of ``part`` that don't overlap."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("long")


def distinct_chars(c: Column) -> Column:
    """Distinct characters of the lower-cased text."""
    return F.when(F.length(c) == 0, F.lit(0)).otherwise(F.size(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("(?s)."), F.lit(0))))).cast("long")


def is_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def head_and_tail(c: Column, most: int = 2000, head: int = 1000, tail: int = 500) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, head), F.lit("..."), F.right(c, F.lit(tail)))).otherwise(c)


def preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def truncate_words(c: Column, n: int, marker: str = " [...]") -> Column:
    w = words(c)
    return F.when(F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit(marker))).otherwise(c)


def with_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds what the scores and rules are made of, each computed once; what a query doesn't use is pruned.

    t (text, never null), words, lwords, tokens, n_chars, n_words; distinct (words), n_distinct, distinct_length,
    n_syllables, n_marks; sentence_words (words of each sentence), n_sentences, sentence_sum, sentence_squares.
    Higher-order functions aren't shared between expressions by the optimizer, hence the steps.
    """
    sentences = F.filter(F.split("t", "[.!?]+"), lambda x: x.rlike(f"[^{WS}]"))
    out = df.withColumn("t", text_or_empty(text_col)).withColumns(
        {
            "words": words(F.col("t")),
            "lwords": words(F.lower("t")),
            "tokens": tokens(F.col("t")),
            "n_chars": F.length("t").cast("long"),
            "n_words": n_words(F.col("t")),
            "n_marks": F.regexp_count("t", F.lit("[.!?]+")).cast("long"),
            "sentence_words": F.transform(sentences, lambda x: n_words(x).cast("double")),
        }
    )
    out = out.withColumns(
        {
            "distinct": F.array_distinct("lwords"),
            "n_syllables": syllables(F.col("lwords")),
            "n_sentences": F.size("sentence_words"),
            "sentence_sum": F.aggregate("sentence_words", F.lit(0.0), lambda a, x: a + x),
            "sentence_squares": F.aggregate("sentence_words", F.lit(0.0), lambda a, x: a + x * x),
        }
    )
    return out.withColumns({"n_distinct": F.size("distinct").cast("long"), "distinct_length": F.aggregate("distinct", F.lit(0).cast("long"), lambda a, w: a + F.length(w))})


def syllables(lwords: Column) -> Column:
    """Vowel runs of each word, one less for a final e, one at least."""
    return F.aggregate(
        lwords,
        F.lit(0).cast("long"),
        lambda acc, w: acc + F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiouy]+")) - F.when(w.endswith("e"), 1).otherwise(0)).cast("long"),
    )


def resolve_text(df: DataFrame, candidates: Sequence[str], out: str = "text") -> DataFrame:
    """First of ``candidates`` that exists and isn't empty; arrays are joined by a space."""
    kinds = dict(df.dtypes)
    found = []
    for c in candidates:
        if c in kinds:
            value = F.array_join(F.col(c).cast("array<string>"), " ") if kinds[c].startswith("array") else F.col(c).cast("string")
            found.append(F.when(F.length(value) > 0, value))
    return df.withColumn(out, F.coalesce(*found) if found else F.lit(None).cast("string"))


def summary(c: Column, n: int = 200) -> Column:
    return strip(F.translate(F.substring(c, 1, n), "\n", " "))


def key_terms(c: Column, most: int = 10) -> Column:
    """Capitalised words of four letters and more: the first ``most`` of the distinct ones in order of the alphabet."""
    found = F.regexp_extract_all(c, F.lit(f"{BEFORE}[A-Z][a-zA-Z]{{3,}}{AFTER}"), F.lit(0))
    return F.slice(F.array_sort(F.array_distinct(found)), 1, most)


def document_type(c: Column) -> Column:
    return F.when(c.contains("Calculus") | c.contains("Math"), "mathematics").when(F.lower(c).contains("business"), "business").otherwise("general")


def judge_score(c: Column) -> Column:
    """The first ``[RESULT]`` from 1 to 5 in a judge's answer; 3 where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"\[RESULT\]:?\s*([1-5])", 1), F.lit("")).cast("int"), F.lit(3)).cast("long")


def contrastive_pair(c: Column) -> Column:
    """(query, positive): first sentence and the rest of a text cut at full stops; null for a single sentence."""
    parts = F.split(c, r"\. ")
    return F.when(F.size(parts) >= 2, F.struct(parts[0].alias("query"), F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 1), ". ").alias("positive")))


def detokenised(c: Column, kind: str) -> Column:
    """Tokens as text: arrays joined by a space, strings as they are, null as empty."""
    return F.coalesce(F.array_join(c.cast("array<string>"), " ") if kind.startswith("array") else c.cast("string"), F.lit(""))


def labelled_text(context: Column, question: Column, answer: Column) -> Column:
    return F.concat(F.lit("Context: "), context, F.lit(" Question: "), question, F.lit(" Answer: "), answer)


def judge_prompt(response: Column, instruction: str, reference: str, criteria: str, levels: Sequence[str]) -> Column:
    """A grading prompt for a judge model: task, response, reference and a rubric of five levels."""
    rubric = "\n".join(f"Score {i}: {x}" for i, x in enumerate(levels, 1))
    head = f"Grade the response from 1 to 5 and end with [RESULT]: and the number.\n\nInstruction:\n{instruction}\n\nResponse:\n"
    return F.concat(F.lit(head), F.coalesce(response, F.lit("")), F.lit(f"\n\nReference (score 5):\n{reference}\n\nCriteria:\n{criteria}\n{rubric}"))


def retrieval_prompt(chunks: Column, query: Column) -> Column:
    """A prompt from retrieved chunks, one a line, and a question."""
    return F.concat(F.lit("Context:\n"), F.array_join(chunks, "\n"), F.lit("\n\nUser: "), F.coalesce(query, F.lit("")), F.lit("\nAssistant:"))


def conversation_text(turns: Column) -> Column:
    """The values of an array of turns (structs with ``value``), each followed by a space, stripped; turns without one are left out."""
    return strip(F.array_join(F.filter(F.transform(turns, lambda x: x["value"]), lambda v: v.isNotNull()), " "))


def sample_text(df: DataFrame, out: str = "text") -> DataFrame:
    """The text of a sample by its columns: ``conversations``, else ``text``, else ``instruction`` and ``output``, else all strings."""
    kinds = dict(df.dtypes)
    if "conversations" in kinds:
        value = conversation_text(F.col("conversations"))
    elif "text" in kinds:
        value = strip(F.col("text").cast("string"))
    elif "instruction" in kinds and "output" in kinds:
        value = strip(F.concat_ws(" ", "instruction", "output"))
    else:
        value = strip(F.concat_ws(" ", *[c for c, k in kinds.items() if k == "string"]))
    return df.withColumn(out, F.coalesce(value, F.lit("")))


def cluster_of(df: DataFrame, candidates: Sequence[str] = ("cluster", "cluster_id", "cluster_label", "group", "category")) -> Column:
    """The first of the candidate columns that isn't null, as text; ``unknown`` where none is."""
    held = [F.col(c).cast("string") for c in candidates if c in df.columns]
    return F.coalesce(*held, F.lit("unknown"))


def decode_ids(df: DataFrame, id_col: str, tokens_col: str, vocabulary: DataFrame, special: Sequence[int] = (), least: int = 0) -> DataFrame:
    """(id, text) of token lists through a vocabulary (token_id, piece), special ids skipped; texts of ``least`` characters and less are left out.

    Each list's distinct ids are joined once; ids outside the vocabulary give nothing.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.filter(tokens_col, lambda x: ~x.isin(list(special)) if special else F.lit(True)), F.array().cast("array<int>")).alias("ids"))
    known = rows.select("id", F.explode(F.array_distinct("ids")).alias("token_id")).distinct().join(vocabulary, "token_id")
    pieces = known.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("token_id", "piece"))).alias("piece_of"))
    text = F.coalesce(strip(F.array_join(F.transform("ids", lambda x: F.col("piece_of")[x]), " ")), F.lit(""))
    return rows.join(pieces, "id", "left").select(F.col("id").alias(id_col), text.alias("text")).filter(F.length("text") >= least + 1 if least else F.lit(True))
