"""One query for each operator, with the SQL that gives the same rows.

``@query(sql)`` registers a function under its name. Operators that SQL can't express
(models, greedy selection, probing an index) have no SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweir.functions import categories as C
from textweir.functions import rules as R
from textweir.functions import scores as S
from textweir.functions import text as T
from textweir.operators import dedup, examples, scorers, scoring, similarity, stats
from textweir.plans import pipeline
from textweir.sources import readers, writers
from textweir.session import cut, ensure_checkpoint_dir, spread
from textweir.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_features(docs(spark, sf_dir))


def r6(c):
    return F.round(c, 6)


# -- SQL pieces

W, TOK = T.WORD, T.TOKEN
FEATURES = f"""
d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
f AS (SELECT *, length(t) AS n_chars, regexp_extract_all(t, '{W}') AS words, regexp_extract_all(lower(t), '{W}') AS lwords,
        regexp_extract_all(lower(t), '{TOK}') AS toks, len(regexp_extract_all(t, '{W}')) AS n_words FROM d)"""


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(xs: Sequence[str]) -> str:
    return "(" + ", ".join(map(quoted, xs)) + ")"


def values(rows: Sequence[Sequence], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(quoted(x) if isinstance(x, str) else "NULL" if x is None else str(x) for x in r) + ")" for r in rows) + f") AS v({names})"


def in_count(xs: Sequence[str]) -> str:
    return f"len(list_filter(toks, lambda w: w IN {listed(xs)}))"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{T.WS}]+|[{T.WS}]+$', '', 'g')"


def normal_sql(x: str) -> str:
    return f"regexp_replace(lower({strip_sql(x)}), '[{T.WS}]+', ' ', 'g')"


def any_part(x: str, parts: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(p)})" for p in parts) + ")"


def phrase_sql(x: str, phrases: Sequence[str]) -> str:
    return rf"regexp_matches(lower({x}), '(^|[^\p{{L}}\p{{N}}_])({'|'.join(phrases)})($|[^\p{{L}}\p{{N}}_])')"


def marked_sql(x: str) -> str:
    """The text with marks around each word, which stand in for word boundaries."""
    return rf"regexp_replace({x}, '([\p{{L}}\p{{N}}_]+)', chr(1) || '\1' || chr(2), 'g')"


def marked_phrases(phrases: Sequence[str]) -> str:
    return "(" + "|".join(" ".join(f"\\x01{w}\\x02" for w in p.split(" ")) for p in phrases) + ")"


#: The longest run of one character of each text, letter case ignored, and the number of runs of sixteen and more, by gaps and islands.
RUNS_SQL = r"""ch AS (SELECT doc_id, unnest(string_split(lower(t), '')) AS c, generate_subscripts(string_split(lower(t), ''), 1) AS i FROM d WHERE t <> ''),
  isl AS (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS g FROM ch WHERE c NOT IN (chr(10), chr(13), chr(133), chr(8232), chr(8233))) GROUP BY doc_id, c, g),
  longest AS (SELECT doc_id, max(n) AS run, count(*) FILTER (WHERE n >= 16) AS runs FROM isl GROUP BY doc_id),
  fr AS (SELECT f.*, coalesce(run, 0) AS run, coalesce(runs, 0) AS runs FROM f LEFT JOIN longest USING (doc_id))"""
SIGN_SQL = rf"[^\p{{L}}\p{{N}}_{T.WS}]"
POOR_SQL = rf"(regexp_matches(t, '^[^\n]{{1,5}}\n{{0,2}}$') OR NOT regexp_matches(t, '[^{T.WS}]') OR regexp_matches(t, '{SIGN_SQL}{{50,}}'))"
PASSES_SQL = f"(NOT (run >= 16 OR {phrase_sql('t', R.SPAM_PHRASES)} OR {POOR_SQL}))"
SPAM_SQL = f"((len(regexp_extract_all({marked_sql('lower(t)')}, '{marked_phrases(R.SPAM_PHRASES)}')) + runs)::DOUBLE / greatest(1, n_words) * 100.0::DOUBLE)"
PRESELECT_SQL = r"""(n_chars BETWEEN 15 AND 4000 AND len(regexp_extract_all(t, '\p{Nd}')) <= n_chars * 0.5::DOUBLE
  AND len(regexp_extract_all(t, '[\p{L}\p{N}]')) >= n_chars * 0.6::DOUBLE
  AND NOT (len(list_distinct(regexp_extract_all(lower(t), '(?s).'))) <= 2 AND n_chars > 10))"""
SYLLABLES_SQL = "coalesce(list_sum(list_transform(lwords, lambda w: greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN w LIKE '%e' THEN 1 ELSE 0 END))), 0)"
READABILITY_SQL = f"""CASE WHEN len(regexp_extract_all(t, '[.!?]+')) = 0 OR n_words = 0 THEN 0.0::DOUBLE ELSE
  greatest(0.0::DOUBLE, least(100.0::DOUBLE, 206.835::DOUBLE - 1.015::DOUBLE * (n_words::DOUBLE / len(regexp_extract_all(t, '[.!?]+'))) - 84.6::DOUBLE * ({SYLLABLES_SQL}::DOUBLE / n_words))) / 100 END"""
DIVERSITY_SQL = """CASE WHEN n_words = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, len(list_distinct(lwords))::DOUBLE / n_words
  + least(0.3::DOUBLE, (list_sum(list_transform(list_distinct(lwords), lambda w: length(w)))::DOUBLE / len(list_distinct(lwords)) - 4) * 0.05::DOUBLE)) END"""
ENGAGEMENT_SQL = rf"""CASE WHEN n_words = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, (len(regexp_extract_all(t, '\?')) * 2 + {in_count(S.PRONOUNS + S.ACTIONS)})::DOUBLE / n_words) END"""
SENTENCES_SQL = f"list_transform(list_filter(string_split_regex(t, '[.!?]+'), lambda s: regexp_matches(s, '[^{T.WS}]')), lambda s: len(regexp_extract_all(s, '{W}'))::DOUBLE)"
COHERENCE_SQL = f"""CASE WHEN len({SENTENCES_SQL}) < 2 THEN 0.5::DOUBLE ELSE least(0.5::DOUBLE, {in_count(S.TRANSITIONS)}::DOUBLE / len({SENTENCES_SQL}))
  + 0.5::DOUBLE - least(0.3::DOUBLE, list_var_pop({SENTENCES_SQL}) / 100) END"""
LENGTH_SQL = "least(1.0::DOUBLE, n_words::DOUBLE / 50)"
QUALITY_CTE = f"""{FEATURES}, q AS (SELECT *, {READABILITY_SQL} AS readability, {DIVERSITY_SQL} AS diversity, {ENGAGEMENT_SQL} AS engagement,
  {COHERENCE_SQL} AS coherence, {LENGTH_SQL} AS length_score FROM f),
  o AS (SELECT *, (readability + engagement + diversity + coherence + length_score) / 5 AS overall FROM q)"""


def qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = featured(spark, sf_dir).withColumns(S.quality())
    return f.withColumn("overall", S.overall_quality())


# -- flagship


@query(
    f"""WITH {FEATURES} SELECT coalesce(lang, 'unknown') AS lang, count(*) AS docs, count(*) FILTER (WHERE {PRESELECT_SQL}) AS kept,
  round(avg({READABILITY_SQL}), 6) AS avg_readability, round(avg({DIVERSITY_SQL}), 6) AS avg_diversity FROM f GROUP BY 1"""
)
def quality_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = featured(spark, sf_dir).withColumns({"r": S.readability(), "v": S.diversity(), "p": R.preselect()})
    return f.groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(
        F.count(F.lit(1)).alias("docs"), F.count_if("p").alias("kept"), r6(F.avg("r")).alias("avg_readability"), r6(F.avg("v")).alias("avg_diversity")
    )


# -- sources and projections


@query("SELECT sample_id, piece_no, len(tokens)::BIGINT AS n FROM climblab_sample WHERE len(tokens) BETWEEN 1 AND 100000")
def src_valid_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.valid_tokens(table(spark, sf_dir, "climblab_sample")).select("sample_id", "piece_no", F.size("tokens").cast("long").alias("n"))


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def src_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.first_rows(docs(spark, sf_dir).select("doc_id"), 25, "doc_id")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 3")
def src_prefix_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.first_rows_each(docs(spark, sf_dir), "lang", 3, "doc_id").select("doc_id", "lang")


@query("SELECT doc_id, md5(CASE WHEN text <> '' THEN text WHEN source <> '' THEN source END) AS resolved FROM documents")
def src_resolved_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.resolve_text(docs(spark, sf_dir), ("content", "text", "body", "source"), "x").select("doc_id", F.md5("x").alias("resolved"))


@query(f"WITH {FEATURES} SELECT doc_id, md5({normal_sql('t')}) AS normal, md5(t) AS md5, sha256(t) AS sha FROM d")
def prj_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.text_or_empty("text")
    return docs(spark, sf_dir).select("doc_id", F.md5(dedup.normalised(t)).alias("normal"), F.md5(t).alias("md5"), F.sha2(t, 256).alias("sha"))


@query(
    f"""WITH {FEATURES} SELECT doc_id, md5(CASE WHEN n_chars > 2000 THEN substring(t, 1, 1000) || '...' || right(t, 500) ELSE t END) AS both_ends,
  md5(substring(t, 1, 512)) AS head, CASE WHEN n_chars > 100 THEN substring(t, 1, 100) || '...' ELSE t END AS preview,
  md5(CASE WHEN n_words > 50 THEN array_to_string(words[1:50], ' ') || ' [...]' ELSE t END) AS short FROM f"""
)
def prj_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.text_or_empty("text")
    return docs(spark, sf_dir).select(
        "doc_id", F.md5(T.head_and_tail(t)).alias("both_ends"), F.md5(F.substring(t, 1, 512)).alias("head"), T.preview(t, 100).alias("preview"), F.md5(T.truncate_words(t, 50)).alias("short")
    )


@query(
    f"""WITH {FEATURES} SELECT doc_id, {strip_sql("replace(substring(t, 1, 200), chr(10), ' ')")} AS summary,
  array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(t, '{TOK}'), lambda w: regexp_full_match(w, '[A-Z][a-zA-Z]{{3,}}'))))[1:10], '|') AS key_terms,
  CASE WHEN contains(t, 'Calculus') OR contains(t, 'Math') THEN 'mathematics' WHEN contains(lower(t), 'business') THEN 'business' ELSE 'general' END AS document_type FROM d"""
)
def prj_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.text_or_empty("text")
    return docs(spark, sf_dir).select("doc_id", T.summary(t).alias("summary"), F.array_join(T.key_terms(t), "|").alias("key_terms"), T.document_type(t).alias("document_type"))


@query(
    f"""WITH {FEATURES}, p AS (SELECT doc_id, string_split(t, '. ') AS s FROM d)
  SELECT doc_id, s[1] AS query, md5(array_to_string(s[2:], '. ')) AS positive FROM p WHERE len(s) >= 2"""
)
def prj_contrastive(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.contrastive_pair(T.text_or_empty("text"))
    return docs(spark, sf_dir).select("doc_id", p.alias("p")).filter("p is not null").select("doc_id", "p.query", F.md5("p.positive").alias("positive"))


@query(r"""WITH a AS (SELECT record_id, annotator, aspect, '[RESULT]: ' || trim(answer) || ' [RESULT] 2' AS answer FROM record_labels)
  SELECT record_id, annotator, aspect, coalesce(nullif(regexp_extract(answer, '\[RESULT\]:?\s*([1-5])', 1), '')::BIGINT, 3) AS score FROM a""")
def prj_judge_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as a judge's answers: the first result counts, a level or, where the label is none, the second."""
    answer = F.concat(F.lit("[RESULT]: "), F.trim("answer"), F.lit(" [RESULT] 2"))
    return table(spark, sf_dir, "record_labels").select("record_id", "annotator", "aspect", T.judge_score(answer).alias("score"))


@query("SELECT doc_id, md5('Context: ' || coalesce(text, '') || ' Question: ' || coalesce(source, '') || ' Answer: ' || coalesce(lang, '')) AS labelled FROM documents")
def prj_labelled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(T.labelled_text(*(T.text_or_empty(c) for c in ("text", "source", "lang")))).alias("labelled"))


@query("SELECT sample_id, piece_no, md5(coalesce(array_to_string(tokens, ' '), '')) AS text, coalesce(len(tokens), 0)::BIGINT AS token_count, coalesce(cluster_id, 'unknown') AS cluster_id FROM climblab_sample")
def prj_detokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "climblab_sample")
    n = F.coalesce(F.size("tokens"), F.lit(0))
    return df.select(
        "sample_id", "piece_no", F.md5(T.detokenised(F.col("tokens"), "array<int>")).alias("text"), F.greatest(n, F.lit(0)).cast("long").alias("token_count"), F.coalesce("cluster_id", F.lit("unknown")).alias("cluster_id")
    )


@query(
    f"""WITH {FEATURES}, c AS (SELECT w, count(*) AS n FROM (SELECT unnest(lwords) AS w FROM f) GROUP BY w),
  v AS (SELECT w, row_number() OVER (ORDER BY n DESC, w) AS token_id FROM c),
  o AS (SELECT doc_id, unnest(lwords) AS w, generate_subscripts(lwords, 1) AS i FROM f),
  b AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM o JOIN v USING (w) GROUP BY doc_id)
  SELECT doc_id, md5(text) AS text FROM b WHERE length(text) > 10"""
)
def prj_decoded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to ids of a vocabulary ranked by count, and back; texts of ten characters and less are left out."""
    f = featured(spark, sf_dir)
    counted = f.select(F.explode("lwords").alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    # An id for each word: any distinct number will do, here its hash.
    vocabulary = counted.select("piece", F.xxhash64("piece").alias("token_id"))
    ids = f.select("doc_id", F.transform("lwords", lambda w: F.xxhash64(w)).alias("ids"))
    return T.decode_ids(ids, "doc_id", "ids", vocabulary, least=10).select("doc_id", F.md5("text").alias("text"))


# -- filters


@query(f"WITH {FEATURES} SELECT doc_id, n_words::BIGINT AS n_words FROM f WHERE n_words BETWEEN 20 AND 1024")
def flt_word_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featured(spark, sf_dir).filter(F.col("n_words").between(20, 1024)).select("doc_id", "n_words")


@query("SELECT sample_id, piece_no, len(tokens)::BIGINT AS n FROM climblab_sample WHERE len(tokens) BETWEEN 80 AND 3000")
def flt_token_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "climblab_sample").withColumn("n", F.size("tokens").cast("long"))
    return df.filter(F.col("n").between(80, 3000)).select("sample_id", "piece_no", "n")


@query(f"WITH {FEATURES} SELECT doc_id FROM f WHERE {PRESELECT_SQL}")
def flt_preselect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featured(spark, sf_dir).filter(R.preselect()).select("doc_id")


@query(
    f"""WITH {FEATURES}, {RUNS_SQL}, h AS (SELECT doc_id, {PASSES_SQL} AS passes, {POOR_SQL} AS poor, {SPAM_SQL} AS spam FROM fr)
  SELECT doc_id, passes, round(greatest(CASE WHEN poor THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END, spam), 6) AS severity, NOT poor AND spam <= 10 AS is_safe,
    concat_ws(',', CASE WHEN poor THEN 'quality' END, CASE WHEN spam > 10 THEN 'spam' END) AS violations FROM h"""
)
def flt_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = featured(spark, sf_dir).select("doc_id", R.passes_rules().alias("passes"), R.rule_hits().alias("hits"))
    return hits.select("doc_id", "passes", R.rule_grade(F.col("hits")).alias("g")).select("doc_id", "passes", r6(F.col("g.severity")).alias("severity"), "g.is_safe", F.array_join("g.violations", ",").alias("violations"))


def _enhanced_sql() -> str:
    """CTE ``e``: the ordered checks (reason, looked, hits, hints) of every document."""
    lines = "len(list_filter(string_split(t, chr(10)), lambda x: length(x) BETWEEN 1 AND 10)) > 0"
    low = f"({lines} OR run >= 11 OR regexp_matches(t, '[A-Za-z]{{20,}}') OR regexp_matches(t, '\\p{{Nd}}{{50,}}') OR regexp_matches(t, '{SIGN_SQL}{{20,}}'))"
    mean = "(list_sum(list_transform(words, lambda w: length(w)))::DOUBLE / n_words)"
    hits = "((" + " + ".join(f"({in_count(ws)} > 0)::INT" for ws in R.QUALITY_WORDS) + f")::DOUBLE / {len(R.QUALITY_WORDS)})"
    code = f"({in_count(R.CODE_WORDS)} > 0 OR regexp_matches(t, '[{{}}();]') OR regexp_matches(t, '^[{T.WS}]*#[^\\n]*\\n{{0,2}}$'))"
    return f"""{RUNS_SQL}, e1 AS (SELECT doc_id, CASE WHEN NOT regexp_matches(t, '[^{T.WS}]') THEN 'Empty text' WHEN n_chars < 15 THEN 'Too short (< 15 chars)' WHEN n_chars > 4000 THEN 'Too long (> 4000 chars)'
    WHEN {low} THEN 'Low quality pattern detected' END AS early, CASE WHEN {mean} < 2 OR {mean} > 15 THEN 'Unusual word length pattern'
    WHEN n_chars > 50 AND len(list_distinct(regexp_extract_all(lower(t), '(?s).'))) < 10 THEN 'Low character diversity' END AS late,
    {hits} AS hits, concat_ws(',', CASE WHEN {in_count(R.EDUCATIONAL_WORDS)} > 0 THEN 'educational' END, CASE WHEN {code} THEN 'code' END) AS hints FROM fr),
  e AS (SELECT doc_id, coalesce(early, late) AS reason, CASE WHEN early IS NULL THEN hits ELSE 0.0::DOUBLE END AS quality_score, CASE WHEN early IS NULL THEN hints ELSE '' END AS hints FROM e1)"""


ENHANCED_SQL = _enhanced_sql()


@query(f"WITH {FEATURES}, {ENHANCED_SQL} SELECT doc_id, reason IS NULL AS passed, reason, round(quality_score, 6) AS quality_score, hints FROM e")
def flt_enhanced_preselect(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = featured(spark, sf_dir).select("doc_id", R.enhanced_checks().alias("c"))
    g = checks.select("doc_id", R.enhanced_preselect(F.col("c")).alias("g"))
    return g.select("doc_id", "g.passed", "g.reason", r6(F.col("g.quality_score")).alias("quality_score"), F.array_join("g.hints", ",").alias("hints"))


def _clean_sql(capitals: str) -> str:
    bare = f"trim(regexp_replace(t, '[{T.WS}]+', ' ', 'g'), ' ')"
    out = f"regexp_replace({marked_sql(bare)}, '(?i){marked_phrases(R.CLEAN_PHRASES)}', '', 'g')"
    out = rf"regexp_replace(replace(replace({out}, chr(1), ''), chr(2), ''), '(?i)(^|[^\p{{L}}\p{{N}}_])(?:www\.|http://|https://)[^{T.WS}]+', '\1', 'g')"
    out = f"replace(replace(regexp_replace({marked_sql(out)}, '\\x01[{capitals}]{{5,}}\\x02', '', 'g'), chr(1), ''), chr(2), '')"
    out = rf"regexp_replace(regexp_replace({out}, '!{{2,}}', '', 'g'), '\?{{2,}}', '', 'g')"
    return strip_sql(rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}_{T.WS}.,!?-]', '', 'g')")


@query(f"WITH {FEATURES} SELECT doc_id, {_clean_sql('A-Za-z')} AS cleaned, {_clean_sql('A-Z')} AS cleaned_capitals FROM d")
def prj_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.text_or_empty("text")
    return docs(spark, sf_dir).select("doc_id", R.clean_for_safety(t).alias("cleaned"), R.clean_for_safety(t, keep_long_words=True).alias("cleaned_capitals"))


RECORD_FEATURES = FEATURES.replace("doc_id, lang, source, coalesce(text, '') AS t FROM documents", "record_id, lang, source, coalesce(text, '') AS t FROM refined_commands_filtered")


def _safety_sql() -> str:
    parts = []
    for k, ws in R.SAFETY_WORDS.items():
        share = f"CASE WHEN n_words = 0 THEN 0.0::DOUBLE ELSE {in_count(ws)} * 100.0::DOUBLE / n_words END"
        ease = f"CASE WHEN {in_count(R.MEDICAL_WORDS)} > 0 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END * " if k == "sexual" else ""
        parts.append(f"{ease}({share}) AS {k}")
    hit = " || ".join(f"CASE WHEN {k} > 5 THEN '{k},' ELSE '' END" for k in R.SAFETY_WORDS)
    warn = " || ".join(f"CASE WHEN {k} > 1 AND {k} <= 5 THEN '{k},' ELSE '' END" for k in R.SAFETY_WORDS)
    worst = f"greatest({', '.join(R.SAFETY_WORDS)})"
    return f"""WITH {RECORD_FEATURES}, g AS (SELECT record_id, {', '.join(parts)} FROM f)
  SELECT record_id, round({worst}, 6) AS severity, {worst} <= 5 AS is_safe, rtrim({hit}, ',') AS violations, rtrim({warn}, ',') AS warnings FROM g"""


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_features(spread(table(spark, sf_dir, "refined_commands_filtered").select("record_id", "text", "source")))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorded(spark, sf_dir).select("record_id", "n_chars", R.inappropriate_flags().alias("flags"))


@query(_safety_sql())
def flt_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = recorded(spark, sf_dir).select("record_id", R.safety_shares().alias("s"))
    g = shares.select("record_id", R.safety_grade(F.col("s")).alias("g"))
    return g.select("record_id", r6(F.col("g.severity")).alias("severity"), "g.is_safe", F.array_join("g.violations", ",").alias("violations"), F.array_join("g.warnings", ",").alias("warnings"))


def _inappropriate_sql() -> tuple[str, str]:
    def phrase(ws: Sequence[str]) -> str:
        return rf"regexp_matches(lower(t), '(^|[^\p{{L}}\p{{N}}_])({'|'.join(ws)})($|[^\p{{L}}\p{{N}}_])')"

    most = "coalesce(list_max(list_transform(list_distinct(lwords), lambda w: len(list_filter(lwords, lambda x: x = w)))), 0)"
    hits = [(k, 0.3, phrase(ws)) for k, ws in R.INAPPROPRIATE]
    hits += [
        ("excessive_repetition", 0.2, f"(n_words > 10 AND {most} > n_words * 0.3::DOUBLE)"),
        ("excessive_caps", 0.1, "(n_chars > 20 AND upper(t) = t AND lower(t) <> t)"),
        ("too_short", 0.1, "(n_chars < 10 AND n_chars > 0)"),
        ("too_long", 0.1, "n_chars > 5000"),
    ]
    flags = ", ".join(f"{c} AS h{i}" for i, (_, _, c) in enumerate(hits))
    names = "[" + ", ".join(f"CASE WHEN h{i} THEN '{k}' END" for i, (k, _, _) in enumerate(hits)) + "]"
    total = " + ".join(f"CASE WHEN h{i} THEN {w}::DOUBLE ELSE 0 END" for i, (_, w, _) in enumerate(hits))
    base = f"WITH {RECORD_FEATURES}, g AS (SELECT record_id, n_chars, {flags} FROM f), l AS (SELECT *, list_filter({names}, lambda x: x IS NOT NULL) AS reasons FROM g)"
    first = f"{base} SELECT record_id, array_to_string(reasons, ',') AS reasons, round(least(1.0::DOUBLE, {total}), 6) AS confidence FROM l"
    once = f"{base} SELECT record_id, array_to_string(list_sort(list_distinct(CASE WHEN n_chars = 0 THEN list_append(reasons, 'too_short') ELSE reasons END)), ',') AS categories FROM l"
    return first, once


INAPPROPRIATE_SQL, INAPPROPRIATE_ONCE_SQL = _inappropriate_sql()


@query(INAPPROPRIATE_SQL)
def flt_inappropriate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = flagged(spark, sf_dir).select("record_id", R.inappropriate(F.col("flags")).alias("g"))
    return g.select("record_id", F.array_join("g.reasons", ",").alias("reasons"), r6(F.col("g.confidence")).alias("confidence"))


@query(INAPPROPRIATE_ONCE_SQL)
def flt_inappropriate_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).select("record_id", F.array_join(F.array_sort(R.inappropriate_categories(F.col("flags"))), ",").alias("categories"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One verdict a sample: the same sample sent twice is the same row."""
    v = table(spark, sf_dir, "inappropriate_filter_jason").filter("toxicity_analysis is not null")
    a = F.col("toxicity_analysis")
    return v.groupBy("sample_id").agg(F.min(F.struct(a["is_toxic"].alias("is_toxic"), a["confidence"].alias("confidence"), a["label"].alias("label"), a["raw_score"].alias("raw_score"), a["text_length"].alias("text_length"), F.size(a["rule_based_reasons"]).alias("n_reasons"))).alias("v")).select("sample_id", "v.*")


VERDICTS_SQL = """v AS (SELECT sample_id, min(struct_pack(is_toxic := toxicity_analysis.is_toxic, confidence := toxicity_analysis.confidence, label := toxicity_analysis.label,
  raw_score := toxicity_analysis.raw_score, text_length := toxicity_analysis.text_length, n_reasons := coalesce(len(toxicity_analysis.rule_based_reasons), -1))) AS s
  FROM inappropriate_filter_jason WHERE toxicity_analysis IS NOT NULL GROUP BY sample_id),
  u AS (SELECT sample_id, s.is_toxic AS is_toxic, s.confidence AS confidence, s.label AS label, s.raw_score AS raw_score, s.text_length AS text_length, s.n_reasons AS n_reasons FROM v)"""


@query("""SELECT DISTINCT sample_id FROM inappropriate_filter_jason WHERE upper(trim(toxicity_analysis.label)) = 'TOXIC' AND toxicity_analysis.raw_score > 0.8""")
def flt_rethreshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("toxicity_analysis")
    return table(spark, sf_dir, "inappropriate_filter_jason").filter((F.upper(F.trim(a["label"])) == "TOXIC") & (a["raw_score"] > 0.8)).select("sample_id").distinct()


@query(
    f"""WITH {INAPPROPRIATE_SQL[5:].split(' SELECT record_id, array_to_string(reasons')[0]},
  r AS (SELECT record_id, reasons, least(1.0::DOUBLE, {INAPPROPRIATE_SQL.split('least(1.0::DOUBLE, ')[1].split('), 6)')[0]}) AS confidence, n_chars FROM l),
  m AS (SELECT record_id, s.raw AS raw, s.label AS label FROM (SELECT record_id, max(struct_pack(at := processed_at, label := upper(trim(toxicity_analysis.label)), raw := coalesce(toxicity_analysis.raw_score, -1))) AS s FROM inappropriate_filter_jason WHERE record_id IS NOT NULL AND toxicity_analysis.label IS NOT NULL GROUP BY record_id)),
  j AS (SELECT r.*, raw, label FROM r LEFT JOIN m USING (record_id))
  SELECT record_id, CASE WHEN n_chars < 3 THEN false WHEN confidence > 0.5 THEN true ELSE coalesce(label = 'TOXIC' AND raw > 0.5, false) END AS is_toxic,
  round(CASE WHEN n_chars < 3 THEN 0 WHEN confidence > 0.5 THEN confidence WHEN len(reasons) > 0 THEN least(1.0::DOUBLE, greatest(coalesce(raw, 0), 0) + 0.2::DOUBLE * confidence) ELSE greatest(coalesce(raw, 0), 0) END, 6) AS confidence FROM j"""
)
def flt_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules first, then the stored model score: a text that the rules settle doesn't need the model."""
    rules = flagged(spark, sf_dir).select("record_id", "n_chars", R.inappropriate(F.col("flags")).alias("g"))
    a = F.col("toxicity_analysis")
    # The latest verdict counts, as a whole.
    last = F.max(F.struct("processed_at", F.upper(F.trim(a["label"])).alias("label"), F.coalesce(a["raw_score"], F.lit(-1.0)).alias("raw"))).alias("v")
    held = table(spark, sf_dir, "inappropriate_filter_jason").filter(F.col("record_id").isNotNull() & a["label"].isNotNull()).groupBy("record_id").agg(last)
    model = held.select("record_id", "v.label", F.when(F.col("v.raw") >= 0, F.col("v.raw")).alias("raw"))
    d = R.toxicity_decision(F.col("label"), F.col("raw"), F.col("g.reasons"), F.col("g.confidence"), F.col("n_chars"))
    return rules.join(model, "record_id", "left").select("record_id", d.alias("d")).select("record_id", "d.is_toxic", r6(F.col("d.confidence")).alias("confidence"))


# -- scores


@query(
    f"""WITH {QUALITY_CTE} SELECT doc_id, round(readability, 6) AS readability, round(diversity, 6) AS diversity, round(engagement, 6) AS engagement,
  round(coherence, 6) AS coherence, round(length_score, 6) AS length, round(overall, 6) AS overall FROM o"""
)
def scr_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qualities(spark, sf_dir).select("doc_id", *(r6(F.col(c)).alias(c) for c in ("readability", "diversity", "engagement", "coherence", "length", "overall")))


HEURISTIC_SQL = r"""least(CASE WHEN n_chars BETWEEN 50 AND 2000 THEN 0.3::DOUBLE WHEN n_chars BETWEEN 20 AND 5000 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
  + least(len(list_distinct(regexp_extract_all(lower(t), '(?s).')))::DOUBLE / greatest(n_chars, 1) * 0.3::DOUBLE, 0.3::DOUBLE)
  + CASE WHEN n_words = 0 THEN 0.0::DOUBLE ELSE least(len(list_distinct(lwords))::DOUBLE / n_words * 0.2::DOUBLE, 0.2::DOUBLE) END
  + CASE WHEN regexp_matches(t, '[.!?]') THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE)"""


@query(f"WITH {FEATURES}, h AS (SELECT doc_id, n_chars, {HEURISTIC_SQL} AS score FROM f) SELECT doc_id, round(score, 6) AS score, n_chars >= 10 AND score >= 0.3::DOUBLE AS kept FROM h")
def scr_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = featured(spark, sf_dir).withColumn("score", S.heuristic_quality())
    return f.select("doc_id", r6(F.col("score")).alias("score"), ((F.col("n_chars") >= 10) & (F.col("score") >= 0.3)).alias("kept"))


def reward_sql(threshold: float = 0.2, weight: float = 1.0) -> str:
    calls = " + ".join(f"contains(lower(t), {quoted(p)})::INT" for p in S.CALL_PARTS)
    score = f"(least(1.0::DOUBLE, n_chars::DOUBLE / 500) * 0.3::DOUBLE + len(list_distinct(lwords))::DOUBLE / n_words * 0.4::DOUBLE + ({calls})::DOUBLE / 9 * {weight}::DOUBLE * 0.3::DOUBLE)"
    return f"CASE WHEN n_chars NOT BETWEEN 50 AND 2000 OR n_words = 0 THEN 0.0::DOUBLE WHEN {score} < {threshold}::DOUBLE THEN 0.0::DOUBLE ELSE {score} END"


@query(f"WITH {FEATURES} SELECT doc_id, round({reward_sql()}, 6) AS reward, round({reward_sql(0.1, 2.0)}, 6) AS weighted FROM f")
def scr_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = featured(spark, sf_dir)
    return f.select("doc_id", r6(S.simple_reward()).alias("reward"), r6(S.simple_reward(threshold=0.1, weight=2.0)).alias("weighted"))


# Descriptions and weights of the categories.
DESCRIBED = {
    "roleplay": "Enhancing performance in interactive digital environments.",
    "reasoning": "Improving complex problem-solving for downstream applications like robotics.",
    "function_calling": "Optimizing models for mobile device interactions.",
    "rag": "Boosting capabilities in retrieval-augmented applications.",
}
CATEGORY_WEIGHTS = {"function_calling": 0.3, "roleplay": 0.2, "reasoning": 0.3, "rag": 0.2}
TFIDF_CTE = rf"""{FEATURES}, notes AS (SELECT * FROM {values(list(DESCRIBED.items()), 'category, note')}),
  tt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM d) GROUP BY ALL),
  nt AS (SELECT category, term, count(*) AS tf FROM (SELECT category, unnest(regexp_extract_all(lower(note), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM notes) GROUP BY ALL),
  dfs AS (SELECT term, count(*) AS df FROM (SELECT term FROM tt UNION ALL SELECT term FROM nt) GROUP BY term),
  idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM d) + 4) / (1.0::DOUBLE + df)) + 1 AS idf FROM dfs),
  wt AS (SELECT doc_id, term, tf * idf AS w FROM tt JOIN idf USING (term)), wn AS (SELECT category, term, tf * idf AS w FROM nt JOIN idf USING (term)),
  ln_ AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM wt GROUP BY doc_id), nn AS (SELECT category, sqrt(sum(w * w)) AS norm FROM wn GROUP BY category),
  dots AS (SELECT doc_id, category, sum(wt.w * wn.w) AS dot FROM wt JOIN wn USING (term) GROUP BY ALL),
  cosines AS (SELECT d.doc_id, notes.category, coalesce(dot / (ln_.norm * nn.norm), 0.0::DOUBLE) AS similarity FROM d CROSS JOIN notes LEFT JOIN dots USING (doc_id, category) LEFT JOIN ln_ USING (doc_id) LEFT JOIN nn USING (category))"""


@query(f"WITH {TFIDF_CTE} SELECT doc_id, category, round(similarity, 6) AS similarity FROM cosines")
def sim_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.tfidf_similarity(docs(spark, sf_dir), "doc_id", "text", DESCRIBED).withColumn("similarity", r6(F.col("similarity")))


def _soft_sql() -> str:
    weights = " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in CATEGORY_WEIGHTS.items())
    marks = " + ".join(f"contains(t, '{m}')::INT" for m in "()=")
    named = " + ".join(f"list_contains(toks, '{w}')::INT" for w in S.CALL_WORDS)
    return f"""WITH {TFIDF_CTE}, c AS (SELECT doc_id, sum(similarity * CASE category {weights} END) AS topic FROM cosines GROUP BY doc_id)
  SELECT doc_id, round(CASE WHEN n_words = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / (1.0::DOUBLE + exp(-((n_chars - 50) / 150.0::DOUBLE))) * (1.0::DOUBLE / (1.0::DOUBLE + exp(-((2000.0::DOUBLE - n_chars) / 500.0::DOUBLE)))) * 0.3::DOUBLE
    + len(list_distinct(lwords))::DOUBLE / n_words * 0.3::DOUBLE + ({marks} + {named})::DOUBLE / 9 * 0.2::DOUBLE + topic * 0.2::DOUBLE END, 6) AS reward FROM f JOIN c USING (doc_id)"""


@query(_soft_sql())
def scr_soft_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = F.create_map(*[F.lit(x) for kv in CATEGORY_WEIGHTS.items() for x in kv])
    topics = similarity.tfidf_similarity(docs(spark, sf_dir), "doc_id", "text", DESCRIBED).groupBy("doc_id").agg(F.sum(F.col("similarity") * weights[F.col("category")]).alias("topic"))
    f = featured(spark, sf_dir).join(topics, "doc_id")
    score = S.soft_length(F.col("n_chars")) * F.lit(0.3) + F.col("n_distinct") / F.col("n_words") * F.lit(0.3) + S.call_word_share() * F.lit(0.2) + F.col("topic") * F.lit(0.2)
    return f.select("doc_id", r6(F.when(F.col("n_words") == 0, 0.0).otherwise(score)).alias("reward"))


def _command_sql() -> str:
    counts = ", ".join(f"len(regexp_extract_all(t, {quoted(C.command_pattern(p))})) AS c{i}" for i, (*_, p) in enumerate(C.COMMANDS))
    by = {g: " + ".join(f"c{i} * {w}" for i, (k, _, w, _) in enumerate(C.COMMANDS) if k == g) for g in C.GROUPS}
    groups = ", ".join(f"({v}) AS {g if g != 'time' else 'times'}" for g, v in by.items())
    every = range(len(C.COMMANDS))
    raw = "(actions + devices + times + location + services + imperatives)"
    return f"""WITH s AS (SELECT record_id AS id, coalesce(text, '') AS t FROM refined_commands_filtered),
  c AS (SELECT id, length(t) AS n, {counts} FROM s), g AS (SELECT *, {groups}, {' + '.join(f'(c{i} > 0)::INT' for i in every)} AS kinds, {' + '.join(f'c{i}' for i in every)} AS matches FROM c),
  k AS (SELECT *, CASE WHEN n > 0 THEN least(100.0::DOUBLE, {raw}::DOUBLE / (n / 1000.0::DOUBLE)) ELSE 0.0::DOUBLE END AS score,
    {' + '.join(f'({g} > 0)::INT' for g in ('actions', 'devices', 'times', 'location', 'services', 'imperatives'))} AS types FROM g),
  r AS (SELECT *, CASE WHEN score >= 8 THEN 'score' WHEN imperatives > 25 THEN 'imperative' WHEN actions > 10 AND devices > 10 THEN 'action_device' WHEN actions > 10 AND times > 15 THEN 'action_time'
    WHEN types >= 2 AND kinds >= 2 THEN 'several_types' WHEN services > 15 AND actions > 10 THEN 'service_action' WHEN n > 0 AND matches / (n / 100.0::DOUBLE) >= 0.05::DOUBLE THEN 'ratio' ELSE 'insufficient' END AS reason FROM k)
  SELECT id, round(score, 6) AS score, reason <> 'insufficient' AS keep, reason FROM r"""


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = spread(table(spark, sf_dir, "refined_commands_filtered").select(F.col("record_id").alias("id"), T.text_or_empty("text").alias("t")))
    counted = every.select("id", F.length("t").alias("n"), C.command_counts(F.col("t")).alias("counts"))
    return counted.select("id", C.command_scores(F.col("counts"), F.col("n")).alias("c")).select("id", "c.*")


@query(_command_sql())
def scr_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands(spark, sf_dir).select("id", r6(F.col("score")).alias("score"), "keep", "reason")


LM_CTE = f"""{FEATURES}, o AS (SELECT doc_id, unnest(lwords) AS w, generate_subscripts(lwords, 1) AS i FROM f),
  p AS (SELECT w, -ln(greatest(count(*)::DOUBLE / (SELECT count(*) FROM o), 1e-10)) AS loss FROM o GROUP BY w),
  x AS (SELECT doc_id, i, o.w, loss FROM o JOIN p USING (w)), m AS (SELECT doc_id, max(loss) AS top FROM x GROUP BY doc_id)"""


@query(
    f"""WITH {LM_CTE}, a AS (SELECT doc_id, avg(loss) FILTER (WHERE i > 1) AS a FROM x GROUP BY doc_id)
  SELECT doc_id, n_words::BIGINT AS num_tokens, round(coalesce(a, 0.0::DOUBLE), 6) AS avg_score, round(ln(exp(coalesce(a, 0.0::DOUBLE))), 6) AS log_perplexity FROM f LEFT JOIN a USING (doc_id)"""
)
def scr_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.lm_scores(docs(spark, sf_dir), "doc_id", "text")
    return s.select("doc_id", "num_tokens", r6(F.col("avg_score")).alias("avg_score"), r6(F.log("perplexity")).alias("log_perplexity"))


@query(
    f"""WITH {LM_CTE}, k AS (SELECT doc_id, count(*) AS kept, round(avg(loss / top), 6) AS mean_rho FROM x JOIN m USING (doc_id) WHERE loss / top >= 0.5::DOUBLE GROUP BY doc_id)
  SELECT doc_id, coalesce(kept, 0)::BIGINT AS kept, mean_rho FROM f LEFT JOIN k USING (doc_id)"""
)
def scr_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    rho = scoring.rho_scores(docs(spark, sf_dir), "doc_id", "text").select("doc_id", F.filter("rho", lambda x: x >= 0.5).alias("k"))
    mean = F.aggregate("k", F.lit(0.0), lambda a, x: a + x) / F.size("k")
    return rho.select("doc_id", F.size("k").cast("long").alias("kept"), r6(F.when(F.size("k") > 0, mean)).alias("mean_rho"))


@query(
    f"""WITH {LM_CTE}, k AS (SELECT x.doc_id, string_agg(f.words[x.i], ' ' ORDER BY x.i) AS cleaned FROM x JOIN m USING (doc_id) JOIN f ON f.doc_id = x.doc_id WHERE loss / top >= 0.5::DOUBLE GROUP BY x.doc_id)
  SELECT doc_id, coalesce(cleaned, '') AS cleaned FROM f LEFT JOIN k USING (doc_id)"""
)
def scr_cleaned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.clean_tokens(docs(spark, sf_dir), "doc_id", "text", 0.5)


@query(
    f"""WITH {LM_CTE}, a AS (SELECT doc_id, coalesce(avg(loss) FILTER (WHERE i > 1), 0.0::DOUBLE) AS a FROM x GROUP BY doc_id), e AS (SELECT doc_id, round(coalesce(a.a, 0.0::DOUBLE), 6) AS a FROM f LEFT JOIN a USING (doc_id))
  SELECT doc_id, a FROM e WHERE a >= (SELECT quantile_cont(a, 0.75) FROM e)"""
)
def flt_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cut(scoring.lm_scores(docs(spark, sf_dir), "doc_id", "text").select("doc_id", r6(F.col("avg_score")).alias("a")))
    return stats.percentile_filter(s, "a").select("doc_id", "a")


def _response_sql() -> str:
    ws = C.KEYWORDS["function_calling"]
    hits = " + ".join(f"contains(lower({x}), {quoted(w.lower())})::INT" for x in ("a.t", "b.t") for w in ws)
    return f"""WITH {FEATURES} SELECT a.doc_id, round(({hits})::DOUBLE / {2 * len(ws)} * 0.7::DOUBLE
  + CASE WHEN len(a.lwords) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(list_distinct(a.lwords), list_distinct(b.lwords)))::DOUBLE / len(list_distinct(a.lwords)) END * 0.3::DOUBLE, 6) AS score,
  round(1 - (({hits})::DOUBLE / {2 * len(ws)} * 0.7::DOUBLE + CASE WHEN len(a.lwords) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(list_distinct(a.lwords), list_distinct(b.lwords)))::DOUBLE / len(list_distinct(a.lwords)) END * 0.3::DOUBLE), 6) AS potential
  FROM f a JOIN f b ON b.doc_id = a.doc_id + 1"""


@query(_response_sql())
def scr_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the next document would answer this one, for want of a generating model."""
    f = featured(spark, sf_dir).select("doc_id", "t", "lwords")
    nxt = f.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("t2"), F.col("lwords").alias("w2"))
    s = f.join(nxt, "doc_id").withColumn("score", S.response_score(F.col("t"), F.col("t2"), F.col("lwords"), F.col("w2"), C.KEYWORDS["function_calling"]))
    return s.select("doc_id", r6(F.col("score")).alias("score"), r6(F.lit(1) - F.col("score")).alias("potential"))


# -- categories


def _weighted_sql(x: str, table_: C.KeywordTable) -> dict[str, str]:
    return {k: " + ".join(f"CASE WHEN contains({x}, {quoted(w)}) THEN {n} ELSE 0 END" for w, n in C._weights(ws).items()) for k, ws in table_.items()}


def _category_sql() -> str:
    low = "lower(t)"
    every = "[" + ", ".join(f"CASE WHEN {any_part(low, [w.lower() for w in ws])} THEN '{k}' END" for k, ws in C.KEYWORDS.items()) + "]"
    first = " ".join(f"WHEN {any_part(low, ws)} THEN '{k}'" for k, ws in C.FIRST_MATCH.items())
    weights = ", ".join(f"({v}) AS w_{k}" for k, v in _weighted_sql(low, C.PRESELECT_CATEGORIES).items())
    best = "greatest(" + ", ".join(f"w_{k}" for k in C.KEYWORDS) + ")"
    chosen = " ".join(f"WHEN w_{k} = {best} THEN '{k}'" for k in C.TIE_ORDER)
    count = " + ".join(f"(length({low}) - length(replace({low}, {quoted(w)}, ''))) // {len(w)} * {n}" for w, n in C._weights(C.KEYWORDS["reasoning"]).items())
    return f"""WITH {FEATURES}, c AS (SELECT doc_id, array_to_string(list_filter({every}, lambda x: x IS NOT NULL), ',') AS all_categories, CASE {first} ELSE 'uncategorized' END AS first_category, {weights}, ({count})::BIGINT AS reasoning_score FROM d)
  SELECT doc_id, all_categories, first_category, CASE WHEN {best} < 1 THEN 'uncategorized' {chosen} END AS best_category, reasoning_score FROM c"""


@query(_category_sql())
def cat_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower(T.text_or_empty("text"))
    return docs(spark, sf_dir).select(
        "doc_id",
        F.array_join(C.all_matching(low), ",").alias("all_categories"),
        C.first_matching(low).alias("first_category"),
        C.best_weighted(low).alias("best_category"),
        C.occurrence_score(low, C.KEYWORDS["reasoning"]).alias("reasoning_score"),
    )


def _scorers_sql() -> str:
    cols = ", ".join(f"max(similarity) FILTER (WHERE category = '{k}') * {w}::DOUBLE AS s_{k}" for k, w in CATEGORY_WEIGHTS.items())
    top = "greatest(" + ", ".join(f"s_{k}" for k in CATEGORY_WEIGHTS) + ")"
    best = " ".join(f"WHEN s_{k} = {top} THEN '{k}'" for k in CATEGORY_WEIGHTS)
    mean = "(" + " + ".join(f"s_{k}" for k in CATEGORY_WEIGHTS) + f") / {len(CATEGORY_WEIGHTS)}"
    return f"WITH {TFIDF_CTE}, w AS (SELECT doc_id, {cols} FROM (SELECT doc_id, category, round(similarity, 9) AS similarity FROM cosines) GROUP BY doc_id) SELECT doc_id, round({mean}, 6) AS overall, CASE {best} END AS best, {mean} > 0.005::DOUBLE AS keep FROM w"


@query(_scorers_sql())
def cat_scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scorer a category, here TF-IDF with its description, weighted; mean, best and whether to keep."""
    found = similarity.tfidf_similarity(docs(spark, sf_dir), "doc_id", "text", DESCRIBED)
    wide = found.groupBy("doc_id").agg(*[F.max(F.when(F.col("category") == k, F.round("similarity", 9))).alias(k) for k in CATEGORY_WEIGHTS])
    w = wide.select("doc_id", examples.weighted_best({k: F.col(k) for k in CATEGORY_WEIGHTS}, CATEGORY_WEIGHTS, 0.005).alias("w"))
    return w.select("doc_id", r6(F.col("w.overall")).alias("overall"), "w.best", "w.keep")


@query(
    f"WITH {FEATURES}, s AS (SELECT doc_id, coalesce(lang, 'unknown') AS lang, round({HEURISTIC_SQL}, 6) AS s FROM f), "
    "l AS (SELECT doc_id, lang, CASE WHEN s > 0.7::DOUBLE THEN 1 WHEN s < 0.3::DOUBLE AND 1 - s > 0.7::DOUBLE THEN 0 END AS label FROM s) "
    "SELECT lang, label::BIGINT AS label, count(*) AS records FROM l WHERE label IS NOT NULL AND lang IN (SELECT lang FROM l WHERE label IS NOT NULL GROUP BY lang HAVING count(*) >= 10) GROUP BY ALL"
)
def cat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = featured(spark, sf_dir).select("doc_id", F.coalesce("lang", F.lit("unknown")).alias("lang"), r6(S.heuristic_quality()).alias("s"))
    return examples.labelled_examples(s, "lang", "s").groupBy("lang", "label").agg(F.count(F.lit(1)).alias("records"))


# -- duplicates


@query(f"WITH {FEATURES} SELECT min(doc_id) AS doc_id, sha256({normal_sql('t')}) AS sha FROM d WHERE length({strip_sql('t')}) >= 10 GROUP BY 2")
def dup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_survivors(docs(spark, sf_dir), "doc_id", "text")


@query(
    f"""WITH {FEATURES}, k AS (SELECT count(DISTINCT sha256({normal_sql('t')})) AS u FROM d WHERE length({strip_sql('t')}) >= 10)
  SELECT (SELECT count(*) FROM d) AS total_rows, u AS unique_rows, round(u::DOUBLE / (SELECT count(*) FROM d), 6) AS unique_ratio FROM k"""
)
def dup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_ratio(docs(spark, sf_dir), "doc_id", "text")


def near_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = dedup.signatures(docs(spark, sf_dir), "doc_id", "text", dedup.word_ngrams(5), dedup.AT_08)
    return dedup.band_buckets(signed, dedup.AT_08)


_B = dedup.AT_08


@query(
    f"""WITH RECURSIVE {FEATURES},
  g AS (SELECT DISTINCT doc_id, array_to_string(lwords[i:i + 4], ' ') AS s FROM (SELECT doc_id, lwords, unnest(range(1, greatest(len(lwords) - 3, 1))) AS i FROM f WHERE len(lwords) >= 5)),
  h AS (SELECT doc_id, ('0x' || substr(md5(s), 1, 8))::BIGINT AS h FROM g),
  j AS (SELECT j, (j * 2654435761 + 1) % 1073741824 AS a, (j * 40503 + 7) % 1073741824 AS b FROM range(1, {_B.permutations + 1}) t(j)),
  m AS (SELECT doc_id, j, min((a * h + b) % {dedup.PRIME}) AS v FROM h CROSS JOIN j WHERE j <= {_B.bands * _B.rows} GROUP BY doc_id, j),
  b AS (SELECT doc_id, (j - 1) // {_B.rows} AS band, string_agg(v::VARCHAR, ',' ORDER BY j) AS k FROM m GROUP BY ALL
        UNION ALL SELECT doc_id, -1, 'empty' FROM f WHERE len(lwords) < 5),
  e AS (SELECT DISTINCT x.doc_id AS u, y.low AS v FROM b x JOIN (SELECT band, k, min(doc_id) AS low FROM b GROUP BY ALL) y USING (band, k)),
  two AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
  r AS (SELECT doc_id AS n, doc_id AS c FROM f UNION SELECT two.u, r.c FROM r JOIN two ON two.v = r.n WHERE r.c < two.u)
  SELECT doc_id, least(doc_id, min(c)) AS component FROM f JOIN r ON n = doc_id GROUP BY doc_id"""
)
def dup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = docs(spark, sf_dir).select("doc_id")
    return dedup.components(nodes, dedup.bucket_stars(near_buckets(spark, sf_dir)), "doc_id")


_G = dedup.AT_05


@query(
    f"""WITH RECURSIVE {FEATURES}, first AS (SELECT min(doc_id) AS doc_id FROM d WHERE length({strip_sql('t')}) >= 10 GROUP BY sha256({normal_sql('t')})),
  t1 AS (SELECT f.doc_id, {normal_sql('t')} AS t FROM f JOIN first USING (doc_id) WHERE n_words >= 5),
  g AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(list_filter(string_split(t, ' '), lambda w: length(w) > 2)) AS s FROM t1
        UNION ALL SELECT doc_id, substr(t, i, 3) FROM (SELECT doc_id, t, unnest(range(1, greatest(length(t) - 1, 1))) AS i FROM t1))),
  h AS (SELECT doc_id, ('0x' || substr(md5(s), 1, 8))::BIGINT AS h FROM g),
  j AS (SELECT j, (j * 2654435761 + 1) % 1073741824 AS a, (j * 40503 + 7) % 1073741824 AS b FROM range(1, {_G.bands * _G.rows + 1}) t(j)),
  m AS (SELECT doc_id, j, min((a * h + b) % {dedup.PRIME}) AS v FROM h CROSS JOIN j GROUP BY doc_id, j),
  b AS (SELECT doc_id, hash((j - 1) // {_G.rows}, string_agg(v::VARCHAR, ',' ORDER BY j)) AS k FROM m GROUP BY doc_id, (j - 1) // {_G.rows}),
  shared AS (SELECT k FROM b GROUP BY k HAVING count(*) > 1),
  c AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, ks FROM (SELECT doc_id, list(k) AS ks FROM b WHERE k IN (SELECT k FROM shared) GROUP BY doc_id)),
  r AS (SELECT 0::BIGINT AS n, []::UBIGINT[] AS used, NULL::BIGINT AS dropped
        UNION ALL SELECT c.n, CASE WHEN list_has_any(used, ks) THEN used ELSE list_concat(used, ks) END, CASE WHEN list_has_any(used, ks) THEN c.doc_id END FROM r JOIN c ON c.n = r.n + 1)
  SELECT doc_id FROM first WHERE doc_id NOT IN (SELECT dropped FROM r WHERE dropped IS NOT NULL)"""
)
def dup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and character trigrams at 0.5, first come first kept."""
    first = dedup.exact_survivors(docs(spark, sf_dir), "doc_id", "text").select("doc_id")
    rows = docs(spark, sf_dir).join(first, "doc_id", "left_semi")
    t = T.text_or_empty("text")
    long_enough = rows.filter(F.size(T.words(t)) >= 5)
    signed = dedup.signatures(long_enough, "doc_id", "text", dedup.words_and_trigrams, dedup.AT_05)
    return dedup.greedy_survivors(first, dedup.band_buckets(signed, dedup.AT_05), "doc_id")


# -- vectors


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@query("SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))), 6) AS total FROM embeddings")
def sim_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", r6(F.aggregate(similarity.normalise(F.col("vector")), F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(
    """WITH s AS (SELECT q.vec_id AS query_id, r.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS score
  FROM embeddings q CROSS JOIN embeddings r WHERE q.vec_id % 20 = 0)
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, id, round(score, 5) AS score FROM s QUALIFY rank <= 3"""
)
def sim_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector as a query against all, by cosine."""
    v = vectors(spark, sf_dir).select("id", similarity.normalise(F.col("vector")).alias("vector"))
    found = similarity.top_k(v.filter(F.pmod("id", F.lit(20)) == 0), v, similarity.TopK(k=3))
    return found.withColumn("score", F.round("score", 5))


@query()
def sim_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("id", "vector")
    found = similarity.ivf_top_k(v.filter(F.pmod("id", F.lit(20)) == 0), v, k=5)
    return found.withColumn("score", F.round("score", 5))


@query(
    """WITH r AS (SELECT vec_id AS rid, row_number() OVER (ORDER BY vec_id) - 1 AS i, embedding AS e FROM embeddings ORDER BY vec_id LIMIT 8),
  s AS (SELECT vec_id AS id, i, list_cosine_similarity(v.embedding::DOUBLE[], r.e::DOUBLE[]) AS c FROM embeddings v CROSS JOIN r),
  b AS (SELECT id, max(c) AS c, arg_max(i, c) AS i FROM s GROUP BY id)
  SELECT id, round(c, 5) AS similarity, CASE WHEN i < 3 THEN 'educational' WHEN i < 5 THEN 'code' WHEN i < 7 THEN 'reasoning' ELSE 'dialogue' END AS hint, c >= 0.3 AS passed FROM b"""
)
def sim_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against eight reference vectors, a fixed number."""
    v = vectors(spark, sf_dir).select("id", similarity.normalise(F.col("vector")).alias("v"))
    refs = v.orderBy("id").limit(8).agg(F.array_sort(F.collect_list(F.struct("id", F.col("v").alias("r")))).alias("refs"))
    scored = v.join(F.broadcast(refs)).select("id", F.transform("refs", lambda x: similarity.dot(F.col("v"), x["r"])).alias("s"))
    best = scored.select("id", F.array_max("s").alias("c"), (F.array_position("s", F.array_max("s")) - 1).alias("i"))
    hint = F.when(F.col("i") < 3, "educational").when(F.col("i") < 5, "code").when(F.col("i") < 7, "reasoning").otherwise("dialogue")
    return best.select("id", F.round("c", 5).alias("similarity"), hint.alias("hint"), (F.col("c") >= 0.3).alias("passed"))


# -- aggregates


TOKEN_STATS = "count(*) FILTER (WHERE n > 0) AS valid_records, count(*) FILTER (WHERE n IS NULL OR n <= 0) AS invalid_records, round(avg(n) FILTER (WHERE n > 0), 6) AS mean_tokens, round(median(n) FILTER (WHERE n > 0), 6) AS median_tokens, (min(n) FILTER (WHERE n > 0))::BIGINT AS min_tokens, max(n)::BIGINT AS max_tokens, round(stddev_pop(n) FILTER (WHERE n > 0), 6) AS std_tokens"
PIECES = "c AS (SELECT sample_id, piece_no, coalesce(cluster_id, 'unknown') AS cluster_id, nullif(len(tokens), 0) AS n FROM climblab_sample)"


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.when(F.size("tokens") > 0, F.size("tokens")).cast("long")
    return table(spark, sf_dir, "climblab_sample").select("sample_id", "piece_no", "cluster_id", n.alias("n"))


@query(f"WITH {PIECES} SELECT {TOKEN_STATS} FROM c")
def agg_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.length_stats(pieces(spark, sf_dir), "n")


@query(
    f"""WITH {PIECES}, b AS (SELECT CASE WHEN n < 100 THEN '0-100' WHEN n < 200 THEN '100-200' WHEN n < 500 THEN '200-500' WHEN n < 1000 THEN '500-1k' WHEN n < 2000 THEN '1k-2k' WHEN n < 3000 THEN '2k-3k' ELSE '3k+' END AS bin FROM c WHERE n > 0)
  SELECT bin, count(*) AS records, round(count(*) / sum(count(*)) OVER () * 100, 6) AS percentage FROM b GROUP BY bin"""
)
def agg_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.length_histogram(pieces(spark, sf_dir), "n")


@query(f"WITH {PIECES} SELECT count(*) AS total_records, count(*) FILTER (WHERE n IS NULL) AS empty_records, count(n) AS valid_records, count(*) FILTER (WHERE n < 80) AS short_records, count(*) FILTER (WHERE n > 3000) AS long_records FROM c")
def agg_length_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.length_quality(pieces(spark, sf_dir), "n")


@query(f"WITH {PIECES} SELECT cluster_id, count(*) AS records, sum(n)::BIGINT AS total_tokens, round(avg(n), 6) AS avg_tokens, min(n)::BIGINT AS min_tokens, max(n)::BIGINT AS max_tokens, round(stddev_pop(n), 6) AS std_tokens FROM c GROUP BY 1")
def agg_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.group_stats(pieces(spark, sf_dir), "cluster_id", "n")


@query(f"WITH {PIECES} SELECT count(*) AS total_samples, sum(n)::BIGINT AS total_tokens, count(DISTINCT cluster_id) AS clusters, round(sum(n)::DOUBLE / count(*), 6) AS avg_tokens FROM c")
def agg_cluster_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.group_totals(pieces(spark, sf_dir), "cluster_id", "n")


@query(f"WITH {PIECES} SELECT cluster_id, min(sample_id) AS first FROM c GROUP BY 1")
def agg_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.first_seen(pieces(spark, sf_dir), "cluster_id", "sample_id")


@query(
    f"""WITH {VERDICTS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE is_toxic) AS toxic, count(*) FILTER (WHERE NOT is_toxic) AS safe,
  round(count(*) FILTER (WHERE NOT is_toxic)::DOUBLE / count(*), 6) AS safe_ratio, round(avg(confidence) FILTER (WHERE is_toxic), 6) AS toxic_confidence, round(avg(confidence) FILTER (WHERE NOT is_toxic), 6) AS safe_confidence,
  min(text_length) AS min_length, max(text_length) AS max_length, round(avg(text_length), 6) AS avg_length, count(*) FILTER (WHERE n_reasons > 0) AS rule_catches,
  count(*) FILTER (WHERE upper(trim(label)) = 'TOXIC' AND raw_score > 0.5) AS model_catches, count(*) FILTER (WHERE n_reasons > 0 AND upper(trim(label)) = 'TOXIC' AND raw_score > 0.5) AS both_catches,
  count(*) FILTER (WHERE confidence < 0.3::DOUBLE) AS band_very_low, count(*) FILTER (WHERE confidence >= 0.3::DOUBLE AND confidence < 0.5::DOUBLE) AS band_low, count(*) FILTER (WHERE confidence >= 0.5::DOUBLE AND confidence < 0.7::DOUBLE) AS band_medium,
  count(*) FILTER (WHERE confidence >= 0.7::DOUBLE AND confidence < 0.9::DOUBLE) AS band_high, count(*) FILTER (WHERE confidence >= 0.9::DOUBLE) AS band_very_high FROM u"""
)
def agg_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.toxicity_report(verdicts(spark, sf_dir))


@query(f"WITH {VERDICTS_SQL} SELECT is_toxic, count(*) AS records, round(avg(confidence), 6) AS mean, round(stddev_pop(confidence), 6) AS std, round(min(confidence), 6) AS min, round(max(confidence), 6) AS max, round(median(confidence), 6) AS median FROM u GROUP BY 1")
def agg_data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary_by(verdicts(spark, sf_dir), "is_toxic", "confidence")


STAGES_SQL = f"""{QUALITY_CTE}, p AS (SELECT *, CASE WHEN NOT {PRESELECT_SQL} THEN 'preselect' WHEN n_words NOT BETWEEN 20 AND 1024 THEN 'word_count' WHEN readability < 0.2::DOUBLE THEN 'readability' WHEN diversity < 0.2::DOUBLE THEN 'diversity' WHEN overall < 0.4::DOUBLE THEN 'quality' END AS stage FROM o)"""
STAGES = ("preselect", "word_count", "readability", "diversity", "quality")


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = qualities(spark, sf_dir)
    return q.withColumn(
        "stage",
        pipeline.first_failure(
            {
                "preselect": R.preselect(),
                "word_count": F.col("n_words").between(20, 1024),
                "readability": F.col("readability") >= 0.2,
                "diversity": F.col("diversity") >= 0.2,
                "quality": F.col("overall") >= 0.4,
            }
        ),
    )


@query(
    f"""WITH {STAGES_SQL}, s AS (SELECT * FROM {values([(s, i) for i, s in enumerate(STAGES)], 'stage, i')}), r AS (SELECT s.stage, i, count(p.doc_id) AS rejected FROM s LEFT JOIN p ON p.stage = s.stage GROUP BY ALL)
  SELECT stage, rejected, ((SELECT count(*) FROM p) - sum(rejected) OVER (ORDER BY i))::BIGINT AS cleared FROM r"""
)
def agg_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.funnel(staged(spark, sf_dir).select("stage"), "stage", STAGES)


@query(f"WITH {STAGES_SQL} SELECT coalesce(stage, 'kept') AS stage, count(*) AS n, sum(n_chars)::BIGINT AS total, round(avg(n_chars), 6) AS mean, round(var_pop(n_chars), 4) AS variance, min(n_chars)::BIGINT AS least, max(n_chars)::BIGINT AS most FROM p GROUP BY 1")
def agg_stage_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return staged(spark, sf_dir).groupBy(F.coalesce("stage", F.lit("kept")).alias("stage")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(n).alias("total"), r6(F.avg(n)).alias("mean"), F.round(F.var_pop(n), 4).alias("variance"), F.min(n).alias("least"), F.max(n).alias("most")
    )


@query("WITH x AS (" + _category_sql() + ") SELECT category, count(*) AS records FROM (SELECT unnest(CASE WHEN all_categories = '' THEN ['none'] ELSE string_split(all_categories, ',') END) AS category FROM x) GROUP BY 1")
def agg_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distribution(docs(spark, sf_dir).select(C.all_matching(F.lower(T.text_or_empty("text"))).alias("c")), "c", none="none")


@query("WITH x AS (" + _command_sql() + ") SELECT reason, count(*) AS records FROM x GROUP BY 1")
def agg_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands(spark, sf_dir).groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


def _patterns_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT {quoted(d)} AS key, sum(c{i})::BIGINT AS total FROM c HAVING sum(c{i}) > 0" for i, (_, d, _, _) in enumerate(C.COMMANDS))
    return _command_sql().split(", g AS (SELECT *")[0] + " " + rows


@query(_patterns_sql())
def agg_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.map_totals(commands(spark, sf_dir), "patterns")


@query("WITH x AS (" + _command_sql() + ") SELECT count(*) AS total, count(*) FILTER (WHERE keep) AS kept, round(avg(score), 4) AS mean_score, round(median(score), 4) AS median_score, round(stddev_pop(score), 4) AS std_score, round(min(score), 4) AS min_score, round(max(score), 4) AS max_score, round(count(*) FILTER (WHERE keep) * 100.0::DOUBLE / count(*), 6) AS retention FROM x")
def agg_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.score_distribution(commands(spark, sf_dir), "score", "keep")
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c.endswith("_score")})


@query(
    f"""WITH {FEATURES}, u AS (SELECT 'all' AS dataset, n_chars FROM f UNION ALL SELECT 'preselected', n_chars FROM f WHERE {PRESELECT_SQL} UNION ALL SELECT 'rewarded', n_chars FROM f WHERE {reward_sql()} > 0),
  s AS (SELECT dataset, count(*) AS records, sum(n_chars)::BIGINT AS characters, avg(n_chars) AS a FROM u GROUP BY 1), b AS (SELECT records AS r, a AS ba FROM s WHERE dataset = 'all')
  SELECT dataset, records, characters, round(a, 6) AS avg_length, round(records * 100.0::DOUBLE / r, 6) AS retention, round(a / ba, 6) AS compression, CASE WHEN records * 100.0 / r > 50 THEN 'HIGH' WHEN records * 100.0 / r > 25 THEN 'MODERATE' ELSE 'LOW' END AS focus FROM s CROSS JOIN b"""
)
def agg_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = featured(spark, sf_dir)
    return stats.compare_datasets({"all": f, "preselected": f.filter(R.preselect()), "rewarded": f.filter(S.simple_reward() > 0)}, "all")


OLD_SQL = "e AS (SELECT record_id, lower(trim(category)) AS category, CASE WHEN quality_score >= 0 AND NOT isnan(quality_score) THEN quality_score END AS quality_score, exported_at FROM oldfilteringbig1900cursorcode)"


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quality_score")
    return table(spark, sf_dir, "oldfilteringbig1900cursorcode").select("record_id", F.lower(F.trim("category")).alias("category"), F.when((q >= 0) & ~F.isnan(q), q).alias("quality_score"), "filter_passed", "category_relevant", "exported_at")


@query(f"WITH {OLD_SQL} SELECT category, count(*) AS records, round(avg(quality_score), 6) AS mean, round(stddev_pop(quality_score), 6) AS std, round(min(quality_score), 6) AS min, round(max(quality_score), 6) AS max, round(median(quality_score), 6) AS median FROM e GROUP BY 1")
def agg_export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary_by(exports(spark, sf_dir), "category", "quality_score")


READY = ("function_calling", "reasoning", "roleplay", "rag", "code")


@query(f"WITH {OLD_SQL}, c AS (SELECT * FROM {values([(c,) for c in READY], 'category')}), k AS (SELECT c.category, count(e.record_id) AS records FROM c LEFT JOIN e USING (category) GROUP BY 1) SELECT category, records, records >= 100 AS ready, records >= 1000 AS recommended FROM k")
def agg_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.readiness(exports(spark, sf_dir), "category", READY)


@query(f"WITH {OLD_SQL} SELECT record_id, category, round(quality_score - avg(quality_score) OVER (PARTITION BY category), 6) AS improvement FROM e WHERE category IS NOT NULL")
def jn_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores less their category's mean, joined back from the small table of means."""
    e = exports(spark, sf_dir)
    means = e.filter("category is not null").groupBy("category").agg(F.avg("quality_score").alias("m"))
    return e.join(means, "category").select("record_id", "category", r6(F.col("quality_score") - F.col("m")).alias("improvement"))


@query(f"WITH {OLD_SQL} SELECT record_id, category, row_number() OVER (PARTITION BY category ORDER BY quality_score DESC, record_id, exported_at) AS rank FROM e WHERE category IS NOT NULL AND quality_score IS NOT NULL")
def win_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = exports(spark, sf_dir).filter("category is not null and quality_score is not null").withColumn("key", F.struct("record_id", "exported_at"))
    return stats.ranked_within(e, "category", "quality_score", "key").select("record_id", "category", "rank")


@query(f"WITH {FEATURES}, s AS (SELECT {reward_sql()} AS s FROM f) SELECT round(CASE WHEN count(*) FILTER (WHERE s > 0) < 3 THEN 0 ELSE least(1.0::DOUBLE, avg(s) FILTER (WHERE s > 0) + least(0.2::DOUBLE, count(*) FILTER (WHERE s > 0) / 100.0::DOUBLE)) END, 6) AS reward FROM s")
def agg_corpus_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = featured(spark, sf_dir).select(S.simple_reward().alias("s"))
    return s.agg(r6(S.corpus_reward(F.col("s"), F.col("s") > 0)).alias("reward"))


LABELLED = "t AS (SELECT record_id, bool_or(lower(trim(answer)) = 'yes') AS truth FROM record_labels WHERE aspect = 'abuse' GROUP BY 1), s AS (SELECT record_id, bool_or(toxicity_analysis.is_toxic) AS said FROM inappropriate_filter_jason GROUP BY 1), j AS (SELECT truth, said FROM t JOIN s USING (record_id) WHERE truth IS NOT NULL AND said IS NOT NULL), c AS (SELECT count(*) AS n, count(*) FILTER (WHERE truth AND said) AS tp, count(*) FILTER (WHERE NOT truth AND said) AS fp, count(*) FILTER (WHERE truth AND NOT said) AS fn FROM j)"


@query(f"WITH {LABELLED} SELECT n, round((n - fp - fn)::DOUBLE / n, 6) AS accuracy, coalesce(round(tp::DOUBLE / nullif(tp + fp, 0), 6), 0) AS precision, coalesce(round(tp::DOUBLE / nullif(tp + fn, 0), 6), 0) AS recall, coalesce(round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 6), 0) AS f1 FROM c")
def agg_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older model's verdicts against the hand labels."""
    truth = table(spark, sf_dir, "record_labels").filter("aspect = 'abuse'").groupBy("record_id").agg(F.bool_or(F.lower(F.trim("answer")) == "yes").alias("truth"))
    said = table(spark, sf_dir, "inappropriate_filter_jason").groupBy("record_id").agg(F.bool_or(F.col("toxicity_analysis.is_toxic")).alias("said"))
    return stats.binary_metrics(truth.join(said, "record_id"), "truth", "said")


@query(f"WITH {FEATURES}, b AS (SELECT (doc_id // 100) AS block, count(*) AS n, count(*) FILTER (WHERE {PRESELECT_SQL}) AS k FROM f GROUP BY 1) SELECT block, (sum(n) OVER (ORDER BY block))::BIGINT AS seen, (sum(k) OVER (ORDER BY block))::BIGINT AS kept FROM b")
def win_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.running_totals(featured(spark, sf_dir).select("doc_id", R.preselect().alias("p")), "doc_id", "p")


@query(
    f"""WITH c AS (SELECT record_id, coalesce(source, 'unknown') || date_trunc('day', ingested_at)::VARCHAR AS conv, ingested_at, text FROM refined_commands_filtered),
  w AS (SELECT record_id, array_to_string(list(coalesce(text, '')) OVER (PARTITION BY conv ORDER BY ingested_at, record_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ' ') AS recent FROM c)
  SELECT record_id, md5(recent) AS recent, CASE WHEN {any_part('lower(recent)', ('learn', 'study', 'education', 'teach', 'school'))} THEN -0.1::DOUBLE WHEN {any_part('lower(recent)', ('work', 'business', 'meeting', 'project', 'office'))} THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS adjustment FROM w"""
)
def win_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of a source and day in the order of their arrival as the turns of a conversation."""
    rows = table(spark, sf_dir, "refined_commands_filtered").select(
        "record_id", "text", F.concat(F.coalesce("source", F.lit("unknown")), F.date_trunc("day", "ingested_at").cast("string")).alias("conv"), F.struct("ingested_at", "record_id").alias("turn")
    )
    return stats.conversation_context(rows, "conv", "turn", "text").select("record_id", F.md5("recent").alias("recent"), "adjustment")


@query(f"WITH {QUALITY_CTE} SELECT doc_id, round(overall, 6) AS overall FROM o ORDER BY round(overall, 6) DESC, doc_id LIMIT 100")
def srt_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qualities(spark, sf_dir).select("doc_id", r6(F.col("overall")).alias("overall")).orderBy(F.desc("overall"), "doc_id").limit(100)


@query("SELECT source, count(*) AS records FROM refined_commands_filtered WHERE source IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def srt_top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_counts(table(spark, sf_dir, "refined_commands_filtered"), "source")


# -- sets, joins, splits, sweeps


@query("WITH a AS (SELECT doc_id, md5(coalesce(text, '')) AS k FROM documents), b AS (SELECT md5(coalesce(text, '')) AS k FROM refined_commands_filtered) SELECT doc_id, k IN (SELECT k FROM b) AS hit FROM a")
def jn_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents a cache of the records' hashes would answer."""
    a = docs(spark, sf_dir).select("doc_id", F.md5(T.text_or_empty("text")).alias("k"))
    b = table(spark, sf_dir, "refined_commands_filtered").select(F.md5(T.text_or_empty("text")).alias("k")).distinct().withColumn("hit", F.lit(True))
    return a.join(b, "k", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("hit"))


@query(
    """WITH n AS (SELECT greatest(1, count(*) // 1000) AS b FROM documents), r AS (SELECT doc_id, md5(doc_id::VARCHAR) AS h, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % (SELECT b FROM n) AS b FROM documents),
  o AS (SELECT doc_id, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS other FROM r WINDOW w AS (PARTITION BY b ORDER BY h, doc_id)) SELECT doc_id, nullif(other, doc_id) AS negative_id FROM o"""
)
def jn_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples.with_negative(docs(spark, sf_dir), "doc_id")


@query("SELECT doc_id AS id, md5(text) AS text, 1::BIGINT AS label FROM documents UNION ALL SELECT record_id, md5(text), 0::BIGINT FROM refined_commands_filtered")
def set_labelled_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.md5("text").alias("text"), F.lit(1).cast("long").alias("label"))
    b = table(spark, sf_dir, "refined_commands_filtered").select(F.col("record_id").alias("id"), F.md5("text").alias("text"), F.lit(0).cast("long").alias("label"))
    return a.unionByName(b)


@query("SELECT doc_id, (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 10) = 0 AS is_test FROM documents")
def set_hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.hash_split(docs(spark, sf_dir), "doc_id").select("doc_id", "is_test")


GRID = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]


@query(f"WITH {FEATURES}, s AS (SELECT round({reward_sql()}, 6) AS s FROM f) SELECT g.threshold::DOUBLE AS threshold, count(*) FILTER (WHERE s >= g.threshold::DOUBLE) AS kept, round(avg(s) FILTER (WHERE s >= g.threshold::DOUBLE), 6) AS mean_score FROM s CROSS JOIN {values([(g,) for g in GRID], 'threshold').replace('AS v(', 'AS g(')} GROUP BY 1")
def udf_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.threshold_sweep(featured(spark, sf_dir).select(r6(S.simple_reward()).alias("s")), "s", GRID)


@query()
def flt_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier of prose against the rest, trained on the hand labels, applied to all records."""
    rows = table(spark, sf_dir, "refined_commands_filtered").select("record_id", "text")
    labels = table(spark, sf_dir, "record_labels").filter("aspect = 'text_kind'").groupBy("record_id").agg(F.max((F.lower(F.trim("answer")) == "prose").cast("int")).alias("label"))
    model = scoring.fit_classifier(rows.join(labels, "record_id"), "text", "label")
    return scoring.classify(model, rows, "text").filter(F.col("p1") >= 0.9).select("record_id", r6(F.col("p1")).alias("p1"))


#: The reference's 0.3 is for sentence vectors. As many documents of sf0.1 reach this TF-IDF cosine as vectors of its embeddings reach 0.3.
NEAR_DESCRIPTION = 0.015
#: The reference's 50 is a neural model's perplexity; a unigram model's lies at a few hundred for common texts.
MOST_PERPLEXITY = 1000.0
ALL_CATEGORIES_SQL = "list_filter([" + ", ".join(f"CASE WHEN {any_part('lower(t)', [w.lower() for w in ws])} THEN '{k}' END" for k, ws in C.KEYWORDS.items()) + "], lambda x: x IS NOT NULL)"
NEAREST_SQL = "near AS (SELECT doc_id, max(struct_pack(s := round(similarity, 9), c := category)) AS b FROM cosines GROUP BY doc_id)"


def nearest_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, similarity, category) of the best description's TF-IDF similarity, in place of a sentence encoder or a zero-shot classifier."""
    found = similarity.tfidf_similarity(docs(spark, sf_dir), "doc_id", "text", DESCRIBED).select("doc_id", F.round("similarity", 9).alias("similarity"), "category")
    return found.groupBy("doc_id").agg(F.max(F.struct("similarity", "category")).alias("b")).select("doc_id", "b.similarity", "b.category")


@query(
    f"""WITH {TFIDF_CTE}, {NEAREST_SQL}, {LM_CTE.removeprefix(FEATURES).lstrip(', ')}, {RUNS_SQL}, a AS (SELECT doc_id, avg(loss) FILTER (WHERE i > 1) AS a FROM x GROUP BY doc_id),
  n1 AS (SELECT fr.*, {ALL_CATEGORIES_SQL} AS native FROM fr),
  c1 AS (SELECT n1.*, round(coalesce(a, 0.0::DOUBLE), 6) AS lp, CASE WHEN len(native) > 0 THEN native WHEN b.s >= {NEAR_DESCRIPTION}::DOUBLE THEN [b.c] ELSE [] END AS categories FROM n1 LEFT JOIN a USING (doc_id) LEFT JOIN near USING (doc_id))
  SELECT doc_id, CASE WHEN n_words NOT BETWEEN 20 AND 1024 THEN 'word_count' WHEN NOT {PASSES_SQL} THEN 'rules' WHEN {READABILITY_SQL} < 0.2::DOUBLE THEN 'readability' WHEN {DIVERSITY_SQL} < 0.2::DOUBLE THEN 'diversity'
    WHEN lp > ln({MOST_PERPLEXITY}::DOUBLE) THEN 'perplexity' WHEN len(categories) = 0 THEN 'category' END AS rejected_at, array_to_string(categories, ',') AS categories FROM c1"""
)
def plan_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six stages; unigram perplexity, and the nearest description as the label where no keyword gives one."""
    lm = scoring.lm_scores(docs(spark, sf_dir), "doc_id", "text").select("doc_id", r6(F.col("avg_score")).alias("lp"))
    near = nearest_description(spark, sf_dir).select("doc_id", F.when(F.col("similarity") >= NEAR_DESCRIPTION, F.array("category")).alias("zero_shot"))
    rows = docs(spark, sf_dir).join(lm, "doc_id").join(near, "doc_id")
    out = pipeline.chain(rows, log_perplexity="lp", most_perplexity=MOST_PERPLEXITY, fallback="zero_shot")
    return out.select("doc_id", "rejected_at", F.array_join("categories", ",").alias("categories"))


def _comprehensive_sql() -> str:
    weights = ", ".join(f"({v}) AS w_{k}" for k, v in _weighted_sql("lower(t)", C.PRESELECT_CATEGORIES).items())
    best = "greatest(" + ", ".join(f"w_{k}" for k in C.TIE_ORDER) + ")"
    category = f"CASE WHEN {best} < 1 THEN 'uncategorized' " + " ".join(f"WHEN w_{k} = {best} THEN '{k}'" for k in C.TIE_ORDER) + " END"
    return f"""WITH {QUALITY_CTE}, {RUNS_SQL}, g AS (SELECT o.*, fr.runs, {weights} FROM o JOIN (SELECT doc_id, runs FROM fr) AS fr USING (doc_id)),
  k AS (SELECT *, {category} AS category FROM g), r AS (SELECT *, CASE WHEN NOT {PRESELECT_SQL} THEN 'preselect' WHEN {POOR_SQL} OR {SPAM_SQL} > 10 THEN 'rules' WHEN overall < {C.domain('general').quality}::DOUBLE THEN 'quality'
    WHEN category = 'uncategorized' THEN 'category' END AS rejected_at FROM k)
  SELECT doc_id, round(overall, 6) AS overall_quality, category, rejected_at, rejected_at IS NULL AS should_include FROM r"""


@query()
def cat_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four categories learnt from the older exports' categories, for every document; the most probable one."""
    names = list(C.TIE_ORDER)
    labels = exports(spark, sf_dir).filter(F.col("category").isin(names)).groupBy("record_id").agg(F.max_by("category", "exported_at").alias("category"))
    index = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("category")) - 1
    rows = table(spark, sf_dir, "refined_commands_filtered").select("record_id", "text").join(labels.select("record_id", index.alias("label")), "record_id")
    model = scoring.fit_classifier(rows, "text", "label")
    return scoring.classify_labels(model, docs(spark, sf_dir), "text", names).select("doc_id", "category", r6(F.col("confidence")).alias("confidence"))


@query(f"WITH {FEATURES}, s AS (SELECT round({reward_sql()}, 6) AS s FROM f) SELECT true AS as_good_as_the_grid, count(*) AS rows FROM s")
def udf_best_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A guided search of the threshold finds a value no worse than a coarse grid's best, less a hundredth."""
    s = cut(featured(spark, sf_dir).select(r6(S.simple_reward()).alias("s")))
    _, found = scoring.best_of(s, "s", 0.0, 1.0)
    kept = F.col("kept") / F.lit(float(max(1, s.count())))
    best = scoring.threshold_sweep(s, "s", GRID).agg(F.max(F.coalesce("mean_score", F.lit(0.0)) * kept).alias("grid"))
    return s.agg(F.count(F.lit(1)).alias("rows")).join(best).select((F.lit(found) >= F.col("grid") - 0.01).alias("as_good_as_the_grid"), "rows")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE len(tokens) > 0) AS valid, count(*) FILTER (WHERE len(tokens) BETWEEN 80 AND 3000) AS kept, round(count(*) FILTER (WHERE len(tokens) BETWEEN 80 AND 3000) * 100.0::DOUBLE / count(*), 6) AS retention FROM climblab_sample")
def flt_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the length filter keeps."""
    return stats.retention(pieces(spark, sf_dir), "n", 80, 3000)


@query(f"WITH {FEATURES}, h AS (SELECT n_chars, {HEURISTIC_SQL} AS score FROM f) SELECT count(*) FILTER (WHERE n_chars < 10) AS too_short, count(*) FILTER (WHERE n_chars >= 10 AND score < 0.3::DOUBLE) AS low_quality, count(*) FILTER (WHERE n_chars >= 10 AND score >= 0.3::DOUBLE) AS selected FROM h")
def agg_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = featured(spark, sf_dir).withColumn("score", S.heuristic_quality())
    short, low = F.col("n_chars") < 10, F.col("score") < 0.3
    return f.agg(F.count_if(short).alias("too_short"), F.count_if(~short & low).alias("low_quality"), F.count_if(~short & ~low).alias("selected"))


@query(
    f"WITH {PIECES}, k AS (SELECT * FROM (VALUES ('unknown'), ('no such cluster')) AS v(cluster_id)), g AS (SELECT cluster_id, count(*) AS n FROM c GROUP BY 1) "
    "SELECT k.cluster_id, coalesce(n, 0)::BIGINT AS records, CASE WHEN n IS NULL THEN 'Cluster ' || chr(39) || k.cluster_id || chr(39) || ' not found' END AS error FROM k LEFT JOIN g USING (cluster_id)"
)
def jn_cluster_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named clusters with their size, or an error row."""
    return stats.looked_up(pieces(spark, sf_dir), "cluster_id", ["unknown", "no such cluster"])


@query(_comprehensive_sql())
def plan_comprehensive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.comprehensive(docs(spark, sf_dir)).select("doc_id", r6(F.col("overall_quality")).alias("overall_quality"), "category", "rejected_at", "should_include")


def stand_in():
    """A scorer that SQL knows too: the share of distinct words."""

    def score(texts: list[str]) -> list[float]:
        words_ = [t.split() for t in texts]
        return [len(set(w)) / len(w) if w else 0.0 for w in words_]

    return score


STAND_IN_SQL = "CASE WHEN n_words = 0 THEN 0.0::DOUBLE ELSE len(list_distinct(words))::DOUBLE / n_words END"


def _preselect_sql(model: bool) -> str:
    passed = "near_ AND m >= 0.6::DOUBLE" if model else "near_"
    mean = "(quality_score + s + m) / 3" if model else "(quality_score + s) / 2"
    return f"""WITH {TFIDF_CTE}, {NEAREST_SQL}, {ENHANCED_SQL}, v AS (SELECT e.doc_id, e.reason IS NULL AS rule, e.quality_score, e.hints, b.s AS s, b.c AS c, {STAND_IN_SQL} AS m FROM e JOIN near USING (doc_id) JOIN f USING (doc_id)),
  w AS (SELECT *, rule AND s >= {NEAR_DESCRIPTION}::DOUBLE AS near_ FROM v), y AS (SELECT *, {passed} AS passed FROM w)
  SELECT doc_id, passed, round(CASE WHEN passed THEN {mean} WHEN near_ THEN (quality_score + s) / 2 WHEN rule THEN quality_score ELSE 0 END, 6) AS combined_score,
    CASE WHEN near_ THEN concat_ws(',', nullif(hints, ''), c) WHEN rule THEN hints ELSE '' END AS hints FROM y"""


def _preselected(spark: SparkSession, sf_dir: str, model: DataFrame | None) -> DataFrame:
    checks = featured(spark, sf_dir).select("doc_id", R.enhanced_checks().alias("c"))
    rows = checks.select("doc_id", R.enhanced_preselect(F.col("c")).alias("rule")).join(nearest_description(spark, sf_dir), "doc_id")
    rows = rows if model is None else rows.join(model, "doc_id")
    p = pipeline.combined_preselect(F.col("rule"), F.col("similarity"), F.col("category"), NEAR_DESCRIPTION, None if model is None else F.col("score"))
    return rows.select("doc_id", p.alias("p")).select("doc_id", "p.passed", r6(F.col("p.combined_score")).alias("combined_score"), F.array_join("p.hints", ",").alias("hints"))


@query(_preselect_sql(False))
def plan_combined_preselect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, then the best description's TF-IDF similarity in place of a sentence encoder."""
    return _preselected(spark, sf_dir, None)


@query(_preselect_sql(True))
def plan_three_preselect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, then the best description's similarity, then a scorer's confidence; here a stand-in scores."""
    return _preselected(spark, sf_dir, scorers.scores(docs(spark, sf_dir), "doc_id", "text", stand_in).select("doc_id", "score"))


@query(
    f"""WITH {FEATURES}, {RUNS_SQL}, h AS (SELECT *, {POOR_SQL} OR {SPAM_SQL} > 0 AS suspicious FROM fr)
  SELECT doc_id, suspicious AS scored, round(CASE WHEN suspicious THEN {STAND_IN_SQL} ELSE 0 END, 6) AS score FROM h"""
)
def flt_suspicious(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model sees only texts that the rules find suspicious; all others have a score of 0."""
    hits = featured(spark, sf_dir).select("doc_id", "text", R.rule_hits().alias("h"))
    wanted = F.col("h.poor") | (F.col("h.spam") > 0)
    return scorers.scores_where(hits, wanted, "doc_id", "text", stand_in, otherwise=0.0).select("doc_id", "scored", r6(F.col("score")).alias("score"))


def missing_model():
    raise OSError("no such model")


@query(f"WITH {FEATURES} SELECT doc_id, round({STAND_IN_SQL}, 6) AS score, {STAND_IN_SQL} >= 0.6::DOUBLE AS confident, 0.5::DOUBLE AS without_model FROM f")
def flt_confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's confidence as a gate, and the fallback score where the model can't be loaded."""
    rows = scorers.scores(docs(spark, sf_dir), "doc_id", "text", stand_in)
    none = scorers.scores(docs(spark, sf_dir), "doc_id", "text", missing_model).select("doc_id", F.col("score").alias("without_model"))
    return rows.join(none, "doc_id").select("doc_id", r6(F.col("score")).alias("score"), pipeline.confident(F.col("score")).alias("confident"), "without_model")


@query(
    f"WITH e AS (SELECT record_id, lower(trim(category)) AS category, quality_score, filter_passed, category_relevant FROM oldfilteringbig1900cursorcode) "
    "SELECT record_id, CASE WHEN category = 'rag' THEN 'chatrag' ELSE category END AS category, coalesce(filter_passed, false) OR coalesce(category_relevant AND quality_score > 0.2 AND NOT isnan(quality_score), false) AS exported FROM e WHERE category IN ('function_calling', 'reasoning', 'roleplay', 'rag')"
)
def flt_exportable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relevance gate of exports by category, under their names there; a quality that is null, NaN or low doesn't make up for a failed filter."""
    e = exports(spark, sf_dir).filter(F.col("category").isin(*C.TIE_ORDER))
    gate = C.exportable(F.col("filter_passed"), F.col("category_relevant"), F.col("quality_score"))
    return e.select("record_id", C.renamed(F.col("category")).alias("category"), gate.alias("exported"))


@query(
    f"""WITH {FEATURES} SELECT doc_id, md5('Context:' || chr(10) || array_to_string(string_split(t, '. '), chr(10)) || chr(10) || chr(10) || 'User: ' || coalesce(source, '') || chr(10) || 'Assistant:') AS retrieval,
  md5('Grade the response from 1 to 5 and end with [RESULT]: and the number.' || chr(10) || chr(10) || 'Instruction:' || chr(10) || 'Explain.' || chr(10) || chr(10) || 'Response:' || chr(10) || t || chr(10) || chr(10) || 'Reference (score 5):' || chr(10) || 'Clear.' || chr(10) || chr(10) || 'Criteria:' || chr(10) || 'Is it clear?'
    || chr(10) || 'Score 1: no' || chr(10) || 'Score 2: yes') AS judge,
  {strip_sql("array_to_string(string_split(t, chr(10)), ' ')")} AS conversation FROM d"""
)
def prj_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A retrieval prompt, a judge's prompt, and a conversation flattened; each document's lines are the turns."""
    t = T.text_or_empty("text")
    turns = F.transform(F.split(t, "\n"), lambda x: F.struct(x.alias("value")))
    rows = docs(spark, sf_dir).select("doc_id", t.alias("t"), "source", turns.alias("conversations"))
    return T.sample_text(rows, "conversation").select(
        "doc_id",
        F.md5(T.retrieval_prompt(F.split("t", r"\. "), F.col("source"))).alias("retrieval"),
        F.md5(T.judge_prompt(F.col("t"), "Explain.", "Clear.", "Is it clear?", ["no", "yes"])).alias("judge"),
        "conversation",
    )


# -- sinks and streams


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {OLD_SQL} SELECT record_id, CASE WHEN category = 'rag' THEN 'chatrag' ELSE category END AS category, round(quality_score, 6) AS quality_score FROM e WHERE category IS NOT NULL")
def snk_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by category, under its name there, and read again."""
    path = shared_folder(spark, "export")
    rows = exports(spark, sf_dir).filter("category is not null").select("record_id", C.renamed(F.col("category")).alias("category"), "quality_score")
    writers.write_by_category(rows, path)
    return spark.read.schema("record_id long, quality_score double, category string").json(f"{path}/separate").select("record_id", "category", r6(F.col("quality_score")).alias("quality_score"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS text, coalesce(lang, 'und') AS lang, false AS is_bad FROM documents")
def snk_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in shards of contiguous ids and read again: audited, from the folder with a default language."""
    path = shared_folder(spark, "shards")
    writers.write_shards(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path, 4, "doc_id")
    folder = readers.read_folder(spark, path, "doc_id long, text string, lang string", default_metadata={"lang": "und"}).select("doc_id", "lang")
    audited = readers.read_json_lines_audited(spark, path, "doc_id long, text string").select("doc_id", F.md5(T.text_or_empty("text")).alias("text"), "is_bad")
    return audited.join(folder, "doc_id").select("doc_id", "text", "lang", "is_bad")


@query("SELECT count(*) AS lines, count(*) FILTER (WHERE record_id % 3 = 0) AS bad_lines, count(*) FILTER (WHERE record_id % 3 <> 0) AS rows FROM refined_commands_filtered")
def src_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which every third is broken: the audited reader counts them, the lenient one leaves them out."""
    path = shared_folder(spark, "lines")
    whole = F.concat(F.lit('{"record_id": '), F.col("record_id").cast("string"))
    lines = table(spark, sf_dir, "refined_commands_filtered").select(F.when(F.col("record_id") % 3 == 0, whole).otherwise(F.concat(whole, F.lit("}"))).alias("value"))
    lines.write.text(path)
    audit = readers.read_json_lines_audited(spark, path, "record_id long").agg(F.count(F.lit(1)).alias("lines"), F.count_if("is_bad").alias("bad_lines"))
    return audit.join(readers.read_json_lines(spark, path, "record_id long").agg(F.count(F.lit(1)).alias("rows")))


#: What CSV can't hold: line ends, and blanks at the ends.
NOT_IN_CSV = rf"^[{T.WS}]|[{T.WS}]$|[\n\r]"


@query(f"SELECT coalesce(text, '') AS text, 'uncategorized' AS category, 0.0::DOUBLE AS quality_score, '' AS timestamp FROM documents WHERE text IS NULL OR NOT regexp_matches(text, '{NOT_IN_CSV}')")
def snk_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four columns of an export as CSV and back; texts that this format can't hold are left out."""
    path = shared_folder(spark, "csv")
    rows = table(spark, sf_dir, "documents").filter(F.col("text").isNull() | ~F.col("text").rlike(NOT_IN_CSV))
    writers.write_csv(writers.export_rows(rows), path)
    return spark.read.schema("text string, category string, quality_score double, timestamp string").option("header", "true").option("escape", '"').csv(path).fillna("", ["text", "timestamp"])


@query("SELECT sample_id, is_toxic FROM (SELECT sample_id, toxicity_analysis.is_toxic AS is_toxic FROM inappropriate_filter_jason) WHERE is_toxic IS NOT NULL")
def snk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe and toxic verdicts written in one pass, and read from both folders."""
    path = shared_folder(spark, "split")
    rows = table(spark, sf_dir, "inappropriate_filter_jason").select("sample_id", F.col("toxicity_analysis.is_toxic").alias("is_toxic")).filter("is_toxic is not null")
    writers.write_split(rows, "is_toxic", path)
    return spark.read.schema("sample_id long, is_toxic boolean").json(path)


@query("SELECT 'first' AS run, count(*) AS rows, 0.3::DOUBLE AS threshold FROM documents")
def snk_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's folder: rows and one row of metadata."""
    path = shared_folder(spark, "runs")
    writers.write_run(docs(spark, sf_dir).select("doc_id"), path, "first", threshold=0.3)
    return spark.read.schema("run string, rows long, threshold double").json(f"{path}/first/metadata")


@query("SELECT sample_id, piece_no, CASE WHEN len(tokens) > 0 THEN md5(array_to_string(tokens, ' ')) END AS text, CASE WHEN len(tokens) > 0 THEN len(tokens)::BIGINT END AS token_count FROM climblab_sample")
def snk_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "climblab_sample")
    return writers.training_records(rows, keep=("sample_id", "piece_no")).select("sample_id", "piece_no", F.md5("text").alias("text"), "token_count")


@query("SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings")
def snk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "vectors")
    writers.write_vectors(vectors(spark, sf_dir).select("id", "vector"), path)
    total = F.aggregate(F.transform("vector", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(path).select("id", F.round(total, 5).alias("total"))


@query(f"WITH {PIECES}, k AS (SELECT cluster_id FROM c GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT sample_id, piece_no, n::BIGINT AS n FROM c WHERE cluster_id = (SELECT cluster_id FROM k) AND n BETWEEN 80 AND 3000")
def snk_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest cluster, within token limits, written and read again."""
    path = shared_folder(spark, "cluster")
    rows = pieces(spark, sf_dir).withColumn("cluster_id", F.coalesce("cluster_id", F.lit("unknown")))
    largest = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("records")).orderBy(F.desc("records"), "cluster_id").first()
    writers.write_group(rows, path, "cluster_id", largest[0] if largest else "", "n", least=80, most=3000)
    return spark.read.schema("sample_id long, piece_no int, n long").json(path)


@query("WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS records FROM events GROUP BY ALL) SELECT * FROM w WHERE start + INTERVAL 3 HOUR <= (SELECT max(ts) FROM events)")
def str_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by hour over a stream; a window comes out once the watermark, two hours behind, has passed it."""
    path = f"{sf_dir}/events.parquet"
    s = streams.read_files(spark, path, spark.read.parquet(path).schema).withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.run_available(streams.windowed_counts(s, "ts", "event_type"))


@query(f"WITH {FEATURES} SELECT count(DISTINCT sha256({normal_sql('t')})) AS distinct_texts FROM d")
def str_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    s = streams.read_files(spark, path, spark.read.parquet(path).schema).select("doc_id", "text")
    return streams.run_available(streams.distinct_texts(s)).agg(F.count_distinct("sha").alias("distinct_texts"))


@query("SELECT coalesce(source, 'unknown') AS source, count(*) AS records, sum(n_chars)::BIGINT AS total FROM documents GROUP BY 1")
def str_running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    s = streams.read_files(spark, path, spark.read.parquet(path).schema)
    return streams.run_available(streams.running_counts(s, "source", "n_chars"), mode="complete")


@query(f"WITH {FEATURES} SELECT doc_id, round({reward_sql()}, 6) AS reward FROM f WHERE {reward_sql()} >= 0.5::DOUBLE")
def str_rewarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    s = streams.read_files(spark, path, spark.read.parquet(path).schema)
    return streams.run_available(streams.rewarded(s, least=0.5).select("doc_id", "reward")).select("doc_id", r6(F.col("reward")).alias("reward"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS records FROM events GROUP BY ALL")
def agg_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("records")).select(F.col("w.start").alias("start"), "event_type", "records")


@query()
def str_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies dropped as files arrive."""
    path = f"{sf_dir}/documents.parquet"
    s = streams.read_files(spark, path, spark.read.parquet(path).schema).select("doc_id", "text")
    return streams.drop_near_copies(s, "doc_id", "text", f"{ensure_checkpoint_dir(spark)}/near-{uuid.uuid4().hex}").select("doc_id")
