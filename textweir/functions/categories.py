"""Categories of a text by keyword tables and weighted patterns, as Columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from textweir.functions.text import WS, contains_any, count_substring

KeywordTable = Mapping[str, Sequence[str]]

# Keywords by category.
KEYWORDS: dict[str, tuple[str, ...]] = {
    "roleplay": (
        "User:", "Assistant:", "System:", "Bot:", "AI:", "Human:", "Customer:", "Agent:", "Doctor:", "Patient:", "Teacher:", "Student:",
        "Roleplay", "Let's pretend", "Imagine you are", "As your assistant", "In this scenario", "Dialogue", "Conversation", "Chat between", "Role play",
    ),
    "function_calling": (
        "call function", "execute", "run", "invoke", "API", "endpoint", "parameters", "arguments", "return value", "output", "input", "function(",
        "def ", "result:", "response:", "request:", "method:", "command:", "perform", "trigger", "action:", "process:", "handler", "callback",
        "script", "programmatically", "automatically",
    ),
    "reasoning": (
        "reasoning", "think", "plan", "strategy", "solve", "solution", "problem", "step by step", "let's think", "let's reason", "analyze", "deduce",
        "infer", "logic", "sequence", "if...then", "because", "therefore", "conclude", "hypothesis", "explain", "why", "how", "decision", "evaluate",
        "consider", "goal", "objective", "task", "approach", "method", "procedure", "process", "multi-step", "chain of thought", "reflection",
        "planning", "robot", "navigate", "path", "trajectory", "execute", "manipulate", "autonomous", "control",
    ),
    "rag": (
        "retrieve", "retrieved", "search", "knowledge base", "database", "document", "according to", "as found in", "reference", "cited", "source:",
        "from the web", "external information", "lookup", "fetch", "context", "evidence", "passage", "snippet", "article", "wikipedia",
        "encyclopedia", "as mentioned in", "see also", "citing", "retrieval", "RAG", "grounded in", "supporting document", "provided context",
        "knowledge retrieval", "search result", "knowledge graph", "fact", "quote from", "as stated in",
    ),
}
# Phrases of the ordered first-match table.
FIRST_MATCH: dict[str, tuple[str, ...]] = {
    "roleplay": ("conversation between", "role-playing", "character responds", "in this scenario", "acting as"),
    "reasoning": ("step by step", "let's analyze", "first we need to", "the solution is", "here's how"),
    "function_calling": ("function", "api call", "command", "def ", "return"),
    "rag": ("according to", "research shows", "studies indicate", "evidence suggests", "source:"),
}
# Patterns of the weighted best category.
PRESELECT_CATEGORIES: dict[str, tuple[str, ...]] = {
    "function_calling": (
        "function", "def ", "return", "import", "class", "method", "parameter", "argument",
        "api call", "endpoint", "request", "response", "json", "post", "get", "put", "delete",
        "command", "execute", "run", "script", "code", "program", "library", "module",
        "variable", "array", "object", "string", "integer", "boolean", "null", "undefined",
        "if ", "else", "elif", "for ", "while", "try", "except", "catch", "finally",
        "print(", "console.log", "println", "cout", "printf", "echo",
        "python", "javascript", "java", "cpp", "c++", "html", "css", "sql", "php", "ruby",
    ),
    "reasoning": (
        "step by step", "first", "second", "third", "finally", "therefore", "because",
        "analyze", "analysis", "reasoning", "logic", "logical", "conclusion", "deduce",
        "problem solving", "solve", "solution", "approach", "method", "strategy",
        "evidence", "proof", "demonstrate", "explanation", "explain", "understand",
        "cause", "effect", "result", "consequence", "implication", "inference",
        "hypothesis", "theory", "principle", "rule", "pattern", "relationship",
        "compare", "contrast", "difference", "similarity", "evaluation", "assessment",
        "lets think", "let's analyze", "consider", "examine", "investigate", "explore",
    ),
    "roleplay": (
        "character", "role", "persona", "acting as", "pretend", "imagine", "scenario",
        "conversation", "dialogue", "chat", "talk", "speak", "say", "respond", "reply",
        "you are", "i am", "he is", "she is", "they are", "we are",
        "roleplay", "role-play", "role playing", "simulate", "simulation",
        "story", "narrative", "plot", "scene", "setting", "background",
        "interaction", "communicate", "express", "feel", "emotion", "reaction",
        "adventure", "journey", "quest", "mission", "task", "challenge",
        "world", "universe", "realm", "environment", "place", "location",
    ),
    "rag": (
        "according to", "research shows", "studies indicate", "evidence suggests",
        "source", "reference", "citation", "document", "paper", "article", "report",
        "data shows", "findings", "results", "statistics", "survey", "poll",
        "expert", "authority", "specialist", "researcher", "scientist", "scholar",
        "published", "journal", "book", "database", "repository", "archive",
        "information", "knowledge", "fact", "detail", "background", "context",
        "retrieve", "search", "find", "locate", "discover", "identify",
        "based on", "derived from", "extracted from", "obtained from",
        "wikipedia", "encyclopedia", "documentation", "manual", "guide",
    ),
}
# Thresholds by domain (toxicity, safety, quality).
DOMAINS = {"educational": (0.8, 0.7, 0.5), "children": (0.3, 0.9, 0.6), "medical": (0.85, 0.6, 0.5), "general": (0.7, 0.8, 0.4)}
RENAMED = {"rag": "chatrag"}
TIE_ORDER = ("function_calling", "reasoning", "roleplay", "rag")


def all_matching(lower: Column, table: KeywordTable = KEYWORDS) -> Column:
    """Every category one of whose keywords is part of the lower-cased text."""
    return F.array_compact(F.array(*[F.when(contains_any(lower, [w.lower() for w in ws]), F.lit(k)) for k, ws in table.items()]))


def first_matching(lower: Column, table: KeywordTable = FIRST_MATCH) -> Column:
    out = F.lit("uncategorized")
    for k, ws in reversed(table.items()):
        out = F.when(contains_any(lower, ws), k).otherwise(out)
    return out


def _weights(ws: Sequence[str]) -> dict[str, int]:
    return {w.lower(): len(w.split()) for w in dict.fromkeys(ws)}


def weighted_scores(lower: Column, table: KeywordTable) -> dict[str, Column]:
    """Summed word counts of the distinct keywords present, by category."""
    return {k: sum((F.when(lower.contains(w), n).otherwise(0) for w, n in _weights(ws).items()), F.lit(0)).cast("long") for k, ws in table.items()}


def best_weighted(lower: Column, table: KeywordTable = PRESELECT_CATEGORIES, order: Sequence[str] = TIE_ORDER, least: int = 1) -> Column:
    """The category with the highest weighted score, ties in ``order``; any table of keywords will do."""
    scores = weighted_scores(lower, table)
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    out = F.when(best < least, F.lit("uncategorized"))
    for k in order:
        out = out.when(scores[k] == best, k)
    return out


def occurrence_score(lower: Column, ws: Sequence[str]) -> Column:
    """Occurrences of each keyword times its number of words, summed."""
    return sum((count_substring(lower, w) * n for w, n in _weights(ws).items()), F.lit(0)).cast("long")


def renamed(category: Column, names: Mapping[str, str] = RENAMED) -> Column:
    out = category
    for a, b in names.items():
        out = F.when(category == a, b).otherwise(out)
    return out


@dataclass(frozen=True)
class Domain:
    toxicity: float
    safety: float
    quality: float


def domain(name: str) -> Domain:
    """The thresholds of a domain; those of ``general`` where it isn't known."""
    return Domain(*DOMAINS.get(name, DOMAINS["general"]))


def exportable(passed: Column, relevant: Column, quality: Column, least: float = 0.2) -> Column:
    """Whether a record goes into its category's export: it passed all filters, or is relevant with a quality over ``least``."""
    return F.coalesce(passed, F.lit(False)) | F.coalesce(relevant & (quality > least), F.lit(False))


@dataclass(frozen=True)
class Strictness:
    acceptance: float
    least_length: int
    least_ratio: float


STRICTNESS = {"strict": Strictness(15, 30, 0.1), "moderate": Strictness(8, 20, 0.05), "lenient": Strictness(5, 15, 0.02)}

# Command patterns: group, description, weight, pattern.
COMMANDS = (
    ("actions", "Direct device control commands", 50, r"^\s*(?:please\s+)?(?:turn on|turn off|switch on|switch off|toggle|turn)\s+(?:the\s+)?(?:lights?|lamp|tv|music|radio|system)"),
    ("actions", "Smart home adjustment commands", 45, r"^\s*(?:please\s+)?(?:dim|brighten|adjust|set|change)\s+(?:the\s+)?(?:lights?|brightness|volume|temperature|thermostat)"),
    ("actions", "Media control commands", 45, r"^\s*(?:please\s+)?(?:play|pause|stop|skip|resume)\s+(?:the\s+)?(?:music|song|video|podcast|movie|playlist)"),
    ("actions", "Communication commands", 50, r"^\s*(?:please\s+)?(?:send|text|call|email)\s+(?:a\s+)?(?:message|text|email)\s+to\s+\w+"),
    ("actions", "Scheduling commands", 50, r"^\s*(?:please\s+)?(?:set|create|add|schedule)\s+(?:a\s+)?(?:reminder|alarm|timer|appointment|meeting)\s+(?:for|at)"),
    ("actions", "Information request commands", 40, r"^\s*(?:please\s+)?(?:check|get|find|look up|search for|tell me)\s+(?:the\s+)?(?:weather|time|news|traffic|forecast)"),
    ("actions", "Shopping and ordering commands", 45, r"^\s*(?:please\s+)?(?:order|buy|purchase)\s+(?:some\s+|a\s+)?(?:food|groceries|pizza|coffee|lunch|dinner)"),
    ("actions", "Navigation commands", 45, r"^\s*(?:please\s+)?(?:navigate to|drive to|directions to|take me to|find route to)\s+"),
    ("actions", "Voice assistant commands", 60, r"\b(?:hey|ok|okay)\s+(?:google|alexa|siri|assistant),?\s+(?:turn|set|play|call|send|order|check|find)"),
    ("devices", "Lighting device commands", 35, r"\b(?:turn|set|dim|brighten|adjust|change)\s+(?:the\s+)?(?:lights?|lamp|bulbs?)"),
    ("devices", "Climate control commands", 35, r"\b(?:set|adjust|turn|change)\s+(?:the\s+)?(?:thermostat|temperature|heater|ac|air conditioning)"),
    ("devices", "Media device commands", 30, r"\b(?:turn|play|stop|pause|change)\s+(?:the\s+)?(?:tv|television|music|speaker|radio)"),
    ("time", "Specific scheduled times", 30, r"\b(?:at|for)\s+(?:\d{1,2}:\d{2}\s*(?:am|pm)?|\d{1,2}\s*(?:am|pm|o'?clock))"),
    ("time", "Time-based scheduling commands", 40, r"\b(?:set|schedule|remind me|wake me up)\s+.*?\b(?:at|for|in)\s+(?:\d+\s*(?:minutes?|hours?)|tomorrow|tonight)"),
    ("time", "Timer setting commands", 45, r"\b(?:set|start)\s+(?:a\s+)?timer\s+(?:for\s+)?\d+\s*(?:minutes?|hours?)"),
    ("location", "Room-specific commands", 40, r"\b(?:turn on|dim|play music|set temperature)\s+.*?\bin the\s+(?:living room|bedroom|kitchen|bathroom)"),
    ("location", "Navigation location commands", 35, r"\b(?:navigate to|drive to|directions to|take me to)\s+(?:the\s+)?(?:store|restaurant|home|work|office)"),
    ("services", "Music service commands", 40, r"\b(?:play|stop|pause)\s+.*?\bon\s+(?:spotify|apple music|youtube|pandora)"),
    ("services", "Communication app commands", 40, r"\b(?:send|call|message)\s+.*?\b(?:on|via|through)\s+(?:whatsapp|slack|skype|zoom)"),
    ("services", "Food delivery commands", 40, r"\b(?:order|get)\s+.*?\b(?:from|on|via)\s+(?:uber eats|doordash|grubhub)"),
    ("imperatives", "Direct imperative commands", 50, r"^\s*(?:please\s+)?(?:turn|set|play|stop|start|open|close|send|call|order|check|find|show|tell|dim|brighten)\s+(?:the\s+|a\s+|my\s+)?(?:lights?|music|tv|alarm|reminder|volume|temperature)"),
    ("imperatives", "Polite command requests", 45, r"\b(?:can you|could you|would you please)\s+(?:turn|set|play|send|order|check|find)"),
    ("imperatives", "Want/need action patterns", 35, r"\b(?:I want to|I need to|I'd like to)\s+(?:turn|set|play|send|order|check|book|schedule)"),
    ("imperatives", "Command with object and action", 45, r"\b(?:turn|set|adjust|change)\s+(?:the\s+)?(?:lights?|volume|temperature|thermostat)\s+(?:to|on|off|up|down)"),
)
GROUPS = ("actions", "devices", "time", "location", "services", "imperatives")


def command_pattern(pattern: str) -> str:
    """A command pattern with Unicode white space; letter case ignored."""
    return "(?i)" + pattern.replace(r"\s", f"[{WS}]")


def command_counts(c: Column) -> Column:
    """How often each command pattern occurs, in the order of ``COMMANDS``; compute once, then score."""
    return F.array(*[F.regexp_count(c, F.lit("(?d)" + command_pattern(p))).cast("long") for *_, p in COMMANDS])


def command_scores(counts: Column, n_chars: Column, strictness: Strictness = STRICTNESS["moderate"]) -> Column:
    """(score, keep, reason code, detected patterns, score by group) from ``command_counts``."""
    by = {g: sum((counts[i] * w for i, (k, _, w, _) in enumerate(COMMANDS) if k == g), F.lit(0)) for g in GROUPS}
    raw = sum(by.values(), F.lit(0))
    score = F.when(n_chars > 0, F.least(F.lit(100.0), raw / (n_chars / F.lit(1000.0)))).otherwise(0.0)
    kinds = sum((F.when(v > 0, 1).otherwise(0) for v in by.values()), F.lit(0))
    patterns = F.size(F.filter(counts, lambda x: x > 0))
    matches = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    reason = (
        F.when(score >= strictness.acceptance, "score")
        .when(by["imperatives"] > 25, "imperative")
        .when((by["actions"] > 10) & (by["devices"] > 10), "action_device")
        .when((by["actions"] > 10) & (by["time"] > 15), "action_time")
        .when((kinds >= 2) & (patterns >= 2), "several_types")
        .when((by["services"] > 15) & (by["actions"] > 10), "service_action")
        .when((n_chars > 0) & (matches / (n_chars / F.lit(100.0)) >= strictness.least_ratio), "ratio")
        .otherwise("insufficient")
    )
    named = F.array(*[F.struct(F.lit(d).alias("k"), counts[i].alias("v")) for i, (_, d, _, _) in enumerate(COMMANDS)])
    return F.struct(
        score.alias("score"),
        (reason != "insufficient").alias("keep"),
        reason.alias("reason"),
        F.map_from_entries(F.filter(named, lambda e: e["v"] > 0)).alias("patterns"),
        F.struct(*[v.cast("long").alias(g) for g, v in by.items()]).alias("groups"),
    )
