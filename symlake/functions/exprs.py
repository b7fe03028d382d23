"""Column expressions that the operators share; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line breaks as Python's str.splitlines has them.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
#: Fixed value: the namespace of URL identifiers (RFC 4122).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
#: A query that one of these matches is looked up exactly.
EXACT_PATTERNS = (
    r"\b[A-Z][A-Za-z0-9]+(?:[A-Z][A-Za-z0-9]+)+\b",
    r"\b[a-z]+(?:_[a-z0-9]+)+\b",
    r"\b[a-z]+(?:[A-Z][a-z0-9]+)+\b",
    r"/[A-Za-z0-9_./{}:-]+",
    r"\b[A-Z_][A-Z0-9_]{2,}\b",
    r"\b[A-Za-z]+Error\b",
    r"\b[A-Za-z]+Exception\b",
    r"\b[A-Za-z0-9_]+\.[A-Za-z0-9_.]+\b",
)
#: Directories that are not indexed.
EXCLUDED_DIRS = (".git", ".venv", "venv", "__pycache__", "node_modules", "dist", "build")


def uuid5(name: Column) -> Column:
    """The version-5 identifier of a name in the URL namespace, as text."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def split_lines(text: Column) -> Column:
    """Lines without their breaks; a break at the end makes no further line, an empty text has none."""
    lines = F.split(text, LINE_BREAK)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def tokens(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def strip(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def looks_exact(query: Column) -> Column:
    """Whether a query looks like an identifier, a path, a constant, an error or a dotted name."""
    out = F.lit(False)
    for p in EXACT_PATTERNS:
        out = out | query.rlike(p)
    return out


def language_of(path: Column) -> Column:
    """python and java by suffix; otherwise the suffix without its dot, or text."""
    suffix = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^.+\.([^.]+)$", 1)
    return F.when(suffix == "py", "python").when(suffix != "", suffix).otherwise("text")


def in_excluded_dir(path: Column) -> Column:
    """Whether any part of a relative path is an excluded directory."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, EXCLUDED_DIRS)))


def unit_type(kind: Column) -> Column:
    return F.when(kind == "class", "class_chunk").when(kind.isin("function", "async_function", "method", "constructor"), "function_chunk").otherwise("symbol_profile")


#: Words in a call's name that tell its kind, and words of settings.
LOG_NAMES = ("debug", "info", "warning", "error", "exception")
METRIC_WORDS, TABLE_WORDS, CONFIG_WORDS = "metric|counter|histogram|gauge", "query|execute|fetch", "config|timeout|retry|backoff|env"


def call_edge_type(name: Column) -> Column:
    """What a call is, by its dotted name: the first of logs, emits_metric, queries_table that fits, or calls."""
    n = F.lower(name)
    return (
        F.when(n.contains("log") | n.isin(*LOG_NAMES), "logs")
        .when(n.rlike(METRIC_WORDS), "emits_metric")
        .when(n.rlike(TABLE_WORDS), "queries_table")
        .otherwise("calls")
    )


def reads_config(name: Column) -> Column:
    return F.lower(name).rlike(CONFIG_WORDS)


def like_contains(text: Column, needle: Column) -> Column:
    """`text LIKE '%needle%'` with wildcards and without an escape character, letters folded."""
    return F.call_function("ilike", text, F.concat(F.lit("%"), F.replace(needle, F.lit("\\"), F.lit("\\\\")), F.lit("%")))


def clip_lines(text: Column, limit: Column | int) -> Column:
    """The first lines of a text."""
    return F.array_join(F.slice(split_lines(text), 1, limit), "\n")
