"""Query classes, keyword boost and penalties as Column expressions; they work for a literal query or a query column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataloom.functions.text import file_name, file_stem

# The phrases that decide the retrieval mode of a query.
TRACE = ("trace the", "trace flow", "call path", "flow of", "follows from", "calls into", "invokes", "trace from")
TRACE_RE = r"how does\b.*\bflow\b"
BROAD = ("architecture", "overview", "structure", "system", "design", "pipeline", "codebase")
LOOKUP_PAIRS = ("stack trace", "null pointer", "not defined", "type error", "reference error", "syntax error", "runtime error", "segmentation fault", "not working", "throws exception")
LOOKUP = ("where is", "find the", "definition of", "signature of", "show me the", "what does", "what is the type")
LOOKUP_NOT = ("error handler", "error handling", "error boundary", "error type", "error message", "error code", "error class", "null object", "null check", "null pattern", "undefined behavior", "fix the style", "fix the format", "fix the lint", "fix the config", "fix the setup")
TEST_WORDS = ("coverage", "tested", "how to test", "jest", "vitest", "mock", "__tests__")
# Tool configuration files and the tool that a query has to name to lift their penalty.
CONFIG_FILES = ((r"^vitest\.config\.", "vitest"), (r"^tsup\.config\.", "tsup"), (r"^tsconfig.*\.json$", "tsconfig"), (r"^jest\.config\.", "jest"), (r"^eslint\.config\.", "eslint"), (r"^\.eslintrc", "eslint"))
# Result limit, distance threshold and boost weight of each mode; penalties; floor of a boosted similarity.
MODES = {"lookup": (5, 0.4, 0.40), "trace": (3, 0.5, 0.20), "explore": (20, 0.6, 0.10)}
CONFIG_PENALTY, TEST_PENALTY, HISTORY_PENALTY, BOOSTED, EDGE_SIMILARITY = 0.15, 0.55, 0.07, 0.85, 0.5


def any_of(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def retrieval_mode(query: Column) -> Column:
    q = F.lower(F.coalesce(query, F.lit("")))
    trace = (any_of(q, TRACE) | q.rlike(TRACE_RE)) & ~any_of(q, BROAD)
    return F.when(trace, "trace").when(any_of(q, LOOKUP_PAIRS), "lookup").when(any_of(q, LOOKUP) & ~any_of(q, LOOKUP_NOT), "lookup").otherwise("explore")


def test_intent(query: Column) -> Column:
    q = F.lower(F.coalesce(query, F.lit("")))
    return q.rlike(r"\btests?\b") | q.rlike(r"\bspec\b") | any_of(q, TEST_WORDS)


def test_path(path: Column) -> Column:
    return path.rlike(r"\.(test|spec)\.[jt]sx?$") | path.contains("__tests__/")


def keyword_boost(tokens: Column, path: Column, name: Column) -> Column:
    """1.0 for the exact name, 1.0 if all of its words match, 0.6 for the file stem, else the share of tokens found."""
    fn, stem, nm = F.lower(file_name(path)), F.lower(file_stem(path)), F.lower(F.coalesce(name, F.lit("")))
    words = F.filter(F.split(nm, r"\s+"), lambda s: F.length(s) >= 2)
    all_words = (F.size(words) > 1) & F.forall(words, lambda s: F.exists(tokens, lambda t: t.contains(s) | s.contains(t)))
    hay = F.concat(fn, F.lit(" "), nm)
    share = F.size(F.filter(tokens, lambda t: hay.contains(t))) / F.size(tokens)
    return (
        F.when(F.size(tokens) == 0, 0.0)
        .when((nm != "") & F.array_contains(tokens, nm), 1.0)
        .when(all_words, 1.0)
        .when((stem != "") & F.array_contains(tokens, stem), 0.6)
        .otherwise(share)
    )


def config_penalty(path: Column, query: Column) -> Column:
    fn, q = file_name(path), F.lower(query)
    out = None
    for pattern, tool in CONFIG_FILES:
        hit = F.when(q.contains(tool), 0.0).otherwise(CONFIG_PENALTY)
        out = F.when(fn.rlike(pattern), hit) if out is None else out.when(fn.rlike(pattern), hit)
    return out.otherwise(0.0)


def test_penalty(path: Column, query: Column) -> Column:
    return F.when(~test_intent(query) & test_path(path), TEST_PENALTY).otherwise(0.0)


def history_penalty(source_kind: Column) -> Column:
    return F.when(source_kind == "history", HISTORY_PENALTY).otherwise(0.0)
