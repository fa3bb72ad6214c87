"""Tokens, names, paths, dates and numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The separators between query tokens.
TOKEN_SPLIT = r"[\s.,;:!?'\"()\[\]{}/\\]+"
# File name endings that are indexed.
EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".py", ".pyi", ".go", ".rs", ".md", ".txt", ".rst")
# Directories and files that never are.
SKIP_DIRS = ("node_modules", ".git", "dist", "build", ".next", "__pycache__")
SKIP_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock")
# Directories, at the root only, whose changes a watcher ignores.
WATCH_PREFIXES = ("node_modules/", ".git/", "dist/", "build/", ".next/", "__pycache__/")


def query_tokens(q: Column) -> Column:
    """Lower-cased tokens of three characters or more, duplicates kept; null text gives no tokens."""
    return F.filter(F.split(F.lower(F.coalesce(q, F.lit(""))), TOKEN_SPLIT), lambda t: F.length(t) >= 3)


def camel_split(name: Column) -> Column:
    """Words of a camelCase name, lower-cased, of two characters or more."""
    a = F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2")
    b = F.regexp_replace(a, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(b), r"\s+"), lambda t: F.length(t) >= 2)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]+$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def indexable(path: Column) -> Column:
    """Allowed ending, and outside every excluded directory or file; a null path is not indexable."""
    dirs = "|".join(d.replace(".", r"\.") for d in SKIP_DIRS)
    files = "|".join(f.replace(".", r"\.") for f in SKIP_FILES)
    bad = rf"(^|/)({dirs}|[^/]+\.egg-info)/|(^|/)({files})$|\.min\.js$"
    return F.coalesce(extension(path).isin(*EXTENSIONS) & ~path.rlike(bad), F.lit(False))


def watch_worthy(rel_path: Column) -> Column:
    """A changed path (relative to the root) that starts a re-index."""
    skip = F.lit(False)
    for p in WATCH_PREFIXES:
        skip = skip | rel_path.startswith(p)
    return extension(rel_path).isin(*EXTENSIONS) & ~skip


def file_type(path: Column) -> Column:
    """``test`` or ``source``, back slashes read as slashes."""
    p = F.regexp_replace(path, r"\\", "/")
    return F.when(file_name(p).rlike(r"\.(test|spec)\.[tj]sx?$") | p.contains("/__tests__/"), "test").otherwise("source")


def word_count(text: Column) -> Column:
    """Default token counter: words between white space; empty and null count 0."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " "))).cast("int")


def js_round(x: Column) -> Column:
    """Half rounds up, for negative values too."""
    return F.floor(x + F.lit(0.5))


def iso_date(raw: Column) -> Column:
    """ISO-8601 UTC with milliseconds; what can't be read stays as it is."""
    iso = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(raw))
    return F.coalesce(F.date_format(iso, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), raw)


def leading_int(s: Column) -> Column:
    """Integer at the start of a text, else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(s, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("int"), F.lit(0))


def short_count(n: Column) -> Column:
    """Plain below a thousand, else ``12k`` or ``3.4M``."""
    return (
        F.when(n < 1000, n.cast("string"))
        .when(n < 1_000_000, F.concat(js_round(n / 1000.0).cast("string"), F.lit("k")))
        .otherwise(F.concat(F.format_string("%.1f", n / 1e6), F.lit("M")))
    )


def vram_tier(gib: Column) -> Column:
    return F.when(gib.isNull() | (gib < 2), "none").when(gib < 8, "standard").otherwise("large")


def model_base(name: Column) -> Column:
    """Model name before its tag."""
    return F.split_part(name, F.lit(":"), F.lit(1))
