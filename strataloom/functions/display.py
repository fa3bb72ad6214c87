"""Texts shown to a caller: chunk blocks, provenance, commit text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands between blocks of a context, and before its history.
SEPARATOR = "\n\n---\n\n"
HISTORY_HEAD = "\n\n## Git History\n\n"


def chunk_block(path: Column, start: Column, end: Column, content: Column) -> Column:
    return F.concat(F.lit("// File: "), path, F.lit(" (lines "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(")\n"), content)


def display_name(name: Column) -> Column:
    return F.coalesce(name, F.lit("(anonymous)"))


def provenance(source_kind: Column, path: Column) -> Column:
    return F.when(source_kind == "history", "[history]").otherwise(path)


def commit_text(short_hash: Column, author: Column, date: Column, message: Column, files: Column) -> Column:
    """The text of a commit; null counts show as 0, null date and author as empty, an empty message as a stand-in."""
    n = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    lines = F.transform(files, lambda f: F.concat(F.lit("- "), f["path"], F.lit(" (+"), n(f["insertions"]), F.lit("/-"), n(f["deletions"]), F.lit(")")))
    lines = F.when(F.coalesce(F.size(files), F.lit(0)) > 0, lines).otherwise(F.array(F.lit("- (no touched files)")))
    said = F.when(F.coalesce(F.trim(message), F.lit("")) == "", F.lit("(no commit message)")).otherwise(message)
    head = [F.concat(F.lit("Commit: "), short_hash), F.concat(F.lit("Author: "), F.coalesce(author, F.lit(""))), F.concat(F.lit("Date: "), F.coalesce(date, F.lit(""))), F.lit(""), said, F.lit(""), F.lit("Touched files:")]
    return F.concat_ws("\n", F.concat(F.array(*head), lines))
