"""Watching a source tree: digests of its listing are compared, a burst of changes is awaited, then the index is updated.

A file source of Structured Streaming sees neither edits nor removals, hence listings. The pause is trailing: every change
within it starts it anew. A run that meets another's lock is skipped, and not repeated before the next change.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.text import watch_worthy
from strataloom.operators.incremental import diff
from strataloom.sources.files import list_files

# Fixed value: seconds without a change that end a burst.
QUIET_SECONDS = 0.5
_COUNTS = r"(\d+ new, \d+ changed, \d+ removed)"


def summary(log: Column, elapsed: Column) -> Column:
    """One line on a run from its log: with the counts if the log has them."""
    counts = F.regexp_extract(log, _COUNTS, 1)
    return F.concat(F.lit("re-indexed "), F.when(log.contains("incremental index --") & (counts != ""), F.concat(F.lit("("), counts, F.lit(") "))).otherwise(""), F.lit("in "), elapsed, F.lit("s"))


def stamps(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256) of what is watched; size and time stand in for the hash."""
    files = list_files(spark, root).where(watch_worthy(F.col("rel")))
    return files.select("path", F.concat_ws(":", F.col("size"), F.col("mtime_ms")).alias("sha256"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status) of new, changed and removed files."""
    return diff(after, before).where("status <> 'unchanged'").select("path", "status")


def digest(spark: SparkSession, root: str) -> tuple:
    """One row on the whole listing: it differs when a file is added, removed or changed."""
    return tuple(stamps(spark, root).agg(F.count("*"), F.sum(F.xxhash64("path", "sha256").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("sha256", "path"))).first())


def watch(spark: SparkSession, root: str, reindex: Callable[[], dict], say: Callable[[str], None] = print, every: float = 1.0, quiet: float = QUIET_SECONDS, rounds: int | None = None, listing: Callable[[], object] | None = None) -> int:
    """Polls until interrupted (or for ``rounds`` listings) and calls ``reindex`` after each burst; gives the number of runs."""
    take = listing or (lambda: digest(spark, root))
    seen, runs, n = take(), 0, 0
    changed_at = None
    while rounds is None or n < rounds:
        time.sleep(quiet if changed_at else every)
        n += 1
        now = take()
        if now != seen:
            seen, changed_at = now, time.monotonic()
        elif changed_at is not None and time.monotonic() - changed_at >= quiet:
            changed_at, began = None, time.time()
            try:
                s = reindex()
                runs += 1
                say(f"re-indexed ({s.get('new', 0)} new, {s.get('changed', 0)} changed, {s.get('removed', 0)} removed) in {time.time() - began:.1f}s")
            except RuntimeError as e:
                say(f"skipped: {e}")
    return runs
