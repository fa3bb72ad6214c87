"""Commit history: the text of a log with per-file counts, parsed with built-in expressions; history rows of the chunk table."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import display
from strataloom.functions.text import iso_date, leading_int

SEP = "\x1e"
MARK = f"{SEP}COMMIT{SEP}"


def log_text(c: DataFrame) -> Column:
    """The log record of a commit row, as ``git log --numstat`` prints it; null counts as for binary files."""
    count = lambda n: F.coalesce(n.cast("string"), F.lit("-"))
    lines = F.transform("files", lambda f: F.concat_ws("\t", count(f["insertions"]), count(f["deletions"]), f["path"]))
    head = F.concat(F.lit(MARK), F.col("short_hash"), F.lit(SEP), F.col("author"), F.lit(SEP), F.coalesce("date", F.lit("")))
    return F.concat_ws("\n", head, F.col("message"), F.array_join(lines, "\n"))


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def parse_log(logs: DataFrame, col: str, normalize: bool = True) -> DataFrame:
    """(short_hash, author, date, message, files) of every record in texts of logs.

    The message ends before the first line with a tab; lines of fewer than three fields or without a path are dropped;
    a count that isn't a number is 0; a path may hold tabs. Null and empty logs give no rows.
    """
    records = logs.select(F.explode(F.split(col, MARK)).alias("r")).select(_trim(F.col("r")).alias("r")).where("r <> ''")
    lines = records.select(F.split(F.split_part("r", F.lit("\n"), F.lit(1)), SEP).alias("h"), F.slice(F.split("r", "\n"), 2, 1_000_000).alias("l"))
    first = F.array_position(F.transform("l", lambda x: x.contains("\t")), True)
    cut = lines.withColumn("n", F.when(first > 0, first - 1).otherwise(F.size("l").cast("bigint")).cast("int"))
    stats = F.filter(F.transform(F.slice("l", F.col("n") + 1, F.greatest(F.size("l") - F.col("n"), F.lit(0))), lambda x: F.split(x, "\t")), lambda p: F.size(p) >= 3)
    rows = F.transform(stats, lambda p: F.struct(F.trim(F.array_join(F.slice(p, 3, F.size(p)), "\t")).alias("path"), leading_int(p[0]).alias("insertions"), leading_int(p[1]).alias("deletions")))
    field = lambda i: F.trim(F.coalesce(F.try_element_at("h", F.lit(i)), F.lit("")))
    date = iso_date(field(3)) if normalize else field(3)
    return cut.select(field(1).alias("short_hash"), field(2).alias("author"), date.alias("date"), _trim(F.array_join(F.slice("l", 1, F.col("n")), "\n")).alias("message"), F.filter(rows, lambda f: f["path"] != "").alias("files"))


def history_rows(commits: DataFrame) -> DataFrame:
    """Commits as rows of the chunk table: id ``git:`` + hash, no file, lines 0."""
    text = display.commit_text(*(F.col(c) for c in ("short_hash", "author", "date", "message", "files")))
    fixed = {"file_path": "", "chunk_type": "commit", "file_type": "source", "source_kind": "history"}
    return commits.select(F.concat(F.lit("git:"), "short_hash").alias("id"), *[F.lit(v).alias(k) for k, v in fixed.items()], F.lit(None).cast("string").alias("scope"), F.col("short_hash").alias("name"), text.alias("content"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"))


def read_git_log(spark: SparkSession, root: str, most: int = 500, timeout: float = 120) -> DataFrame:
    """The last ``most`` commits of a working tree, by ``git log``, a row each; raises RuntimeError with its message if that fails."""
    form = f"{MARK}%h{SEP}%an{SEP}%aI%n%B".replace(SEP, "%x1e")
    got = subprocess.run(["git", "log", f"--format={form}", "--numstat", "-n", str(most), "--"], cwd=root, capture_output=True, text=True, errors="replace", timeout=timeout)
    if got.returncode:
        raise RuntimeError(f"git log failed: {got.stderr.strip()[:500]}")
    records = [(MARK + r,) for r in got.stdout.split(MARK) if r.strip()]
    return parse_log(spark.createDataFrame(records, "log string").repartition(min(len(records) // 50 + 1, 64)), "log")
