"""What a caller of the index uses: search and context with their savings, running totals of a session, and indexing on demand."""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom import index as I
from strataloom.functions import text as X
from strataloom.operators import context, embed

# Fixed value: hours after which the totals of a session start anew.
TTL_HOURS = 2.0
_SECRET = re.compile(r"(?i)((?:api[_-]?key|token|password|secret|authorization)[\"']?\s*[=:]\s*[\"']?)[^\s\"',}]+")


def index_of(root: str) -> str:
    return os.path.join(os.path.abspath(root), ".strataloom")


def read_stats(path: str, ttl_hours: float = TTL_HOURS) -> dict | None:
    """The running totals; None if there are none, they can't be read, hold no time or no estimate, or are older than ``ttl_hours``."""
    try:
        with open(path, encoding="utf-8") as f:
            s = json.load(f)
        age = time.time() - datetime.fromisoformat(s["lastUpdatedAt"]).timestamp()
        return s if age <= ttl_hours * 3600 and s["estimatedWithout"] > 0 else None
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        return None


def accumulate(path: str, sent: int, estimated: int, ttl_hours: float = TTL_HOURS) -> dict:
    """Adds a call to the running totals, which start anew after a pause of more than ``ttl_hours``; written by an atomic rename."""
    try:
        with open(path, encoding="utf-8") as f:
            was = json.load(f)
        expired = time.time() - datetime.fromisoformat(was["lastUpdatedAt"]).timestamp() > ttl_hours * 3600
        base = {k: 0 if expired else was[k] for k in ("tokensSent", "estimatedWithout", "callCount")}
    except (OSError, ValueError, KeyError, TypeError):
        base = {"tokensSent": 0, "estimatedWithout": 0, "callCount": 0}
    now = {"tokensSent": base["tokensSent"] + sent, "estimatedWithout": base["estimatedWithout"] + estimated, "callCount": base["callCount"] + 1}
    now |= {"lastUpdatedAt": datetime.now(timezone.utc).isoformat(), "lastTokensSent": sent, "lastEstimatedWithout": estimated}
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump(now, f, indent=2)
    os.replace(path + ".tmp", path)
    return now


def with_index(spark: SparkSession, root: str, call: Callable[[], dict], **options) -> dict:
    """``call``; if there is no index, it is built and the call made once more. What fails comes back as ``error``."""
    try:
        try:
            return call()
        except I.NoIndexError:
            I.build_index(spark, root, index_of(root), **options)
            return call()
    except Exception as e:  # noqa: BLE001 - the caller gets every failure as a result
        return {"error": redact_log(str(e).partition("\n")[0])}


def redact_log(text: str) -> str:
    """A line of a log without the values of keys, tokens and passwords."""
    return _SECRET.sub(r"\1[redacted]", text)


def file_counts(spark: SparkSession, index: str, root: str) -> DataFrame:
    """The manifest with token counts; a missing one is counted from the file, in the tasks."""
    stored = I.load(spark, index, "manifest")
    lacking = stored.where(F.col("token_count").isNull()).select("path")
    read = I.files.read_files(spark, root, lacking).select("path", F.col("token_count").alias("counted"))
    return stored.join(read, "path", "left").withColumn("token_count", F.coalesce("token_count", "counted")).drop("counted")


def search(spark: SparkSession, root: str, query: str, embedder: embed.Embedder | None = None, limit: int = 10, threshold: float | None = None) -> dict:
    """Ranked hits with what they cost and saved; adds the call to the session's totals. Indexes first if need be."""

    def call() -> dict:
        index = index_of(root)
        hits = I.find(spark, index, query, embedder, limit, threshold)
        score = "similarity" if "similarity" in hits.columns else "score"
        rows = hits.withColumn("tokens", X.word_count(F.col("content"))).select("id", "file_path", "name", "chunk_type", "start_line", "end_line", F.col(score).alias("score"), "tokens", "rank").orderBy("rank").collect()  # bounded by the limit
        sent = sum(r["tokens"] for r in rows)
        base = context.reading_baseline(I.load(spark, index, "chunks").select("file_path", "name"), file_counts(spark, index, root), query, "max").first()["base_tokens"]
        pct, mode = spark.range(1).select(context.reduction(F.lit(sent), F.lit(base)), context.savings_mode(F.lit(sent), F.lit(base))).first()
        accumulate(os.path.join(index, "session-stats.json"), sent, base)
        return {"hits": [r.asDict() for r in rows], "tokensSent": sent, "estimatedWithout": base, "reductionPct": pct, "mode": mode}

    return with_index(spark, root, call)


def build_context(spark: SparkSession, root: str, query: str, embedder: embed.Embedder, max_tokens: int = 4096) -> dict:
    """A context with its savings, added to the session's totals. Indexes first if need be."""

    def call() -> dict:
        out = I.build_context(spark, index_of(root), query, embedder, max_tokens)
        accumulate(os.path.join(index_of(root), "session-stats.json"), out["tokensSent"], out["estimatedWithout"])
        return out

    return with_index(spark, root, call)


def status_line(path: str, idle: str, form: str, last: str, short: Callable[[int], str]) -> str:
    """One line on the session's savings; ``idle`` without valid totals or savings. ``form`` takes saved tokens and percentage, ``last`` the last call's."""
    s = read_stats(path)
    if not s:
        return idle
    saved = s["estimatedWithout"] - s["tokensSent"]
    pct = min(context.MAX_PCT, int((1 - s["tokensSent"] / s["estimatedWithout"]) * 100 + 0.5))
    if saved <= 0 or pct <= 0:
        return idle
    more = s.get("lastEstimatedWithout", 0) - s.get("lastTokensSent", 0)
    return form.format(short(saved), pct) + (last.format(short(more)) if more > 0 else "")


def format_hits(out: dict) -> str:
    """Hits as lines of text, with the savings below."""
    if "error" in out:
        return f"error: {out['error']}"
    lines = [f"{r['rank']}. {r['name'] or '(anonymous)'} ({r['chunk_type']})  {r['file_path']}:{r['start_line']}-{r['end_line']}  {r['score']:.3f}" for r in out["hits"]]
    return "\n".join([*(lines or ["no hits"]), "", f"tokens sent {out['tokensSent']}, without an index {out['estimatedWithout']} ({out['reductionPct']} % less)"])
