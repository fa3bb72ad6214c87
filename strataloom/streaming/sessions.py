"""Session totals with an idle limit, and bursts of events; batch forms, and streaming forms with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


PART_SECONDS = 86_400  # of a key's time that one task orders


def sessionize(rows: DataFrame, key: str, ts: str, gap_seconds: int, *tie: str) -> DataFrame:
    """Numbers the sessions of each key from 1; a new one starts if the pause is longer than the limit (equal stays).

    Rows without a time are left out; a null key is a key of its own. The order within one time is by ``tie``.
    A key's rows are ordered a day at a time, so that a key of any size is spread; the days' first and last times and counts are
    then put in order, and each day's numbers are moved on by the sessions before it.
    """
    limit, at = gap_seconds * 1_000_000, F.unix_micros(F.col(ts))
    part = rows.where(F.col(ts).isNotNull()).withColumn("__part", F.floor(at / (PART_SECONDS * 1_000_000)))
    w = Window.partitionBy(key, "__part").orderBy(ts, *tie)
    local = part.withColumn("__start", F.coalesce((at - F.lag(at).over(w) > limit).cast("int"), F.lit(0))).withColumn("__n", F.sum("__start").over(w))
    parts = local.groupBy(F.col(key).alias("__key"), "__part").agg(F.min(at).alias("__first"), F.max(at).alias("__last"), F.sum("__start").alias("__starts"))
    order = Window.partitionBy("__key").orderBy("__part")
    begins = F.coalesce((F.col("__first") - F.lag("__last").over(order) > limit).cast("int"), F.lit(1))
    moved = parts.withColumn("__begins", begins).select("__key", "__part", (F.sum("__begins").over(order) + F.sum("__starts").over(order) - F.col("__starts")).alias("__before"))
    return local.join(moved.withColumnRenamed("__part", "__p"), F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__p"))).withColumn("session_no", F.col("__n") + F.col("__before")).select(*rows.columns, "session_no")


def session_totals(rows: DataFrame, key: str, ts: str, gap_seconds: int, sent: str, estimated: str, *tie: str) -> DataFrame:
    """Totals, count and last values of each session."""
    s = sessionize(rows, key, ts, gap_seconds, *tie)
    last = F.max(F.struct(F.col(ts), *[F.col(t) for t in tie], F.coalesce(sent, F.lit(0)).alias("__s"), F.coalesce(estimated, F.lit(0)).alias("__e")))
    out = s.groupBy(key, "session_no").agg(F.sum(F.coalesce(sent, F.lit(0))).alias("tokens_sent"), F.sum(F.coalesce(estimated, F.lit(0))).alias("tokens_estimated"), F.count("*").alias("calls"), F.max(ts).alias("last_at"), last.alias("__l"))
    return out.select("*", F.col("__l.__s").alias("last_sent"), F.col("__l.__e").alias("last_estimated")).drop("__l")


def bursts(rows: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Trailing debounce: one row per burst, which ends ``gap_seconds`` after its last event.

    ``session_window`` sorts and merges per key with partial aggregation before the shuffle.
    """
    w = F.session_window(F.col(ts), f"{gap_seconds} seconds")
    return rows.groupBy(key, w.alias("w")).agg(F.count("*").alias("n_events"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at")).drop("w")


def stream_session_totals(stream: DataFrame, key: str, ts: str, gap: str, late: str, sent: str, estimated: str) -> DataFrame:
    """Streaming form: event-time session windows; rows later than the watermark are dropped, state expires by it."""
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.session_window(F.col(ts), gap).alias("w"), key)
        .agg(F.sum(F.coalesce(sent, F.lit(0))).alias("tokens_sent"), F.sum(F.coalesce(estimated, F.lit(0))).alias("tokens_estimated"), F.count("*").alias("calls"), F.max(ts).alias("last_at"))
        .select(key, F.col("w.start").alias("started_at"), "tokens_sent", "tokens_estimated", "calls", "last_at")
    )


def stream_bursts(stream: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Streaming debounce: a burst comes out once the watermark has passed its end."""
    w = F.session_window(F.col(ts), gap)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n_events"), F.max(ts).alias("last_at")).select(key, "n_events", F.col("w.start").alias("first_at"), "last_at")
