"""Plain text chunks: one per paragraph, with the line each starts on; arrays only, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text", separator: str = r"\n\n+") -> DataFrame:
    """(key, chunk_no, start_line, n_lines, para): paragraphs that aren't blank, from 1.

    A gap between paragraphs counts as two lines whatever its length, and blank ones are dropped, so start lines may drift.
    Null and blank texts give no rows; repeated rows give theirs each.
    """
    parts = docs.select(key, F.filter(F.split(F.col(text), separator), lambda p: p.rlike(r"\S")).alias("parts"))
    sized = parts.withColumn("lines", F.transform("parts", lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"))) + 1))
    # Running starts in one pass over the line counts.
    starts = F.aggregate("lines", F.struct(F.lit(1).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all")), lambda a, n: F.struct((a["at"] + n + 2).alias("at"), F.array_append(a["all"], a["at"]).alias("all")))["all"]
    rows = sized.select(key, F.posexplode(F.arrays_zip("parts", starts.alias("starts"), "lines")).alias("at", "x"))
    return rows.select(key, (F.col("at") + 1).cast("bigint").alias("chunk_no"), F.col("x.starts").alias("start_line"), F.col("x.lines").cast("bigint").alias("n_lines"), F.col("x.parts").alias("para"))
