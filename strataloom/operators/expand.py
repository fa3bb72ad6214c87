"""One-hop expansion along call edges, and an opt-in resolver of edge targets (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.ranking import EDGE_SIMILARITY

SALTS = 16


def expand_edges(seeds: DataFrame, edges: DataFrame, chunks: DataFrame, per_seed: int = 5) -> DataFrame:
    """Chunks called by ``seeds(id, rank)``: the first ``per_seed`` call edges with a target file of each seed, by edge_id.

    The cap counts edges before misses and repeats. A target is the chunk of smallest (id, start_line) of that file and
    name; seeds themselves are left out, each target comes once, at its first (rank, edge). Similarity is fixed.
    """
    s = seeds.select(F.col("id").alias("seed_id"), F.col("rank").alias("seed_rank"))
    e = edges.where((F.col("edge_type") == "call") & F.col("to_file").isNotNull()).select("edge_id", "from_chunk_id", "to_file", "to_symbol")
    hop = e.join(s, e.from_chunk_id == s.seed_id)
    w = Window.partitionBy("seed_id").orderBy("edge_id", "to_file", "to_symbol")
    hop = hop.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per_seed)
    # Only chunks that are called are grouped; for few seeds the semi join is a broadcast and chunks aren't shuffled.
    called = chunks.select(F.col("file_path").alias("to_file"), F.col("name").alias("to_symbol"), "id", "start_line").join(hop.select("to_file", "to_symbol").distinct(), ["to_file", "to_symbol"], "left_semi")
    target = called.groupBy("to_file", "to_symbol").agg(F.min(F.struct("id", "start_line")).alias("t"))
    found = hop.join(target, ["to_file", "to_symbol"]).select(F.col("t.id").alias("id"), "seed_rank", "nth", "to_file", "to_symbol")
    fresh = found.join(s.select(F.col("seed_id").alias("id")).distinct(), "id", "left_anti")
    first = fresh.groupBy("id").agg(F.min(F.struct("seed_rank", "nth")).alias("at"), F.first("to_file").alias("file_path"), F.first("to_symbol").alias("name"))
    return first.select("id", "file_path", "name", F.col("at.seed_rank").alias("seed_rank"), F.col("at.nth").alias("edge_nth"), F.lit(EDGE_SIMILARITY).alias("similarity"))


def resolve_edges(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Extension: gives call edges without a target file the one file of the repository that declares the symbol, if it is one only.

    A symbol that very many edges name is met by salt."""
    repo = F.regexp_extract("file_path", "^/ws/([^/]*)/", 1)
    one = chunks.where(F.col("name").isNotNull() & (F.col("source_kind") == "file")).groupBy(repo.alias("__repo"), F.col("name").alias("__name"))
    one = one.agg(F.min("file_path").alias("__a"), F.max("file_path").alias("__b")).where("__a = __b")
    one = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    e = edges.withColumn("__repo", F.regexp_extract("from_file", "^/ws/([^/]*)/", 1)).withColumn("__at", F.pmod(F.xxhash64("from_chunk_id", "from_file"), F.lit(SALTS)).cast("int"))
    hit = e.join(one, (e["__repo"] == one["__repo"]) & (e.to_symbol == one["__name"]) & (e["__at"] == one["__salt"]) & e.to_file.isNull() & (e.edge_type == "call"), "left")
    return hit.select(*[F.coalesce(edges[c], F.col("__a")).alias(c) if c == "to_file" else edges[c] for c in edges.columns])
