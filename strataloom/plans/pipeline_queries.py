"""Queries of the stages that SQL can't express: chunkers, embedding and the approximate index; held against brute force in tests.

What SQL can say of their results (that every file is covered, recall) is registered beside them, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions import text as X
from strataloom.operators import ann, embed, search
from strataloom.session import table
from strataloom.sources import files

QUERIES, SQL = {}, {}


def _query(f=None, sql: str | None = None):
    if f is None:
        return lambda g: _query(g, sql)
    QUERIES[f.__name__] = f
    if sql:
        SQL[f.__name__] = sql.strip()
    return f


def _sources(spark, root):
    c = table(spark, root, "chunks").where("chunk_type = 'file'")
    return c.select(F.col("file_path").alias("path"), "content").distinct()


@_query
def code_chunks(spark, root):
    """Declarations found again in whole source files and vendored releases."""
    v = table(spark, root, "vendor_releases").select(F.concat_ws("/", F.lit("/vendor"), "package", "version", "file_name").alias("path"), "content")
    return files.chunk_table(_sources(spark, root).union(v)).drop("content")


@_query
def code_edges(spark, root):
    return files.edge_table(_sources(spark, root)).groupBy("from_file", "edge_type").agg(F.count("*").alias("n"))


@_query
def document_chunks(spark, root):
    d = table(spark, root, "documents").where("text is not null").select(F.concat(F.lit("/docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    return files.chunk_table(d).drop("content")


_COVER = "SELECT '{0}' AS kind, count(DISTINCT {1})::BIGINT AS n_files FROM {2}"


@_query(sql=" UNION ALL ".join([
    _COVER.format("code", "file_path", "chunks WHERE chunk_type = 'file' AND content IS NOT NULL AND regexp_matches(file_path, '[.](ts|tsx|mts|cts|js|jsx|mjs|cjs|py|pyi|go|rs)$')"),
    _COVER.format("released", "concat_ws('/', package, version, file_name)", "vendor_releases WHERE content IS NOT NULL"),
    _COVER.format("document", "doc_id", r"documents WHERE regexp_matches(text, '\S')"),
]))
def chunk_cover(spark, root):
    """Files with at least one chunk: every source file (one without declarations is a chunk itself), every document with words."""
    code = code_chunks(spark, root).select("file_path").distinct()
    source = code.where(F.regexp_extract("file_path", r"([.][a-z]+)$", 1).isin(*["." + e for e in files.code_scan.LANGUAGE]))
    kind = F.when(F.col("file_path").startswith("/vendor/"), "released").otherwise("code")
    docs = document_chunks(spark, root).select("file_path").distinct().withColumn("kind", F.lit("document"))
    return source.withColumn("kind", kind).union(docs).groupBy("kind").agg(F.count("*").alias("n_files"))


@_query
def embed_pipeline(spark, root):
    """All contents through the stage, those over its token limit left out; a digest of each vector."""
    c = table(spark, root, "chunks").where("content is not null").select("id", "content").distinct().withColumn("tokens", X.word_count(F.col("content")))
    made = embed.embed_rows(c, "content", embed.hashed_words(64), "tokens")
    return made.select("id", F.xxhash64("content").alias("content_key"), F.md5(F.array_join(F.transform("vector", lambda x: F.format_string("%.5f", x)), ",")).alias("digest"))


@_query(sql=r"""SELECT count(*)::BIGINT AS n_embedded FROM (SELECT DISTINCT id, content FROM chunks WHERE content IS NOT NULL)
WHERE len(list_filter(string_split_regex(content, '\s+'), lambda w: w <> '')) BETWEEN 1 AND 8192""")
def embed_cover(spark, root):
    return embed_pipeline(spark, root).agg(F.count("*").alias("n_embedded"))


@_query
def ann_topk(spark, root):
    """Top 20 through the cluster index of every row whose id is divisible by 50, with whether exact search finds them too.

    An exact row that the index misses has a null ``rank``, so recall is the share of ranked rows among the exact ones.
    """
    rows = table(spark, root, "embeddings")
    q = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    exact = search.vector_topk_batch(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), q, 20).select("qid", F.col("id").alias("vec_id"), "rank")
    built = ann.build(rows, "embedding", 16)
    if built is None:
        return exact.withColumn("exact", F.lit(True))
    found = ann.search_batch(*built, "embedding", q, 20, 8, "vec_id").select("qid", "vec_id", "rank")
    return found.join(exact.select("qid", "vec_id", F.lit(True).alias("exact")), ["qid", "vec_id"], "full").select("qid", "vec_id", "rank", F.coalesce("exact", F.lit(False)).alias("exact"))


@_query(sql="SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0) * 20 AS n_exact, true AS recall_reached")
def ann_recall(spark, root):
    """Whether the index finds at least nine tenths of what exact search does, over all stated queries."""
    exact = ann_topk(spark, root).where("exact")
    return exact.agg(F.count("*").alias("n_exact"), (F.count("rank") >= 0.9 * F.count("*")).alias("recall_reached"))
