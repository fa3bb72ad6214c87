"""Registered queries of this package, over whole tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import bpe, credentials, neighbors, pack, residue, split, syntax, vendored
from strataloom.session import table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return credentials.find(table(spark, root, "chunks")).select("id", "line_no").distinct()


def p2_redacted(spark: SparkSession, root: str) -> DataFrame:
    return credentials.redact(table(spark, root, "chunks"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return syntax.judge_files(table(spark, root, "chunks")).where(~F.col("valid")).select("file_path").distinct()


def p3_files(spark: SparkSession, root: str) -> DataFrame:
    return syntax.judge_files(table(spark, root, "chunks"))


def p3_rates(spark: SparkSession, root: str) -> DataFrame:
    return syntax.rates(syntax.judge_files(table(spark, root, "chunks")))


def p3_grammars(spark: SparkSession, root: str) -> DataFrame:
    return syntax.grammars(syntax.judge_files(table(spark, root, "chunks")))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return split.split_oversized(table(spark, root, "chunks")).select("id").distinct()


def p4_pieces(spark: SparkSession, root: str) -> DataFrame:
    return split.split_oversized(table(spark, root, "chunks"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return neighbors.neighbor_pairs(table(spark, root, "chunks").select("id", "vector"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return p6_files(spark, root).select("file_path")


def p6_files(spark: SparkSession, root: str) -> DataFrame:
    return vendored.not_hand_written(table(spark, root, "chunks"), table(spark, root, "vendor_releases"))


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    return bpe.encode_documents(table(spark, root, "documents"))


def p8_packed(spark: SparkSession, root: str) -> DataFrame:
    return pack.pack_documents(table(spark, root, "documents"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return p9_kinds(spark, root).select("doc_id")


def p9_kinds(spark: SparkSession, root: str) -> DataFrame:
    return residue.residue(table(spark, root, "documents"))


# --- what SQL can say of results it can't make


def p2_check(spark: SparkSession, root: str) -> DataFrame:
    """Masking keeps every row, its length and its line ends."""
    r = p2_redacted(spark, root)
    return r.agg(F.count("*").alias("n_rows"), F.sum(F.length("content")).alias("n_chars"), F.sum(F.regexp_count("content", F.lit("\n"))).cast("bigint").alias("n_lines"), F.count_if(F.col("content").isNull()).alias("n_null"))


def p3_totals(spark: SparkSession, root: str) -> DataFrame:
    """Files looked at, per repository and language."""
    return p3_rates(spark, root).select("repo", "language", "n_files")


def p4_check(spark: SparkSession, root: str) -> DataFrame:
    """The pieces hold every character of every oversized row once, but for the overlap; none is over the limit; lines fit."""
    p = p4_pieces(spark, root)
    new = F.col("to_char") - F.col("from_char") - F.when(F.col("piece") > 0, 200).otherwise(0)
    lines = F.regexp_count(F.expr("substring(content, 1, length(content) - 1)"), F.lit("\n"))
    wrong = (F.col("item_line") > 0) & (F.col("end_line") - F.col("start_line") != lines)
    over = (F.length("content") > 4000) | (F.length("content") != F.col("to_char") - F.col("from_char"))
    return p.agg(F.count_if(F.col("piece") == 0).alias("n_items"), F.coalesce(F.sum(new), F.lit(0)).alias("n_chars"), F.count_if(over).alias("n_over"), F.count_if(wrong).alias("n_wrong_lines"))


def p6_copies(spark: SparkSession, root: str) -> DataFrame:
    """Vendored files one of whose whole contents is a released file's."""
    same = table(spark, root, "chunks").where("chunk_type = 'file'").join(table(spark, root, "vendor_releases").select("content").distinct(), "content", "left_semi").select("file_path").distinct()
    return p6_files(spark, root).where("vendored").join(same, "file_path", "left_semi").select("file_path")


def p7_check(spark: SparkSession, root: str) -> DataFrame:
    """Ids decode to the text they came from."""
    back = bpe.decode_documents(p7_ids(spark, root)).join(table(spark, root, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    return back.agg(F.count("*").alias("n_docs"), F.count_if(F.col("decoded") == F.col("text")).alias("n_equal"))


def p8_check(spark: SparkSession, root: str) -> DataFrame:
    """Every document is placed, no container is over its capacity, and only texts over it are split."""
    p = p8_packed(spark, root)
    full = p.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > 1024).alias("n_over"))
    docs = p.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"))
    placed = docs.agg(F.count("*").alias("n_docs"), F.count_if(F.col("n") == 0).alias("n_empty"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= 1024)).alias("n_split"))
    return placed.crossJoin(full)  # one row each


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted, "p3_found": p3_found, "p3_files": p3_files, "p3_rates": p3_rates, "p3_grammars": p3_grammars, "p4_found": p4_found, "p4_pieces": p4_pieces, "p5_found": p5_found, "p6_found": p6_found, "p6_files": p6_files, "p7_ids": p7_ids, "p8_packed": p8_packed, "p9_found": p9_found, "p9_kinds": p9_kinds}
QUERIES |= {f.__name__: f for f in (p2_check, p3_totals, p4_check, p6_copies, p7_check, p8_check)}

_ENDS = " ".join(f"WHEN '{e}' THEN '{g}'" for e, g in syntax.LANGUAGES.items())

SQL = {
    "p2_check": "SELECT count(*) AS n_rows, sum(length(content))::BIGINT AS n_chars, sum(length(content) - length(replace(content, chr(10), '')))::BIGINT AS n_lines, count(*) FILTER (content IS NULL) AS n_null FROM chunks",
    "p3_totals": f"""SELECT regexp_extract(file_path, '^/ws/([^/]+)/', 1) AS repo, CASE regexp_extract(file_path, '[.]([a-z]+)$', 1) {_ENDS} END AS language, count(DISTINCT file_path) AS n_files
FROM chunks WHERE source_kind = 'file' AND regexp_extract(file_path, '[.]([a-z]+)$', 1) IN ({", ".join(f"'{e}'" for e in syntax.LANGUAGES)}) GROUP BY ALL""",
    "p4_found": "SELECT DISTINCT id FROM chunks WHERE length(content) > 4000",
    "p4_check": "SELECT count(*) AS n_items, coalesce(sum(length(content)), 0)::BIGINT AS n_chars, 0 AS n_over, 0 AS n_wrong_lines FROM chunks WHERE length(content) > 4000",
    "p5_found": """WITH v AS (SELECT id, min(vector)::DOUBLE[] AS v FROM chunks WHERE id IS NOT NULL AND len(vector) = 64 GROUP BY id),
u AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM v WHERE list_dot_product(v, v) > 0),
s AS (SELECT a.id AS x, b.id AS y, round(list_dot_product(a.v, b.v) / (a.n * b.n), 12) AS sim FROM u a JOIN u b ON a.id <> b.id),
r AS (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY sim DESC, y) AS nth FROM s)
SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM r WHERE nth <= 5""",
    "p6_copies": f"""SELECT DISTINCT file_path FROM chunks JOIN (SELECT DISTINCT content FROM vendor_releases) USING (content)
WHERE chunk_type = 'file' AND source_kind = 'file' AND regexp_extract(file_path, '[.]([a-z]+)$', 1) IN ({", ".join(f"'{e}'" for e in vendored.CODE)})""",
    "p7_check": "SELECT count(*) AS n_docs, count(*) AS n_equal FROM documents",
    "p8_check": "SELECT count(*) AS n_docs, count(*) FILTER (text IS NULL OR text = '') AS n_empty, 0 AS n_split, 0 AS n_over FROM documents",
}
