"""Queries on references to missing records, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataloom.operators.orphans import orphan_references, orphan_report
from strataloom.session import table


def _tables(spark: SparkSession, root: str) -> list[DataFrame]:
    return [table(spark, root, n) for n in ("edges", "chunks", "manifest", "known_symbols")]


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return orphan_references(*_tables(spark, root)).select("edge_id", "ref_field").distinct()


def p1_report(spark: SparkSession, root: str) -> DataFrame:
    return orphan_report(*_tables(spark, root))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report}

_FOUND = """
WITH present AS (SELECT DISTINCT path FROM manifest WHERE removed_at IS NULL AND path IS NOT NULL),
ends(e) AS (VALUES ('ts'),('tsx'),('mts'),('cts'),('js'),('jsx'),('mjs'),('cjs'),('py'),('pyi'),('go'),('rs')),
forms(ending, written) AS (VALUES ('js','ts'),('js','tsx'),('jsx','tsx'),('mjs','mts'),('cjs','cts')),
vals AS (SELECT DISTINCT to_file v FROM edges WHERE to_file IS NOT NULL),
cand AS (
  SELECT v, v AS p FROM vals
  UNION SELECT v, v || '.' || e FROM vals, ends
  UNION SELECT v, v || '/index.' || e FROM vals, ends
  UNION SELECT v, regexp_replace(v, '[.][a-z]+$', '.' || written) FROM vals, forms WHERE v LIKE '%.' || ending),
res AS (SELECT DISTINCT v, p FROM cand JOIN present ON p = path),
ids AS (SELECT DISTINCT id FROM chunks WHERE id IS NOT NULL UNION SELECT DISTINCT file_path || ':0' FROM chunks WHERE file_path IS NOT NULL),
in_repo AS (SELECT DISTINCT regexp_extract(file_path, '^/ws/([^/]+)/', 1) r, name FROM chunks WHERE source_kind = 'file' AND name IS NOT NULL),
in_file AS (SELECT DISTINCT v, name FROM res JOIN chunks ON p = file_path WHERE name IS NOT NULL),
calls AS (SELECT * FROM edges WHERE edge_type = 'call' AND to_symbol IS NOT NULL AND to_symbol NOT IN (SELECT symbol FROM known_symbols WHERE symbol IS NOT NULL))
SELECT DISTINCT edge_id, 'from_chunk_id' AS ref_field FROM edges WHERE from_chunk_id IS NOT NULL AND from_chunk_id NOT IN (SELECT id FROM ids)
UNION SELECT edge_id, 'to_file' FROM edges WHERE to_file IS NOT NULL AND to_file NOT IN (SELECT v FROM res)
UNION SELECT edge_id, 'to_symbol' FROM calls WHERE to_file IS NULL AND from_file IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM in_repo WHERE r = regexp_extract(from_file, '^/ws/([^/]+)/', 1) AND name = to_symbol)
UNION SELECT edge_id, 'to_symbol' FROM calls WHERE to_file IN (SELECT v FROM res)
  AND NOT EXISTS (SELECT 1 FROM in_file WHERE v = to_file AND name = to_symbol)
"""

SQL = {
    "p1_found": _FOUND,
    "p1_report": f"""
SELECT CASE ref_field WHEN 'to_file' THEN 'manifest' ELSE 'chunks' END AS missing_in, ref_field, strftime(seen, '%Y-%m') AS period, count(*) AS n_orphans
FROM (SELECT o.edge_id, o.ref_field, min(e.indexed_at) AS seen FROM ({_FOUND}) o JOIN edges e ON e.edge_id = o.edge_id GROUP BY ALL) GROUP BY ALL""",
}
