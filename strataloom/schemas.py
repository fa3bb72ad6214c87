"""Explicit schemas of the engine's tables. Vector length is checked on write, Spark arrays carry none."""

from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _fields(*cols):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in cols])


CHUNKS = _fields(
    ("id", _S, False), ("file_path", _S, False), ("chunk_type", _S, False), ("scope", _S, True), ("name", _S, True),
    ("content", _S, False), ("start_line", _I, False), ("end_line", _I, False), ("file_type", _S, False),
    ("source_kind", _S, False), ("vector", T.ArrayType(T.FloatType()), True),
)
EDGES = _fields(
    ("from_chunk_id", _S, False), ("from_file", _S, False), ("from_symbol", _S, True), ("to_symbol", _S, False),
    ("to_file", _S, True), ("edge_type", _S, False), ("edge_no", _I, False),
)
MANIFEST = _fields(("path", _S, False), ("sha256", _S, True), ("token_count", _I, True), ("size", _L, True), ("mtime_ms", _D, True))
INDEX_STATE = _fields(
    ("version", _I, False), ("embeddingModel", _S, False), ("dimension", _I, False), ("indexedAt", _S, False),
    ("fileCount", _L, False), ("chunkCount", _L, False), ("totalTokens", _L, True),
)
COMMIT_FILE = _fields(("path", _S, True), ("insertions", _I, True), ("deletions", _I, True))
COMMITS = _fields(("short_hash", _S, False), ("author", _S, True), ("date", _S, True), ("message", _S, True), ("files", T.ArrayType(COMMIT_FILE), True))
