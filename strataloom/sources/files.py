"""Source trees as DataFrames: listing, ignore rules, hashes, and chunk and edge tables of their files."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.text import EXTENSIONS, SKIP_DIRS, extension, file_type, indexable, word_count
from strataloom.sources import code_scan, doc_scan


def ignore_rules(lines: list[str]) -> list[tuple[str, bool]]:
    """Patterns of an ignore file as (regular expression on the relative path, keep again)."""
    out = []
    for line in lines:
        rule = line.rstrip("\n").rstrip()
        if not rule or rule.startswith("#"):
            continue
        keep = rule.startswith("!")
        rule = rule[1:] if keep else rule.removeprefix("\\")
        only_dir, rule = rule.endswith("/"), rule.rstrip("/")
        anchored = "/" in rule
        body, i = "", 0
        rule = rule.lstrip("/")
        while i < len(rule):
            if rule.startswith("**/", i):
                body, i = body + "(?:.*/)?", i + 3
            elif rule.startswith("**", i):
                body, i = body + ".*", i + 2
            elif rule[i] == "*":
                body, i = body + "[^/]*", i + 1
            elif rule[i] == "?":
                body, i = body + "[^/]", i + 1
            elif rule[i] == "[" and "]" in rule[i + 2 :]:
                end = rule.index("]", i + 2)
                body, i = body + rule[i : end + 1].replace("[!", "[^"), end + 1
            else:
                body, i = body + re.escape(rule[i]), i + 1
        out.append(("^" + ("" if anchored else "(?:.*/)?") + body + ("/.*" if only_dir else "(?:/.*)?") + "$", keep))
    return out


def ignored(rel: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the last rule that matches ignores the path."""
    out = F.lit(False)
    for pattern, keep in rules:
        out = F.when(rel.rlike(pattern), F.lit(not keep)).otherwise(out)
    return out


def root_rules(root: str) -> list[str]:
    """Lines of the ignore file at the root of a tree; none if there isn't one."""
    system, at = _at(root)
    try:
        with system.open_input_stream(f"{at}/.gitignore") as f:
            return f.read().decode("utf-8", "replace").splitlines()
    except OSError:
        return []


def _at(path: str):
    """File system and path of a local path or a URI (file, hdfs, s3, gs)."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _bare_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def _enter(name: str) -> bool:
    """Whether a directory is looked into: hidden and excluded ones aren't, so an unreadable or huge one costs nothing."""
    return not name.startswith(".") and name not in SKIP_DIRS and not name.endswith(".egg-info")


def _children(system, folder: str) -> tuple[list[str], list[tuple[str, int, float]]]:
    """Directories to look into and files of one folder; a folder that can't be read is empty."""
    try:
        found = system.get_file_info(pafs.FileSelector(folder, recursive=False))
    except OSError:
        return [], []
    folders = [i.path for i in found if i.type == pafs.FileType.Directory and _enter(_bare_name(i.path))]
    files = [(i.path, i.size, (i.mtime_ns or 0) / 1e6) for i in found if i.type == pafs.FileType.File and not _bare_name(i.path).startswith(".") and i.path.endswith(EXTENSIONS)]
    return folders, files


SPREAD = 256  # folders from which on the tasks go on with the listing


def list_files(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(path, rel, size, mtime_ms) of the indexable files below ``root``; no content is opened.

    Hidden files and excluded folders are left out before they are looked into; what the root's ignore file or ``ignore`` names is left out.
    The driver lists the upper levels until there are ``SPREAD`` folders; tasks list what lies below each.
    """
    system, at = _at(root.rstrip("/"))
    level, upper = [at], []
    while level and len(level) < SPREAD:
        below = []
        for folder in level:
            folders, files = _children(system, folder)
            below += folders
            upper += files
        level = below
    schema = "path string, size bigint, mtime_ms double"

    def walk(batches):
        here, _ = _at(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                open_, found = [folder], []
                while open_:
                    folders, files = _children(here, open_.pop())
                    open_ += folders
                    found += files
                    if len(found) > 10_000 or not open_:
                        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.float64()))], ["path", "size", "mtime_ms"])
                        found = []

    files = spark.createDataFrame(upper, schema)
    if level:
        folders = spark.createDataFrame([(f,) for f in level], "folder string").repartition(min(len(level), 4 * spark.sparkContext.defaultParallelism))
        files = files.union(folders.mapInArrow(walk, schema))
    named = files.withColumn("rel", F.expr(f"substring(path, {len(at) + 2})"))
    rules = ignore_rules(root_rules(root) + (ignore or []))
    return named.where(indexable(F.col("rel")) & ~ignored(F.col("rel"), rules)).select("path", "rel", "size", "mtime_ms")


def read_files(spark: SparkSession, root: str, keep: DataFrame | None = None, ignore: list[str] | None = None) -> DataFrame:
    """(path, content, sha256, token_count) of the indexable files, or of those in ``keep(path)``; no other file is opened.

    A file that can't be read, or is gone since, is left out; bytes that aren't UTF-8 become replacement characters.
    """
    wanted = list_files(spark, root, ignore).select("path") if keep is None else keep.select("path").distinct()

    def read(batches):
        system, _ = _at(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with system.open_input_stream(path) as f:
                        raw = f.read()
                except OSError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([raw.decode("utf-8", "replace")]), pa.array([hashlib.sha256(raw).hexdigest()])], ["path", "content", "sha256"])

    spread = wanted.repartition(4 * spark.sparkContext.defaultParallelism, "path")  # paths are small, what they name isn't
    return spread.mapInArrow(read, "path string, content string, sha256 string").withColumn("token_count", word_count(F.col("content")))


_CHUNK = "id string, file_path string, chunk_type string, scope string, name string, content string, start_line int, end_line int"
_EDGE = "from_chunk_id string, from_file string, from_symbol string, to_symbol string, to_file string, edge_type string, edge_no int"
_CODE = tuple("." + e for e in code_scan.LANGUAGE)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def chunk_table(files: DataFrame) -> DataFrame:
    """Chunk rows of ``files(path, content)``, code and documents; no shuffle, one pass."""

    def run(batches):
        for pdf in batches:
            rows = [r for p, t in zip(pdf["path"], pdf["content"]) if t is not None for r in (code_scan.chunk_code(p, t)[0] if p.endswith(_CODE) else doc_scan.chunk_document(p, t))]
            yield pd.DataFrame(rows, columns=_names(_CHUNK))

    out = files.select("path", "content").mapInPandas(run, _CHUNK)
    return out.withColumn("file_type", file_type(F.col("file_path"))).withColumn("source_kind", F.lit("file"))


def edge_table(files: DataFrame) -> DataFrame:
    """Call and import edges of ``files(path, content)``, numbered within their file."""

    def run(batches):
        for pdf in batches:
            rows = [r for p, t in zip(pdf["path"], pdf["content"]) if t is not None for r in ({**e, "edge_no": i} for i, e in enumerate(code_scan.chunk_code(p, t)[1]))]
            yield pd.DataFrame(rows, columns=_names(_EDGE))

    code = files.where(extension(F.col("path")).isin(*_CODE))
    return code.select("path", "content").mapInPandas(run, _EDGE)
