"""Building, updating and querying an index of a source tree.

Chunks, edges and manifest rows lie in ``BUCKETS`` folders by a hash of their path. A run lists the tree, diffs it with the
manifest, opens only files whose size, time, hash or count calls for it, and writes only the buckets of new, changed and
removed files anew; the state names the folder of each bucket and becomes current by one atomic rename. A run without a change
writes nothing. A run that fails leaves the current state as it is. Folders that neither the current state nor the ``KEEP``
before it name are removed.
"""

from __future__ import annotations

import json
import os
import shutil
import threading
import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom import schemas
from strataloom.functions import display, ranking
from strataloom.functions import text as X
from strataloom.functions.vector import non_zero
from strataloom.operators import context, embed, expand, incremental, search
from strataloom.session import stage_table
from strataloom.sources import commits, files

_LOCK = threading.Lock()
# Directories that are never indexed, with what lies below; the last five are of the user's home.
FORBIDDEN = ("/etc", "/var", "~", "~/.ssh", "~/.aws", "~/.gnupg", "~/.config")
ALLOWED = "/var/folders"  # fixed value: temporary folders of one operating system
BUCKETS, KEEP = 64, 1
TABLES = {"chunks": "file_path", "edges": "from_file", "manifest": "path"}


class NoIndexError(LookupError):
    """There is no usable index at this place."""


def check_root(path: str) -> str:
    """The absolute path; ValueError for the file system's root, the home directory itself, or a sensitive directory and what lies below."""
    for p in (os.path.abspath(path), os.path.realpath(path)):
        if p == "/" or p == os.path.expanduser("~"):
            raise ValueError(f"{p} can't be indexed")
        below = lambda d: p == d or p.startswith(d + "/")  # noqa: E731, B023
        if not below(ALLOWED) and any(below(os.path.expanduser(d)) for d in FORBIDDEN if d != "~"):
            raise ValueError(f"{p} can't be indexed")
    return os.path.realpath(path)


def _state_path(index: str) -> str:
    return os.path.join(index, "CURRENT.json")


def read_state(index: str) -> dict:
    """The current snapshot's state; NoIndexError if there is none or it is not valid."""
    try:
        with open(_state_path(index), encoding="utf-8") as f:
            s = json.load(f)
        s.setdefault("totalTokens", 0)
        if s["version"] != 1 or not all(k in s for k in ("buckets", "embeddingModel", "dimension", "indexedAt", "fileCount", "chunkCount")):
            raise ValueError("incomplete state")
        return s
    except (OSError, ValueError, KeyError, TypeError) as e:
        raise NoIndexError(f"no index at {index}: {e}") from e


class _Busy:
    """A lock file with the owner's process id; that of a dead process is taken over."""

    def __init__(self, index: str):
        self.path = os.path.join(index, "LOCK")

    def __enter__(self):
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        while True:
            try:
                fd = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
                os.write(fd, str(os.getpid()).encode())
                os.close(fd)
                return self
            except FileExistsError:
                try:
                    with open(self.path) as f:
                        owner = int(f.read() or 0)
                    os.kill(owner, 0)
                except (ValueError, ProcessLookupError, FileNotFoundError):
                    try:
                        os.remove(self.path)
                    except FileNotFoundError:
                        pass
                    continue
                raise RuntimeError(f"another run (process {owner}) is indexing; try again later") from None

    def __exit__(self, *_):
        os.remove(self.path)


def _bucket(name: str):
    """Bucket of a row, by its path; rows of the history, which have none, by their id."""
    path = F.col(TABLES[name])
    return F.pmod(F.xxhash64(F.when(path == "", F.col("id")).otherwise(path) if name == "chunks" else path), F.lit(BUCKETS)).cast("int")


def _folder(index: str, run: str, name: str, bucket: str | int) -> str:
    return os.path.join(index, "data", run, name, f"bucket={bucket}")


def _read(spark: SparkSession, index: str, state: dict, name: str, only: set[str] | None = None) -> DataFrame:
    schema = {"chunks": schemas.CHUNKS, "edges": schemas.EDGES, "manifest": schemas.MANIFEST}[name]
    folders = [_folder(index, run, name, b) for b, run in state["buckets"][name].items() if only is None or b in only]
    if not folders:
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).parquet(*folders)
    return df.withColumn("source_kind", F.coalesce("source_kind", F.lit("file"))) if name == "chunks" else df


def load(spark: SparkSession, index: str, name: str) -> DataFrame:
    """A current table; a missing ``source_kind`` reads as ``file``."""
    return _read(spark, index, read_state(index), name)


def _complete(spark: SparkSession, index: str, state: dict) -> bool:
    """Whether the chunks have the column ``file_type``; an index from before it is built anew."""
    folders = [_folder(index, run, "chunks", b) for b, run in state["buckets"]["chunks"].items()]
    return not folders or "file_type" in spark.read.parquet(folders[0]).columns


def _write(df: DataFrame, index: str, run: str, name: str) -> set[str]:
    """Writes rows below the run's folder, by bucket; gives the buckets that have any."""
    at = os.path.join(index, "data", run, name)
    df.withColumn("bucket", _bucket(name)).repartition("bucket").write.partitionBy("bucket").parquet(at)
    return {d.partition("=")[2] for d in os.listdir(at) if d.startswith("bucket=")}


def _prune(index: str, state: dict) -> None:
    """Removes folders of buckets that no kept state names."""
    maps = [state["buckets"], *state["previous"]]
    named = {(run, name, b) for m in maps for name, at in m.items() for b, run in at.items()}
    data = os.path.join(index, "data")
    for run in os.listdir(data):
        for name in os.listdir(os.path.join(data, run)):
            for d in os.listdir(os.path.join(data, run, name)):
                if d.startswith("bucket=") and (run, name, d.partition("=")[2]) not in named:
                    shutil.rmtree(os.path.join(data, run, name, d), ignore_errors=True)
        if not any(r == run for r, _, _ in named):
            shutil.rmtree(os.path.join(data, run), ignore_errors=True)


def build_index(spark: SparkSession, root: str, index: str, embedder: embed.Embedder | None = None, model: str = "hashed-words", dim: int = 64, force: bool = False, verify: bool = False, ignore: list[str] | None = None, history: bool = False, embed_seconds: float | None = embed.TIMEOUT_SECONDS) -> dict:
    """Brings the index of ``root`` up to date and gives the new state, with counts of new, changed, removed, unchanged files and skipped chunks."""
    root = check_root(root)
    if not os.path.isdir(root):
        raise ValueError(f"{root} is no directory")
    with _LOCK, _Busy(index):
        try:
            old = None if force else read_state(index)
            if old and ((old["embeddingModel"], old["dimension"]) != (model, dim) or not _complete(spark, index, old)):
                old = None
        except NoIndexError:
            old = None
        before = old or {"buckets": {name: {} for name in TABLES}, "previous": []}
        stored = _read(spark, index, before, "manifest")
        listed = stage_table(files.list_files(spark, root, ignore).select("path", "size", "mtime_ms"), "listed")
        stat = incremental.stat_partition(listed, stored)
        contents = stage_table(files.read_files(spark, root, stat.where(incremental.needs_read(verify)).select("path")), "contents")
        sums = incremental.carry_forward(listed.select("path"), stored, contents, "sha256").join(incremental.carry_forward(listed.select("path"), stored, contents, "token_count"), "path")
        manifest = stage_table(listed.join(sums, "path").where("sha256 is not null").select("path", "sha256", "token_count", "size", "mtime_ms"), "manifest")
        d = stage_table(incremental.diff(manifest, stored), "diff")
        counts = {k: 0 for k in ("new", "changed", "removed", "unchanged")} | {r["status"]: r["count"] for r in d.groupBy("status").count().collect()}
        # Buckets to write anew: of the tables' files that changed, and of the manifest's rows that did.
        moved = manifest.exceptAll(stored.select(*manifest.columns)).select("path").union(d.where("status = 'removed'").select("path"))
        stale = {"manifest": _touched(moved, "manifest"), "chunks": _touched(d.where("status <> 'unchanged'").select(F.col("path").alias("file_path"), F.lit("").alias("id")), "chunks")}
        stale["edges"] = stale["chunks"]
        past = None
        if history:
            log = commits.history_rows(commits.read_git_log(spark, root))
            have = _read(spark, index, before, "chunks").where("source_kind = 'history'").select("id")
            past = stage_table(log.join(have, "id", "left_anti"), "history")
            gone_past = have.join(log.select("id"), "id", "left_anti")
            touched = past.select("id").union(gone_past).select("id", F.lit("").alias("file_path"))
            stale["chunks"] = stale["chunks"] | _touched(touched, "chunks")
        if old and not any(stale.values()):
            return old | counts | {"skipped": 0}
        fresh = contents.join(incremental.to_process(d), "path", "left_semi")
        cut = stage_table(files.chunk_table(fresh).withColumn("tokens", X.word_count(F.col("content"))), "chunks")
        use = embed.within(embedder or embed.hashed_words(dim), embed_seconds) if embed_seconds else embedder or embed.hashed_words(dim)
        names = [f.name for f in schemas.CHUNKS]
        made = embed.embed_rows(cut, "content", use, "tokens").select(*names)
        kept = incremental.delete_paths(_read(spark, index, before, "chunks", stale["chunks"]), incremental.to_delete(d), "file_path").select(*names)
        if past is not None:
            kept = kept.join(gone_past, "id", "left_anti").select(*names)
            made = made.unionByName(embed.embed_rows(past, "content", use).select(*names))
        edges = files.edge_table(fresh).unionByName(incremental.delete_paths(_read(spark, index, before, "edges", stale["edges"]), incremental.to_delete(d), "from_file"))
        run = f"run-{int(time.time())}-{uuid.uuid4().hex[:8]}"
        buckets = {}
        for name, df in (("chunks", kept.unionByName(made)), ("edges", edges), ("manifest", manifest.where(_bucket("manifest").isin([int(b) for b in stale["manifest"]])))):
            written = _write(df, index, run, name)
            buckets[name] = {b: r for b, r in before["buckets"][name].items() if b not in stale[name]} | {b: run for b in written}
        state = {"version": 1, "buckets": buckets, "previous": ([before["buckets"]] + before["previous"])[:KEEP], "embeddingModel": model, "dimension": dim, "indexedAt": datetime.now(timezone.utc).isoformat()}
        totals = _read(spark, index, state, "manifest").agg(F.count("*").alias("n"), F.sum(F.coalesce("token_count", F.lit(0))).alias("t")).first()
        state |= {"fileCount": totals["n"], "chunkCount": _read(spark, index, state, "chunks").count(), "totalTokens": totals["t"] or 0}
        offered = cut.count() + (past.count() if past is not None else 0)
        skipped = offered + kept.count() - _read(spark, index, {"buckets": {"chunks": {b: run for b in buckets["chunks"] if buckets["chunks"][b] == run}}}, "chunks").count()
        tmp = _state_path(index) + ".tmp"
        with open(tmp, "w", encoding="utf-8") as f:
            json.dump(state, f, indent=2)
        os.replace(tmp, _state_path(index))
        _prune(index, state)
        return state | counts | {"skipped": skipped}


def _touched(rows: DataFrame, name: str) -> set[str]:
    """Buckets of ``rows``: at most ``BUCKETS``."""
    return {str(r[0]) for r in rows.select(_bucket(name)).distinct().collect()}


def _mode(spark: SparkSession, query: str) -> str:
    return spark.range(1).select(ranking.retrieval_mode(F.lit(query))).first()[0]


def find(spark: SparkSession, index: str, query: str, embedder: embed.Embedder | None = None, limit: int | None = None, threshold: float | None = None) -> DataFrame:
    """Ranked chunks for a query: nearest by vector, threshold, re-rank, first of each id. ``embedder=None`` searches by keyword."""
    chunks = load(spark, index, "chunks")
    k, far, weight = ranking.MODES[_mode(spark, query)]
    k, far = limit or k, far if threshold is None else threshold
    if embedder is None:
        hits = search.keyword_search(chunks.drop("vector"), query, k)
        return search.dedup_first(hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))), "id", "rank")
    near = search.vector_topk(chunks.where(non_zero(F.col("vector"))), "vector", embedder([query])[0], k)
    ranked = search.hybrid_rerank(search.after_limit(near, far, "vector").drop("vector"), query, weight)
    return search.dedup_first(ranked, "id", "rank")


def build_context(spark: SparkSession, index: str, query: str, embedder: embed.Embedder, max_tokens: int = 4096, limit: int | None = None, threshold: float | None = None) -> dict:
    """Text of the best chunks within ``max_tokens``, with history after it and outside the budget, and what it saved."""
    chunks = load(spark, index, "chunks")
    found = find(spark, index, query, embedder, limit, threshold).select("id", "file_path", "name", "content", "start_line", "end_line", "source_kind", "similarity", "rank")
    tasks = ["embed_query", "vector_search", "dedup", "token_budget"]
    if _mode(spark, query) == "trace":
        more = expand.expand_edges(found.select("id", "rank"), load(spark, index, "edges").withColumn("edge_id", F.col("edge_no")), chunks)
        added = more.join(chunks.drop("file_path", "name", "vector"), "id").select("id", "file_path", "name", "content", "start_line", "end_line", "source_kind", "similarity", (F.lit(1000) + F.col("seed_rank") * 10 + F.col("edge_nth")).alias("rank"))
        found = search.dedup_first(found.unionByName(added), "id", "rank")
        tasks.append("edge_expansion")
    pool = search.test_filter(found, query).withColumn("block", display.chunk_block(*(F.col(c) for c in ("file_path", "start_line", "end_line", "content")))).withColumn("tokens", X.word_count(F.col("block")))
    source = pool.where("source_kind <> 'history'")
    separator = len(display.SEPARATOR.split())
    kept = context.budget_fill(source.withColumn("g", F.lit(1)), max_tokens, separator, ["g"], "rank").orderBy("rank").collect()  # bounded by the result limit
    past = pool.where("source_kind = 'history'").orderBy("rank").collect()
    text = display.SEPARATOR.join(r["block"] for r in kept)
    if past:
        text += display.HISTORY_HEAD + "\n\n".join(f"### {r['name'] or r['id']}\n{r['content']}" for r in past)
    sent = kept[-1]["used"] if kept else 0
    base = context.reading_baseline(chunks.select("file_path", "name"), load(spark, index, "manifest"), query, "sum").first()["base_tokens"]
    pct = spark.range(1).select(context.reduction(F.lit(sent), F.lit(base)), context.savings_mode(F.lit(sent), F.lit(base))).first()
    return {"content": text, "ids": [r["id"] for r in kept], "tokensSent": sent, "estimatedWithout": base, "reductionPct": pct[0], "mode": pct[1], "filesInContext": len({r["file_path"] for r in kept}), "tasks": tasks}


def import_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest kept as JSON, as the manifest table: maps ``hashes``, ``tokenCounts`` and ``stats``, or the bare map of hashes.

    A missing map entry is null; an unreadable file gives no rows.
    """
    try:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        hashes = raw["hashes"] if isinstance(raw.get("hashes"), dict) else raw
        counts, stats = (raw.get(k) or {} if hashes is not raw else {} for k in ("tokenCounts", "stats"))
        rows = [(p, h, counts.get(p), (stats.get(p) or {}).get("size"), (stats.get(p) or {}).get("mtimeMs")) for p, h in hashes.items() if isinstance(h, str)]
    except (OSError, ValueError, AttributeError):
        rows = []
    return spark.createDataFrame([(p, h, c, s, None if m is None else float(m)) for p, h, c, s, m in rows], schemas.MANIFEST)


def health(spark: SparkSession, index: str) -> dict:
    """Checks of an index, each true or false: state, tables, vector lengths."""
    out = {"state": False, "chunks": False, "edges": False, "manifest": False, "vectors": False}
    try:
        s = read_state(index)
        out["state"] = True
        for name in ("chunks", "edges", "manifest"):
            out[name] = load(spark, index, name).count() >= 0
        out["vectors"] = load(spark, index, "chunks").where(F.size("vector") != s["dimension"]).isEmpty()
    except NoIndexError:
        pass
    return out


def status(spark: SparkSession, index: str, root: str | None = None) -> dict:
    """State of the index and, given the tree, how many files are newer than it."""
    s = read_state(index)
    out = {k: s[k] for k in ("indexedAt", "fileCount", "chunkCount", "totalTokens", "embeddingModel", "dimension")}
    if root:
        at = datetime.fromisoformat(s["indexedAt"]).timestamp() * 1000
        out["staleness"] = incremental.staleness(files.list_files(spark, check_root(root)), at).first().asDict()
    return out
