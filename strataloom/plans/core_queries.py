"""Registered queries of the engine's own operators over whole tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.functions import display as D
from strataloom.functions import ranking as R
from strataloom.functions import text as X
from strataloom.functions.vector import cosine_distance, non_zero
from strataloom.operators import context as C
from strataloom.operators import expand as E
from strataloom.operators import incremental as I
from strataloom.operators import search as S
from strataloom.session import table
from strataloom.sources import commits as G
from strataloom.sources import plain_text as P
from strataloom.streaming import sessions as K
from strataloom.streaming import watch as Wa

QUERIES, SQL = {}, {}
QUESTION = "where does the cursor load its stable config"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _any(col: str, words) -> str:
    return f"len(list_filter({_list(words)}, lambda w: contains({col}, w))) > 0"


_TOKENS_OF = r"list_filter(string_split_regex(lower({q}), '[\s\x0B.,;:!?''\"()\[\]{{}}/\\]+'), lambda t: length(t) >= 3)"
_QTOK = _TOKENS_OF.format(q="'" + QUESTION + "'")
_FN, _STEM = r"regexp_extract({p}, '([^/]*)$', 1)", r"regexp_replace(regexp_extract({p}, '([^/]*)$', 1), '\.[^.]+$', '')"


def _boost_sql(tokens: str, path: str = "file_path", name: str = "name") -> str:
    fn, stem, nm = f"lower({_FN.format(p=path)})", f"lower({_STEM.format(p=path)})", f"lower(coalesce({name}, ''))"
    words = rf"list_filter(string_split_regex({nm}, '\s+'), lambda s: length(s) >= 2)"
    return f"""CASE WHEN len({tokens}) = 0 THEN 0.0 WHEN {nm} <> '' AND list_contains({tokens}, {nm}) THEN 1.0
      WHEN len({words}) > 1 AND len(list_filter({words}, lambda s: len(list_filter({tokens}, lambda t: contains(t, s) OR contains(s, t))) = 0)) = 0 THEN 1.0
      WHEN {stem} <> '' AND list_contains({tokens}, {stem}) THEN 0.6
      ELSE len(list_filter({tokens}, lambda t: contains({fn} || ' ' || {nm}, t)))::DOUBLE / len({tokens}) END"""


_TESTY = "(regexp_matches({q}, '\\btests?\\b') OR regexp_matches({q}, '\\bspec\\b') OR {any})"
_TEST_PATH = r"(regexp_matches({p}, '\.(test|spec)\.[jt]sx?$') OR contains({p}, '__tests__/'))"
_DIST = "CASE WHEN len({a}) = len({b}) AND sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) > 0 THEN round(1 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))), 12) + 0.0 END"
_VEC0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


def micros(name: str):
    """Microseconds since 1970 of a time with or without a zone (the latter read as UTC, whatever the session's zone)."""
    t = F.col(name)
    return F.when(F.typeof(t) == "timestamp_ntz", F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {name})")).otherwise(F.expr(f"timestampdiff(MICROSECOND, timestamp_micros(0), {name})"))


def query_vector(spark: SparkSession, root: str) -> list[float]:
    """One stated query vector."""
    row = table(spark, root, "embeddings").where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]] if row else []


# --- scans and sources


@query("SELECT DISTINCT id, file_path, chunk_type, name, start_line, end_line FROM chunks WHERE source_kind = 'file'")
def chunk_scan(spark, root):
    return table(spark, root, "chunks").where("source_kind = 'file'").select("id", "file_path", "chunk_type", "name", "start_line", "end_line").distinct()


_IND = r"regexp_extract(path, '(\.[^./]+)$', 1) IN (" + ", ".join(f"'{e}'" for e in X.EXTENSIONS) + r") AND NOT regexp_matches(path, '(^|/)(" + "|".join(d.replace(".", r"\.") for d in X.SKIP_DIRS) + r"|[^/]+\.egg-info)/|(^|/)(" + "|".join(f.replace(".", r"\.") for f in X.SKIP_FILES) + r")$|\.min\.js$')"


@query(f"SELECT DISTINCT path, coalesce({_IND}, false) AS indexable FROM manifest")
def crawl_filter(spark, root):
    return table(spark, root, "manifest").select("path", X.indexable(F.col("path")).alias("indexable")).distinct()


_REL = "regexp_replace(path, '^/ws/[^/]+/', '')"


@query(f"SELECT repo, count(DISTINCT path) AS n FROM manifest WHERE regexp_extract(path, '(\\.[^./]+)$', 1) IN ({', '.join(repr(e) for e in X.EXTENSIONS)}) AND NOT regexp_matches({_REL}, '^(node_modules|\\.git|dist|build|\\.next|__pycache__)/') GROUP BY repo")
def watch_filter(spark, root):
    m = table(spark, root, "manifest")
    return m.where(X.watch_worthy(F.regexp_replace("path", "^/ws/[^/]+/", ""))).groupBy("repo").agg(F.count_distinct("path").alias("n"))


@query("SELECT DISTINCT id, sha256(content) AS sha FROM chunks")
def content_hash(spark, root):
    return table(spark, root, "chunks").select("id", F.sha2("content", 256).alias("sha")).distinct()


@query(r"""WITH p AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '\n\n+'), lambda x: regexp_matches(x, '\S'))) AS para, generate_subscripts(list_filter(string_split_regex(text, '\n\n+'), lambda x: regexp_matches(x, '\S')), 1) AS i FROM documents),
l AS (SELECT *, len(string_split(para, chr(10))) AS n FROM p)
SELECT doc_id, i AS chunk_no, (1 + coalesce(sum(n + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start_line, n AS n_lines, md5(para) AS digest FROM l""")
def paragraph_chunks(spark, root):
    out = P.paragraphs(table(spark, root, "documents").select("doc_id", "text"))
    return out.select("doc_id", "chunk_no", "start_line", "n_lines", F.md5("para").alias("digest"))


_FIELDS = "string_split(x, chr(9))"
_COUNT = lambda i: rf"list_transform(extra, lambda x: coalesce(try_cast(nullif(regexp_extract({_FIELDS}[{i}], '^\s*([+-]?\d+)', 1), '') AS BIGINT), 0))"


@query(rf"""WITH c AS (SELECT DISTINCT short_hash, author, coalesce(date, '') AS date, coalesce(message, '') AS m, coalesce(files, []) AS files FROM commits),
t AS (SELECT *, string_split(m, chr(10)) AS l, coalesce(list_position(list_transform(string_split(m, chr(10)), lambda x: contains(x, chr(9))), true), 0) AS i FROM c),
e AS (SELECT *, CASE WHEN i = 0 THEN m ELSE coalesce(array_to_string(l[1:i - 1], chr(10)), '') END AS said,
  list_filter(CASE WHEN i = 0 THEN []::VARCHAR[] ELSE l[i:] END, lambda x: len({_FIELDS}) >= 3 AND trim(array_to_string({_FIELDS}[3:], chr(9))) <> '') AS extra FROM t)
SELECT short_hash, author, date, trim(regexp_replace(said, '^\s+|\s+$', '', 'g')) AS message, (len(files) + len(extra))::BIGINT AS n_files,
  (coalesce(list_sum(list_transform(files, lambda f: coalesce(f.insertions, 0))), 0) + coalesce(list_sum({_COUNT(1)}), 0))::BIGINT AS added,
  (coalesce(list_sum(list_transform(files, lambda f: coalesce(f.deletions, 0))), 0) + coalesce(list_sum({_COUNT(2)}), 0))::BIGINT AS removed FROM e""")
def git_log_parse(spark, root):
    """Every commit; a message ends before its first line with a tab, and what follows is read as counts."""
    c = table(spark, root, "commits").select("short_hash", "author", F.coalesce("date", F.lit("")).alias("date"), "message", "files").distinct()
    p = G.parse_log(c.select(G.log_text(c).alias("log")), "log", normalize=False)
    total = lambda f: F.coalesce(F.aggregate("files", F.lit(0).cast("bigint"), lambda a, x: a + x[f]), F.lit(0).cast("bigint"))
    return p.select("short_hash", "author", "date", "message", F.size("files").cast("bigint").alias("n_files"), total("insertions").alias("added"), total("deletions").alias("removed"))


_ISO = r"'^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$'"


@query(rf"""SELECT DISTINCT short_hash, repo, coalesce(CASE WHEN regexp_matches(date, {_ISO}) THEN strftime(try_cast(CASE WHEN regexp_matches(date, '(Z|[+-]\d{{2}}:?\d{{2}})$') AND length(date) > 10 THEN date ELSE date || CASE WHEN length(date) = 10 THEN ' 00:00:00+00' ELSE '+00' END END AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%gZ') END, date) AS iso FROM commits""")
def normalize_date(spark, root):
    return table(spark, root, "commits").select("short_hash", "repo", X.iso_date(F.col("date")).alias("iso")).distinct()


_CONTENT = """concat_ws(chr(10), 'Commit: ' || short_hash, 'Author: ' || coalesce(author, ''), 'Date: ' || coalesce(date, ''), '', CASE WHEN coalesce(trim(message), '') = '' THEN '(no commit message)' ELSE message END, '', 'Touched files:',
  CASE WHEN coalesce(len(files), 0) > 0 THEN array_to_string(list_transform(files, lambda f: '- ' || f.path || ' (+' || coalesce(f.insertions, 0) || '/-' || coalesce(f.deletions, 0) || ')'), chr(10)) ELSE '- (no touched files)' END)"""


@query(f"SELECT DISTINCT short_hash, md5({_CONTENT}) AS digest FROM commits")
def commit_content(spark, root):
    c = table(spark, root, "commits")
    return c.select("short_hash", F.md5(D.commit_text(*(F.col(x) for x in ("short_hash", "author", "date", "message", "files")))).alias("digest")).distinct()


@query(f"SELECT DISTINCT 'git:' || short_hash AS id, '' AS file_path, 'commit' AS chunk_type, short_hash AS name, 0 AS start_line, 0 AS end_line, 'history' AS source_kind, length({_CONTENT}) AS n_chars FROM commits")
def history_rows(spark, root):
    h = G.history_rows(table(spark, root, "commits"))
    return h.select("id", "file_path", "chunk_type", "name", "start_line", "end_line", "source_kind", F.length("content").cast("bigint").alias("n_chars")).distinct()


# --- table maintenance


@query("SELECT file_path, count(*) AS n FROM chunks WHERE file_path NOT IN (SELECT path FROM manifest WHERE removed_at IS NOT NULL AND path IS NOT NULL) GROUP BY file_path")
def delete_by_path(spark, root):
    gone = table(spark, root, "manifest").where("removed_at is not null").select("path")
    return I.delete_paths(table(spark, root, "chunks").select("file_path"), gone, "file_path").groupBy("file_path").agg(F.count("*").alias("n"))


@query("SELECT source_kind, chunk_type, count(*) AS n FROM chunks WHERE source_kind <> 'history' GROUP BY ALL")
def delete_history(spark, root):
    return table(spark, root, "chunks").where("source_kind <> 'history'").groupBy("source_kind", "chunk_type").agg(F.count("*").alias("n"))


@query("SELECT edge_type, count(*) AS n, count(DISTINCT from_file) AS files FROM edges WHERE from_file NOT IN (SELECT path FROM manifest WHERE removed_at IS NOT NULL AND path IS NOT NULL) GROUP BY edge_type")
def edge_delete(spark, root):
    gone = table(spark, root, "manifest").where("removed_at is not null").select("path")
    return I.delete_paths(table(spark, root, "edges").select("from_file", "edge_type"), gone, "from_file").groupBy("edge_type").agg(F.count("*").alias("n"), F.count_distinct("from_file").alias("files"))


# --- scalars


@query("WITH t AS (SELECT call_id, " + _TOKENS_OF.format(q="query_text") + " AS tok FROM tool_calls WHERE query_text IS NOT NULL) SELECT call_id, unnest(tok) AS token, generate_subscripts(tok, 1) - 1 AS pos FROM t")
def query_tokens(spark, root):
    return table(spark, root, "tool_calls").select("call_id", F.posexplode(X.query_tokens(F.col("query_text"))).alias("pos", "token")).withColumn("pos", F.col("pos").cast("bigint"))


@query(r"SELECT DISTINCT name, array_to_string(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '\s+'), lambda t: length(t) >= 2), ' ') AS words FROM chunks WHERE name IS NOT NULL")
def camel_split(spark, root):
    return table(spark, root, "chunks").where("name is not null").select("name", F.array_join(X.camel_split(F.col("name")), " ").alias("words")).distinct()


@query(f"SELECT DISTINCT file_path, {_FN.format(p='file_path')} AS file_name, {_STEM.format(p='file_path')} AS stem FROM chunks")
def file_stem(spark, root):
    p = F.col("file_path")
    return table(spark, root, "chunks").select("file_path", X.file_name(p).alias("file_name"), X.file_stem(p).alias("stem")).distinct()


@query(f"SELECT DISTINCT id, file_path, name, round({_boost_sql(_QTOK)}, 6) AS boost FROM chunks")
def keyword_boost(spark, root):
    t = X.query_tokens(F.lit(QUESTION))
    return table(spark, root, "chunks").select("id", "file_path", "name", F.round(R.keyword_boost(t, F.col("file_path"), F.col("name")), 6).alias("boost")).distinct()


def _config_sql(q: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({_FN.format(p='path')}, '{p}') THEN {0.0 if tool in q else R.CONFIG_PENALTY}" for p, tool in R.CONFIG_FILES)
    return f"CASE {cases} ELSE 0.0 END"


@query(f"""SELECT DISTINCT path, round({_config_sql(QUESTION)}, 2)::DOUBLE AS config, CASE WHEN {_TEST_PATH.format(p='path')} THEN 0.55 ELSE 0.0 END::DOUBLE AS test
FROM (SELECT path FROM manifest UNION ALL SELECT regexp_replace(path, '[^/]+$', 'vitest.config.ts') FROM manifest UNION ALL SELECT regexp_replace(path, '[^/]+$', 'tsconfig.base.json') FROM manifest)""")
def noise_penalty(spark, root):
    m = table(spark, root, "manifest").select("path")
    every = m.union(m.select(F.regexp_replace("path", "[^/]+$", "vitest.config.ts"))).union(m.select(F.regexp_replace("path", "[^/]+$", "tsconfig.base.json")))
    q = F.lit(QUESTION)
    return every.select("path", F.round(R.config_penalty(F.col("path"), q), 2).alias("config"), R.test_penalty(F.col("path"), q).alias("test")).distinct()


_LQ = "lower(coalesce(query_text, ''))"
_MODE = f"""CASE WHEN ({_any(_LQ, R.TRACE)} OR regexp_matches({_LQ}, 'how does\\b.*\\bflow\\b')) AND NOT {_any(_LQ, R.BROAD)} THEN 'trace' WHEN {_any(_LQ, R.LOOKUP_PAIRS)} THEN 'lookup'
 WHEN {_any(_LQ, R.LOOKUP)} AND NOT {_any(_LQ, R.LOOKUP_NOT)} THEN 'lookup' ELSE 'explore' END"""


@query(f"SELECT call_id, {_MODE} AS mode, {_TESTY.format(q=_LQ, any=_any(_LQ, R.TEST_WORDS))} AS about_tests FROM tool_calls")
def classify_mode(spark, root):
    q = F.col("query_text")
    return table(spark, root, "tool_calls").select("call_id", R.retrieval_mode(q).alias("mode"), R.test_intent(q).alias("about_tests"))


@query(r"SELECT DISTINCT path, CASE WHEN regexp_matches(regexp_extract(replace(path, '\', '/'), '([^/]*)$', 1), '\.(test|spec)\.[tj]sx?$') OR contains(replace(path, '\', '/'), '/__tests__/') THEN 'test' ELSE 'source' END AS file_type FROM manifest")
def file_type(spark, root):
    return table(spark, root, "manifest").select("path", X.file_type(F.col("path")).alias("file_type")).distinct()


@query("SELECT p_partkey, CASE WHEN p_size IS NULL OR p_size < 2 THEN 'none' WHEN p_size < 8 THEN 'standard' ELSE 'large' END AS tier, split_part(p_brand || ':latest', ':', 1) AS model FROM part")
def model_tier(spark, root):
    return table(spark, root, "part").select("p_partkey", X.vram_tier(F.col("p_size")).alias("tier"), X.model_base(F.concat("p_brand", F.lit(":latest"))).alias("model"))


_WC = r"(CASE WHEN trim(regexp_replace(coalesce({t}, ''), '[\s\x0B]+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(coalesce({t}, ''), '[\s\x0B]+', ' ', 'g')), ' ')) END)"


@query(f"SELECT doc_id, {_WC.format(t='text')}::INT AS tokens FROM documents")
def token_count(spark, root):
    return table(spark, root, "documents").select("doc_id", X.word_count(F.col("text")).alias("tokens"))


_BLOCK = "'// File: ' || file_path || ' (lines ' || start_line || '-' || end_line || ')' || chr(10) || content"


@query(f"SELECT DISTINCT id, md5({_BLOCK}) AS digest, coalesce(name, '(anonymous)') AS shown, CASE WHEN source_kind = 'history' THEN '[history]' ELSE file_path END AS place FROM chunks")
def context_format(spark, root):
    c = lambda n: F.col(n)
    return table(spark, root, "chunks").select("id", F.md5(D.chunk_block(c("file_path"), c("start_line"), c("end_line"), c("content"))).alias("digest"), D.display_name(c("name")).alias("shown"), D.provenance(c("source_kind"), c("file_path")).alias("place")).distinct()


@query("SELECT session_id, sum(tokens_sent)::BIGINT AS n, CASE WHEN sum(tokens_sent) < 1000 THEN sum(tokens_sent)::VARCHAR WHEN sum(tokens_sent) < 1000000 THEN floor(sum(tokens_sent) / 1000.0 + 0.5)::BIGINT || 'k' ELSE printf('%.1f', sum(tokens_sent) / 1e6) || 'M' END AS shown FROM tool_calls GROUP BY session_id")
def short_count(spark, root):
    t = table(spark, root, "tool_calls").groupBy("session_id").agg(F.sum("tokens_sent").alias("n"))
    return t.select("session_id", "n", X.short_count(F.col("n")).alias("shown"))


# --- search


def _hits(spark, root, k: int) -> DataFrame:
    c = table(spark, root, "chunks").select("id", "file_path", "name", "source_kind", "vector").where(non_zero(F.col("vector"))).distinct()
    return S.vector_topk(c, "vector", query_vector(spark, root), k)


_HITS = f"(SELECT id, file_path, name, source_kind, {_DIST.format(a='vector::DOUBLE[]', b=_VEC0)} AS dist FROM (SELECT DISTINCT id, file_path, name, source_kind, vector FROM chunks) WHERE dist IS NOT NULL ORDER BY dist, id LIMIT {{k}})"


@query(f"SELECT vec_id, {_DIST.format(a='embedding::DOUBLE[]', b=_VEC0)} AS dist FROM embeddings WHERE dist IS NOT NULL ORDER BY dist, vec_id LIMIT 20")
def vector_topk(spark, root):
    e = table(spark, root, "embeddings").select("vec_id", "embedding")
    return S.vector_topk(e, "embedding", query_vector(spark, root), 20, "vec_id").select("vec_id", "dist")


@query(f"SELECT id, round(dist, 9) AS dist, round(1 - dist, 9) AS similarity FROM {_HITS.format(k=50)} WHERE dist <= 0.75")
def vector_topk_threshold(spark, root):
    return S.after_limit(_hits(spark, root, 50), 0.75, "vector").select("id", F.round("dist", 9).alias("dist"), F.round("similarity", 9).alias("similarity"))


@query(f"""SELECT qid, id, round(dist, 9) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM (
SELECT q.vec_id AS qid, e.vec_id AS id, {_DIST.format(a='e.embedding::DOUBLE[]', b='q.embedding::DOUBLE[]')} AS dist FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) WHERE dist IS NOT NULL) WHERE rank <= 5""")
def vector_topk_batch(spark, root):
    e = table(spark, root, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    out = S.vector_topk_batch(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), q, 5)
    return out.select("qid", "id", F.round("dist", 9).alias("dist"), F.col("rank").cast("bigint").alias("rank"))


_SCORED = f"""SELECT *, similarity0 * 0.9 + boost * 0.1 - CASE WHEN {_TEST_PATH.format(p='file_path')} THEN 0.55 ELSE 0.0 END - CASE WHEN source_kind = 'history' THEN 0.07 ELSE 0.0 END AS score
FROM (SELECT *, 1 - dist AS similarity0, {_boost_sql(_QTOK)} AS boost FROM {_HITS.format(k=200)})"""


@query(f"SELECT id, round(score, 9) AS score, round(CASE WHEN boost > 0 THEN greatest(similarity0, 0.85) ELSE similarity0 END, 9) AS similarity FROM ({_SCORED})")
def hybrid_rerank(spark, root):
    out = S.hybrid_rerank(S.after_limit(_hits(spark, root, 200), 2.0), QUESTION, 0.10)
    return out.select("id", F.round("score", 9).alias("score"), F.round("similarity", 9).alias("similarity"))


@query(f"SELECT id, round(dist, 9) AS dist, row_number() OVER (ORDER BY 1 - dist DESC, dist, id) AS rank FROM {_HITS.format(k=30)}")
def similarity_order(spark, root):
    out = S.hybrid_rerank(S.after_limit(_hits(spark, root, 30), 2.0), "a b", 0.10)
    return out.select("id", F.round("dist", 9).alias("dist"), F.col("rank").cast("bigint").alias("rank"))


_KW = f"SELECT DISTINCT id, file_path, name, start_line, md5(content) AS digest, {_boost_sql(_QTOK)} AS score FROM chunks WHERE len(list_filter({_QTOK}, lambda t: contains(file_path, t) OR coalesce(contains(name, t), false) OR contains(content, t))) > 0"


@query(f"SELECT id, name, start_line, digest, round(score, 6) AS score FROM ({_KW}) WHERE score > 0")
def keyword_rows(spark, root):
    rows = S.keyword_rows(table(spark, root, "chunks").select("id", "file_path", "name", "content", "start_line"), QUESTION)
    return rows.select("id", "name", "start_line", F.md5("content").alias("digest"), F.round("score", 6).alias("score")).distinct()


@query(f"SELECT id, round(score, 6) AS score FROM ({_KW.replace('md5(content) AS digest', 'content')}) WHERE score > 0 ORDER BY score DESC, id, start_line, content LIMIT 20")
def keyword_search(spark, root):
    c = table(spark, root, "chunks").select("id", "file_path", "name", "content", "start_line").distinct()
    return S.keyword_search(c, QUESTION, 20).select("id", F.round("score", 6).alias("score"))


@query("SELECT id, name, epoch_us(indexed_at) AS indexed_us FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at, start_line, content) AS rn FROM chunks) WHERE rn = 1")
def dedup_first(spark, root):
    c = table(spark, root, "chunks").select("id", "name", "indexed_at", "start_line", "content")
    return S.dedup_first(c, "id", "indexed_at", "start_line", "content").select("id", "name", micros("indexed_at").alias("indexed_us"))


@query(f"""WITH top AS (SELECT id, file_path, row_number() OVER (ORDER BY score DESC, id, start_line, content) AS rank FROM ({_KW.replace('md5(content) AS digest', 'content')}) WHERE score > 0 QUALIFY rank <= 40),
f AS (SELECT *, {_TEST_PATH.format(p='file_path')} AS t FROM top), g AS (SELECT *, count(*) FILTER (NOT t) OVER () AS plain, row_number() OVER (PARTITION BY t ORDER BY rank) AS nth FROM f)
SELECT id, row_number() OVER (ORDER BY t, rank) AS rank FROM g WHERE plain = 0 OR NOT t OR (plain < 3 AND nth <= 3 - plain)""")
def test_filter(spark, root):
    c = table(spark, root, "chunks").select("id", "file_path", "name", "content", "start_line").distinct()
    top = S.keyword_search(c, QUESTION, 40).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id", "start_line", "content")))
    return S.test_filter(top, QUESTION).select("id", F.col("rank").cast("bigint").alias("rank"))


_SEEDS = "(SELECT id, min(start_line) AS rank FROM chunks WHERE chunk_type = 'method' GROUP BY id)"


_ONE = "(SELECT regexp_extract(file_path, '^/ws/([^/]*)/', 1) AS r, name, min(file_path) AS a FROM chunks WHERE name IS NOT NULL AND source_kind = 'file' GROUP BY ALL HAVING min(file_path) = max(file_path))"


@query(f"""WITH s AS {_SEEDS}, one AS {_ONE}, res AS (SELECT DISTINCT edge_id, from_chunk_id, coalesce(to_file, a) AS to_file, to_symbol FROM edges LEFT JOIN one ON r = regexp_extract(from_file, '^/ws/([^/]*)/', 1) AND name = to_symbol AND to_file IS NULL WHERE edge_type = 'call'),
 hop AS (SELECT s.id AS seed_id, s.rank AS seed_rank, to_file, to_symbol, row_number() OVER (PARTITION BY s.id ORDER BY edge_id, to_file, to_symbol) AS nth
 FROM (SELECT * FROM res WHERE to_file IS NOT NULL) e JOIN s ON e.from_chunk_id = s.id QUALIFY nth <= 5),
 t AS (SELECT file_path, name, min(id) AS id FROM chunks WHERE name IS NOT NULL GROUP BY ALL)
SELECT t.id, min((seed_rank, nth))[1] AS seed_rank, 0.5::DOUBLE AS similarity FROM hop JOIN t ON t.file_path = hop.to_file AND t.name = hop.to_symbol WHERE t.id NOT IN (SELECT id FROM s) GROUP BY t.id""")
def edge_expand(spark, root):
    c = table(spark, root, "chunks").select("id", "file_path", "name", "start_line", "chunk_type", "source_kind")
    seeds = c.where("chunk_type = 'method'").groupBy("id").agg(F.min("start_line").alias("rank"))
    e = E.resolve_edges(table(spark, root, "edges").select("edge_id", "from_chunk_id", "from_file", "to_file", "to_symbol", "edge_type").distinct(), c)
    return E.expand_edges(seeds, e, c.where("name is not null")).select("id", "seed_rank", "similarity")


@query("""WITH one AS (SELECT regexp_extract(file_path, '^/ws/([^/]*)/', 1) AS r, name, min(file_path) AS a FROM chunks WHERE name IS NOT NULL AND source_kind = 'file' GROUP BY ALL HAVING min(file_path) = max(file_path))
SELECT edge_id, edge_type, coalesce(to_file, a) AS to_file, count(*) AS n FROM edges LEFT JOIN one ON r = regexp_extract(from_file, '^/ws/([^/]*)/', 1) AND name = to_symbol AND to_file IS NULL AND edge_type = 'call' GROUP BY ALL""")
def resolve_edges(spark, root):
    out = E.resolve_edges(table(spark, root, "edges"), table(spark, root, "chunks").select("file_path", "name", "source_kind"))
    return out.groupBy("edge_id", "edge_type", "to_file").agg(F.count("*").alias("n"))


# --- context and accounting


@query(f"""WITH d AS (SELECT source, doc_id, {_WC.format(t='text')} AS tokens FROM documents)
SELECT source, doc_id, used::BIGINT AS used FROM (SELECT *, sum(tokens) OVER w + 3 * (row_number() OVER w - 1) AS used FROM d WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE used <= 4096""")
def budget_fill(spark, root):
    d = table(spark, root, "documents").select("source", "doc_id", X.word_count(F.col("text")).alias("tokens"))
    return C.budget_fill(d, 4096, 3, ["source"], "doc_id").select("source", "doc_id", F.col("used").cast("bigint").alias("used"))


@query(f"SELECT chunk_type, sum({_WC.format(t='content')})::BIGINT AS tokens, count(DISTINCT file_path) AS files FROM chunks GROUP BY chunk_type")
def context_pool(spark, root):
    return table(spark, root, "chunks").groupBy("chunk_type").agg(F.sum(X.word_count(F.col("content"))).alias("tokens"), F.count_distinct("file_path").alias("files"))


def _baseline_sql(agg: str) -> str:
    return f"""WITH f AS (SELECT file_path, round({agg}(b), 9) AS b FROM (SELECT file_path, {_boost_sql(_QTOK)} AS b FROM chunks) WHERE b > 0 GROUP BY file_path ORDER BY b DESC, file_path LIMIT 5)
SELECT (coalesce(sum(coalesce(t, 0)), 0) + (1 + count(*)) * 300)::BIGINT AS base_tokens, count(*) AS n_files FROM f LEFT JOIN (SELECT path, max(token_count) AS t FROM manifest GROUP BY path) ON path = file_path"""


@query(_baseline_sql("sum"))
def grep_baseline_sum(spark, root):
    return C.reading_baseline(table(spark, root, "chunks").select("file_path", "name"), table(spark, root, "manifest"), QUESTION, "sum")


@query(_baseline_sql("max"))
def grep_baseline_max(spark, root):
    return C.reading_baseline(table(spark, root, "chunks").select("file_path", "name"), table(spark, root, "manifest"), QUESTION, "max")


_RAW = "CASE WHEN base > 0 THEN floor((1 - sent::DOUBLE / base) * 100 + 0.5) ELSE 0 END"


@query(f"SELECT session_id, sent, base, greatest(least({_RAW}, 98), 0)::INT AS pct, CASE WHEN {_RAW} >= 99 THEN 'filtering_only' ELSE 'full' END AS mode FROM (SELECT session_id, sum(tokens_sent)::BIGINT AS sent, coalesce(sum(tokens_estimated), 0)::BIGINT AS base FROM tool_calls GROUP BY session_id)")
def savings_metrics(spark, root):
    t = table(spark, root, "tool_calls").groupBy("session_id").agg(F.sum("tokens_sent").alias("sent"), F.coalesce(F.sum("tokens_estimated"), F.lit(0)).alias("base"))
    s, b = F.col("sent"), F.col("base")
    return t.select("session_id", "sent", "base", C.reduction(s, b).alias("pct"), C.savings_mode(s, b).alias("mode"))


@query(f"SELECT greatest(least(CASE WHEN raw > 0 THEN floor((1 - sent::DOUBLE / raw) * 100 + 0.5) ELSE 0 END, 100), -1000000)::INT AS reduction_pct, sent, raw FROM (SELECT (SELECT sum({_WC.format(t='content')}) FROM chunks WHERE chunk_type IN ('function', 'method'))::BIGINT AS sent, (SELECT sum(coalesce(token_count, 0)) FROM manifest)::BIGINT AS raw)")
def index_reduction(spark, root):
    sent = table(spark, root, "chunks").where(F.col("chunk_type").isin("function", "method")).agg(F.sum(X.word_count(F.col("content"))).alias("sent"))
    raw = table(spark, root, "manifest").agg(F.sum(F.coalesce("token_count", F.lit(0))).alias("raw"))
    return sent.join(raw, F.lit(True)).select(C.raw_reduction(F.col("sent"), F.col("raw")).alias("reduction_pct"), "sent", "raw")  # one row each


# --- incremental index

_STORED = "(SELECT path, sha256, size, mtime_ms, token_count FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at, sha256) AS rn FROM manifest) WHERE rn = 1)"
_CURRENT = "(SELECT path, sha256, size, mtime_ms, token_count FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, sha256) AS rn FROM manifest WHERE removed_at IS NULL) WHERE rn = 1)"


def _versions(spark, root) -> tuple[DataFrame, DataFrame]:
    m = table(spark, root, "manifest")
    first = S.dedup_first(m, "path", "indexed_at", "sha256")
    last = S.dedup_first(m.where("removed_at is null").withColumn("ago", -F.unix_micros("indexed_at")), "path", "ago", "sha256")
    return last, first


_DIFF = f"(SELECT coalesce(c.path, s.path) AS path, CASE WHEN s.path IS NULL THEN 'new' WHEN c.path IS NULL THEN 'removed' WHEN c.sha256 IS NOT DISTINCT FROM s.sha256 THEN 'unchanged' ELSE 'changed' END AS status FROM {_CURRENT} c FULL JOIN {_STORED} s ON c.path = s.path)"


@query(f"SELECT * FROM {_DIFF}")
def manifest_diff(spark, root):
    return I.diff(*_versions(spark, root)).select("path", "status")


@query(f"SELECT status, count(*) AS n FROM {_DIFF} GROUP BY status")
def diff_counts(spark, root):
    return I.diff(*_versions(spark, root)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT path, 'delete' AS action FROM {_DIFF} WHERE status IN ('removed', 'changed') UNION ALL SELECT path, 'process' FROM {_DIFF} WHERE status IN ('new', 'changed')")
def work_lists(spark, root):
    d = I.diff(*_versions(spark, root))
    return I.to_delete(d).withColumn("action", F.lit("delete")).unionByName(I.to_process(d).withColumn("action", F.lit("process")))


_STAT = f"(SELECT c.path, CASE WHEN c.size = s.size AND c.mtime_ms = s.mtime_ms THEN 'unchanged' ELSE 'changed' END AS stat, s.sha256 AS sha0, s.token_count AS tokens FROM {_CURRENT} c LEFT JOIN {_STORED} s ON c.path = s.path)"


@query(f"SELECT path, stat FROM {_STAT}")
def stat_partition(spark, root):
    cur, old = _versions(spark, root)
    return I.stat_partition(cur.select("path", "size", "mtime_ms"), old).select("path", "stat")


@query(f"SELECT path FROM {_STAT} WHERE stat = 'changed' OR sha0 IS NULL OR tokens IS NULL")
def files_to_read(spark, root):
    cur, old = _versions(spark, root)
    return I.stat_partition(cur.select("path", "size", "mtime_ms"), old).where(I.needs_read()).select("path")


@query(f"SELECT c.path, coalesce(c.token_count, s.token_count) AS token_count FROM {_CURRENT} c LEFT JOIN {_STORED} s ON c.path = s.path")
def manifest_merge(spark, root):
    cur, old = _versions(spark, root)
    return I.carry_forward(cur.select("path"), old, cur, "token_count")


@query(f"SELECT sum(coalesce(token_count, 0))::BIGINT AS total, count(*) AS files FROM {_CURRENT}")
def total_tokens(spark, root):
    return _versions(spark, root)[0].agg(F.sum(F.coalesce("token_count", F.lit(0))).alias("total"), F.count("*").alias("files"))


@query(f"SELECT count_if(n <= 8192)::BIGINT AS kept, count_if(n > 8192)::BIGINT AS skipped FROM (SELECT {_WC.format(t='content')} * 10 AS n FROM chunks)")
def embed_size_filter(spark, root):
    n = X.word_count(F.col("content")) * 10
    return table(spark, root, "chunks").agg(F.count_if(n <= 8192).alias("kept"), F.count_if(n > 8192).alias("skipped"))


@query("SELECT count_if(vector IS NULL)::BIGINT AS missing, count_if(len(list_filter(vector, lambda x: x <> 0)) = 0)::BIGINT AS zero, count(*) AS rows FROM chunks")
def zero_guard(spark, root):
    v = F.col("vector")
    return table(spark, root, "chunks").agg(F.count_if(v.isNull()).alias("missing"), F.count_if(~non_zero(v)).alias("zero"), F.count("*").alias("rows"))


@query("SELECT n_newer, p AS newest_path, m AS newest_mtime FROM (SELECT count(*) AS n_newer, min((-mtime_ms, path))[2] AS p, max(mtime_ms) AS m FROM manifest WHERE mtime_ms > (SELECT avg(mtime_ms) FROM manifest))")
def staleness(spark, root):
    m = table(spark, root, "manifest")
    return I.staleness(m, m.agg(F.avg("mtime_ms")).first()[0] or 0.0)


# --- sessions and events


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(called_at) - epoch_us(lag(called_at) OVER w) <= 7200000000 THEN 0 ELSE 1 END AS st FROM tool_calls WINDOW w AS (PARTITION BY session_id ORDER BY called_at, call_id)),
s AS (SELECT *, sum(st) OVER (PARTITION BY session_id ORDER BY called_at, call_id) AS session_no FROM g)
SELECT session_id, session_no::BIGINT AS session_no, sum(coalesce(tokens_sent, 0))::BIGINT AS tokens_sent, sum(coalesce(tokens_estimated, 0))::BIGINT AS tokens_estimated, count(*) AS calls, epoch_us(max(called_at)) AS last_us,
 arg_max(coalesce(tokens_sent, 0), (called_at, call_id)) AS last_sent, arg_max(coalesce(tokens_estimated, 0), (called_at, call_id)) AS last_estimated FROM s GROUP BY session_id, session_no""")
def session_totals(spark, root):
    out = K.session_totals(table(spark, root, "tool_calls"), "session_id", "called_at", 7200, "tokens_sent", "tokens_estimated", "call_id")
    return out.withColumn("last_us", micros("last_at")).drop("last_at")


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 600000000 THEN 0 ELSE 1 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g)
SELECT user_id, count(*) AS n_events, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM s GROUP BY user_id, no""")
def debounce_bursts(spark, root):
    out = K.bursts(table(spark, root, "events"), "user_id", "ts", 600)
    return out.select("user_id", "n_events", micros("first_at").alias("first_us"), micros("last_at").alias("last_us"))


@query(f"""SELECT session_id, CASE WHEN pct <= 0 OR saved <= 0 THEN 'idle' ELSE pct || '%' END AS shown FROM (SELECT session_id, least(98, CASE WHEN base > 0 THEN floor((1 - sent::DOUBLE / base) * 100 + 0.5) ELSE 0 END)::INT AS pct, base - sent AS saved
FROM (SELECT session_id, sum(tokens_sent)::BIGINT AS sent, coalesce(sum(tokens_estimated), 0)::BIGINT AS base FROM tool_calls GROUP BY session_id))""")
def status_line(spark, root):
    t = table(spark, root, "tool_calls").groupBy("session_id").agg(F.sum("tokens_sent").alias("sent"), F.coalesce(F.sum("tokens_estimated"), F.lit(0)).alias("base"))
    pct = F.least(F.lit(C.MAX_PCT), C.raw_reduction(F.col("sent"), F.col("base")))
    return t.select("session_id", F.when((pct <= 0) | (F.col("base") - F.col("sent") <= 0), "idle").otherwise(F.concat(pct.cast("string"), F.lit("%"))).alias("shown"))


_LOG = "CASE WHEN len(files) > 1 THEN 'incremental index -- ' || len(files) || ' new, 2 changed, 0 removed' ELSE 'full index' END"


@query(f"SELECT DISTINCT short_hash, 're-indexed ' || CASE WHEN contains(log, 'incremental index --') THEN '(' || regexp_extract(log, '(\\d+ new, \\d+ changed, \\d+ removed)', 1) || ') ' ELSE '' END || 'in 1.2s' AS summary FROM (SELECT short_hash, {_LOG} AS log FROM commits)")
def watch_summary(spark, root):
    log = F.when(F.size("files") > 1, F.concat(F.lit("incremental index -- "), F.size("files").cast("string"), F.lit(" new, 2 changed, 0 removed"))).otherwise("full index")
    return table(spark, root, "commits").select("short_hash", Wa.summary(log, F.lit("1.2")).alias("summary")).distinct()
