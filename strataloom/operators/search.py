"""Top-k by cosine, hybrid re-ranking, keyword search, first-of-id dedup and the test-file filter.

Rank is carried as an explicit column, since rows have no order. Ties: smaller id first.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import ranking as R
from strataloom.functions import text as X
from strataloom.functions.vector import cosine_distance, non_zero


def vector_topk(rows: DataFrame, vector: str, query: list[float], k: int, id_col: str = "id") -> DataFrame:
    """The k rows nearest to ``query`` with ``dist``; rows whose vector is null, zero or of another length have none and rank last-out.

    TakeOrderedAndProject: each task keeps k rows, so only k rows a task are moved. An empty table gives no rows.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("dist", cosine_distance(F.col(vector), q)).where(F.col("dist").isNotNull()).orderBy("dist", id_col).limit(k)


TILE = 1 << 22  # cosines that a task holds at a time


def vector_topk_batch(rows: DataFrame, queries: DataFrame, k: int, block: int = 8192) -> DataFrame:
    """(qid, id, dist, rank): top k of ``rows(id, vec)`` for every row of ``queries(qid, qvec)``, a stated set of queries.

    Queries go to the tasks as a matrix, in blocks of at most about ``block`` by hash, however many there are; each task multiplies its rows
    with it and sends k rows a query, however many rows it compares. Vectors that are null, zero, not finite or of another length than
    the query have no distance. No queries give no rows.
    """
    n = max(1, -(-queries.count() // block))
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, dist double"
    w = Window.partitionBy("qid").orderBy("dist", "id")

    def best(some: DataFrame) -> DataFrame:
        asked = some.select("qid", "qvec").where("qvec is not null").collect()  # one block
        near = rows.select("id", "vec").mapInPandas(_nearest([r["qid"] for r in asked], [list(r["qvec"]) for r in asked], k), kinds)
        return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    if n == 1:
        return best(queries)
    return reduce(DataFrame.unionByName, [best(queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i)) for i in range(n)])


def _units(vectors: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and unit vectors of those that are finite, not zero, and of length ``dim``."""
    at = [i for i, v in enumerate(vectors) if v is not None and len(v) == dim and not any(x is None for x in v)]
    m = np.array([vectors[i] for i in at], dtype=np.float64).reshape(len(at), dim)
    size = np.sqrt(np.einsum("ij,ij->i", m, m))
    good = np.isfinite(size) & (size > 0)
    return np.array(at, dtype=np.int64)[good], m[good] / size[good][:, None]


def _nearest(qids: list, vectors: list, k: int):
    """The k nearest rows of a task for each query, ties by smaller id."""
    by_dim = {d: _units(vectors, d) for d in {len(v) for v in vectors} if d}

    def cut(found: list) -> pd.DataFrame:
        return pd.concat(found).sort_values(["q", "dist", "id"], kind="stable").groupby("q", sort=False).head(k)

    def run(batches):
        kept: list = []
        for pdf in batches:
            given, ids = [None if v is None else v for v in pdf["vec"]], pdf["id"].to_numpy()
            for dim, (asked, unit) in by_dim.items():
                at, mine = _units(given, dim)
                step = max(1, TILE // max(1, len(at)))
                for lo in range(0, len(asked) if len(at) else 0, step):
                    dist = np.round(1 - unit[lo : lo + step] @ mine.T, 12) + 0.0
                    bar = np.partition(dist, min(k, len(at)) - 1, axis=1)[:, min(k, len(at)) - 1]
                    q, r = np.nonzero(dist <= bar[:, None])
                    kept.append(pd.DataFrame({"q": asked[lo + q], "id": ids[at[r]], "dist": dist[q, r]}))
            if sum(map(len, kept)) > 4 * k * len(qids) + 100_000:
                kept = [cut(kept)]
        if kept:
            out = cut(kept)
            yield pd.DataFrame({"qid": [qids[i] for i in out["q"]], "id": out["id"], "dist": out["dist"]})

    return run


def after_limit(hits: DataFrame, threshold: float, vector: str | None = None) -> DataFrame:
    """Distance threshold and zero-vector guard, applied after the limit, so fewer than k rows may remain; adds similarity."""
    out = hits.where(F.col("dist") <= threshold)
    if vector:
        out = out.where(non_zero(F.col(vector)))
    return out.withColumn("similarity", 1 - F.col("dist"))


def hybrid_rerank(hits: DataFrame, query: str, weight: float = 0.10) -> DataFrame:
    """Score of similarity and keyword boost less the penalties; the shown similarity of a boosted row is at least 0.85.

    Without a token in the query the order is by similarity alone. Null names count as no name. ``rank`` starts at 1.
    """
    q = F.lit(query)
    tokens = X.query_tokens(q)
    boost = R.keyword_boost(tokens, F.col("file_path"), F.col("name"))
    score = F.col("similarity") * (1 - weight) + F.col("boost") * weight - R.config_penalty(F.col("file_path"), q) - R.test_penalty(F.col("file_path"), q) - R.history_penalty(F.col("source_kind"))
    scored = hits.withColumn("boost", boost).withColumn("score", F.when(F.size(tokens) > 0, score).otherwise(F.col("similarity")))
    raised = scored.withColumn("similarity", F.when((F.size(tokens) > 0) & (F.col("boost") > 0), F.greatest("similarity", F.lit(R.BOOSTED))).otherwise(F.col("similarity")))
    w = Window.orderBy(F.desc("score"), "dist", "id")  # over at most k rows, the top-k of before
    return raised.withColumn("rank", F.row_number().over(w))


def keyword_rows(chunks: DataFrame, query: str) -> DataFrame:
    """Chunks that hold a token in path, name or content (case as it is), with the score of file name and name; score 0 is dropped."""
    tokens = X.query_tokens(F.lit(query))
    hit = F.exists(tokens, lambda t: F.col("file_path").contains(t) | F.coalesce(F.col("name").contains(t), F.lit(False)) | F.col("content").contains(t))
    return chunks.where(hit).withColumn("score", R.keyword_boost(tokens, F.col("file_path"), F.col("name"))).where(F.col("score") > 0)


def keyword_search(chunks: DataFrame, query: str, limit: int) -> DataFrame:
    """The ``limit`` best by score; ties by id, then start line and content, so that the result is fixed."""
    return keyword_rows(chunks, query).orderBy(F.desc("score"), "id", "start_line", "content").limit(limit)


def dedup_first(rows: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The first row of each key in the given order. A null key is a key of its own.

    A key that holds a third of all rows doesn't reach one task as it is: each partition first keeps its own first row.
    """
    tie = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    cols = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(F.col(key).alias("__key")).agg(F.min_by(cols, tie).alias("__r")).select("__r.*")


def test_filter(rows: DataFrame, query: str, min_total: int = 3) -> DataFrame:
    """Keeps non-test rows; pads with the first test rows up to ``min_total``; unchanged if the query is about tests or only tests exist.

    ``rank`` in, ``rank`` out (non-test first). The input is a result list of bounded length, hence one window.
    """
    flagged = rows.withColumn("is_test", R.test_path(F.col("file_path")))
    everything = Window.partitionBy()
    n = flagged.withColumn("plain", F.count_if(~F.col("is_test")).over(everything)).withColumn("nth", F.row_number().over(Window.partitionBy("is_test").orderBy("rank")))
    asked = R.test_intent(F.lit(query))
    keep = asked | (F.col("plain") == 0) | ~F.col("is_test") | ((F.col("plain") < min_total) & (F.col("nth") <= min_total - F.col("plain")))
    kept = n.where(keep).withColumn("last", F.when(asked, F.lit(False)).otherwise(F.col("is_test")))
    return kept.withColumn("rank", F.row_number().over(Window.orderBy("last", "rank"))).drop("is_test", "plain", "nth", "last")
