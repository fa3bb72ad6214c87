"""Filling containers of fixed capacity with documents sized in tokens.

Patterns of up to three lengths that fill a container exactly are enumerated; how often each is used is fitted to the
histogram of lengths by non-negative least squares and rounded; what remains is packed by best fit, decreasing, with many
equal containers at a time. All of that works on the histogram, whose size is the capacity, never on the documents. The
documents then find their places by their rank among those of their length: ranks are built from counts by (length, salt),
so a length that a third of all documents have is ranked in many tasks, the more the more documents there are.

A text over the capacity fills whole containers of its own, and its rest is an item like others; no other is split.
Defined results: null and empty texts come out with 0 tokens and no container; repeated texts are placed each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.bpe import count_tokens
from strataloom.session import stage_table

SALTS = 64, 1024  # least and most parts of the documents of a length; in between one for each PART documents
PART = 100_000


def patterns(capacity: int) -> np.ndarray:
    """All (a >= b >= c) with a + b + c = capacity, c and b possibly 0: one row each."""
    rows = [np.array([[capacity, 0, 0]])]
    for a in range(capacity - 1, (capacity - 1) // 3, -1):
        rest = capacity - a
        b = np.arange(min(a, rest), (rest - 1) // 2, -1)
        b = b[(b >= rest - b)]
        rows.append(np.stack([np.full(len(b), a), b, rest - b], axis=1))
    return np.concatenate(rows)


def fit_counts(hist: np.ndarray, pats: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative x that minimises sum_L w_L ((A x)_L - hist_L)^2 by accelerated projected gradient; longer lengths weigh more."""
    n = len(hist)
    weight = np.linspace(0.1, 1.0, n)
    weight[0] = 0.0
    scale = max(1.0, float(hist.max(initial=0)))
    h = hist / scale
    flat = pats.ravel()

    def uses(x):  # A x
        return np.bincount(flat, weights=np.repeat(x, 3), minlength=n)

    def slope(r):  # A' r
        return r[pats].sum(axis=1)

    v = np.ones(len(pats))
    for _ in range(12):
        v = slope(weight * uses(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1.0 / (1.05 * norm)
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        nxt = np.maximum(0.0, y - step * slope(weight * (uses(y) - h)))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x * scale


def plan(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a container, number of such containers) that together hold every item of ``hist`` (index = length)."""
    capacity = len(hist) - 1
    left = hist.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    if left.sum():
        pats = patterns(capacity)
        pats = pats[np.all((left[pats] > 0) | (pats == 0), axis=1)]
        if len(pats):
            want = np.floor(fit_counts(left.astype(np.float64), pats) + 0.5).astype(np.int64)
            for i in np.argsort(-want, kind="stable"):
                if want[i] <= 0:
                    break
                lengths, times = np.unique(pats[i][pats[i] > 0], return_counts=True)
                n = int(min(want[i], (left[lengths] // times).min()))
                if n > 0:
                    left[lengths] -= times * n
                    out.append((tuple(int(x) for x in pats[i] if x > 0), n))
    # Best fit, decreasing: open containers by free space, as stacks of (contents, count).
    room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        n = int(left[length])
        free = length
        while n:
            while free <= capacity and not room[free]:
                free += 1
            if free > capacity:
                # New containers, each taking as many of this length as fit.
                each = capacity // length
                full, rest = divmod(n, each)
                if full:
                    room[capacity - each * length].append(((length,) * each, full))
                if rest:
                    room[capacity - rest * length].append(((length,) * rest, 1))
                break
            has, count = room[free].pop()
            each = min(free // length, n)
            take = min(count, max(1, n // each))
            if count > take:
                room[free].append((has, count - take))
            room[free - each * length].append((has + (length,) * each, take))
            n -= each * take
            free = length
    return out + [entry for stack in room for entry in stack]


def places(containers: list[tuple[tuple[int, ...], int]], first: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: rank at which each run of places begins, places a container has in it, number of its first container."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    at: dict[int, int] = {}
    for lengths, count in containers:
        for length in set(lengths):
            each = lengths.count(length)
            runs.setdefault(length, []).append((at.get(length, 0), each, first))
            at[length] = at.get(length, 0) + each * count
        first += count
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v)) for k, v in runs.items()}


def pack_documents(documents: DataFrame, capacity: int = 1024, path: str | None = None) -> DataFrame:
    """(doc_id, piece, n_tokens, container_id): one row a document, more if it alone exceeds ``capacity``."""
    spark = documents.sparkSession
    sizes = stage_table(count_tokens(documents, path), "sizes")
    salts = min(SALTS[1], max(SALTS[0], sizes.count() // PART))
    sized = sizes.withColumn("rest", F.pmod("n_tokens", F.lit(capacity))).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    whole = sized.where(F.col("n_tokens") >= capacity).withColumn("full", (F.col("n_tokens") / capacity).cast("int"))
    # At most capacity x salts rows reach the driver.
    counted = np.zeros((capacity + 1, salts), dtype=np.int64)
    for rest, salt, n in sized.where("rest > 0").groupBy("rest", "salt").count().collect():
        counted[rest, salt] = n
    containers = plan(counted.sum(axis=1))
    table = places(containers, 0)
    made = int(sum(n for _, n in containers))
    offset = np.cumsum(counted, axis=1) - counted
    rank = Window.partitionBy("rest", "salt").orderBy("doc_id", "n_tokens")
    items = sized.where("rest > 0").withColumn("nth", F.row_number().over(rank) - 1)

    def place(batches):
        for pdf in batches:
            length, nth = pdf["rest"].to_numpy(), pdf["nth"].to_numpy() + offset[pdf["rest"].to_numpy(), pdf["salt"].to_numpy()]
            home = np.empty(len(pdf), dtype=np.int64)
            for one in np.unique(length):
                begin, each, first = table[int(one)]
                mine = np.flatnonzero(length == one)
                run = np.searchsorted(begin, nth[mine], side="right") - 1
                home[mine] = first[run] + (nth[mine] - begin[run]) // each[run]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "piece": (pdf["n_tokens"] // capacity).astype("int32"), "n_tokens": pdf["rest"].astype("int32"), "container_id": home})

    rests = items.select("doc_id", "n_tokens", "rest", "salt", "nth").mapInPandas(place, "doc_id bigint, piece int, n_tokens int, container_id bigint")
    # Containers of texts that fill them alone are numbered by the text's rank within its salt, salts interleaved.
    per_salt = {r["salt"]: r["n"] for r in whole.groupBy("salt").agg(F.sum("full").alias("n")).collect()}
    base, run = [], made
    for s in range(salts):
        base.append(run)
        run += int(per_salt.get(s, 0))
    before = F.sum("full").over(Window.partitionBy("salt").orderBy("doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)) - F.col("full")
    start = F.element_at(F.array(*[F.lit(b) for b in base]), F.col("salt") + 1) + before
    numbered = whole.withColumn("c0", start)  # before the rows are multiplied
    alone = numbered.select("doc_id", "c0", F.posexplode(F.array_repeat(F.lit(capacity), F.col("full"))).alias("piece", "n_tokens"))
    alone = alone.select("doc_id", "piece", "n_tokens", (F.col("c0") + F.col("piece")).cast("bigint").alias("container_id"))
    none = sized.where("n_tokens = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).alias("n_tokens"), F.lit(None).cast("bigint").alias("container_id"))
    return rests.unionByName(alone).unionByName(none)
