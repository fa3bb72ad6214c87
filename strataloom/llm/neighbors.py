"""The k most similar vectors of every vector by a block matrix join over clusters.

Equal vectors form one class (its k + 1 smallest ids stand for it: with ties going to smaller ids, no other of its ids can
be among any k nearest). Classes are ordered by cluster (spherical k-means on at most ``SAMPLE`` classes; every class is
assigned) and put into blocks of about ``block_rows``: several small clusters, or a part of a large one. A class meets those of
the ``probes`` clusters nearest to it; what it meets is found for both sides. A tile
of integer products of int8 codes (exact in float32) gives every cosine up to an error bound; only pairs that the bound
lets into a row's best so far are computed from the floats. Each task keeps a bounded sorted list a row, merged at the end:
rows of one tile come in at once, for which a sorted merge in numpy is faster than a heap a row.

After its own block a class has a bar, and leaves out a probed cluster if a vector that beats the bar would have to lie across the
boundary of the clusters by more than ``SPREAD`` deviations of a random direction (in exact mode: by more than its distance).
A block sends a class once to each block it still probes, with its bar, so messages are at most ``probes`` copies of the data;
a block that very many classes visit is joined in slices. There are about sqrt(classes) / 7 clusters, so the products grow as the
classes to the power 1.5. Up to ``probes`` clusters (about 12,500 classes) the result is exact; ``probes=None`` is exact always, at
quadratic work.

Defined results: vectors that are null, all zero, hold a null, NaN or infinity or have another length are left out, null ids too;
an id with several vectors has the neighbours of each; fewer than k + 1 ids give all pairs there are; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.session import stage_table

ROWS, COLS = 512, 2048  # a tile that stays in the cache
SLACK = 1e-5  # of the float32 scaling of a tile
PROBES, SPREAD = 16, 2.0
SAMPLE, ROUNDS = 65_536, 8  # classes that the clusters are fitted on, and rounds of that
CLUSTERS = 2_048  # most clusters; beyond, clusters grow
VISITORS = 131_072  # visiting classes of a block that one task takes
SALTS = 8


def _units(flat: np.ndarray) -> np.ndarray:
    v = flat.astype(np.float64)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


class Codes:
    """int8 codes of unit vectors, with their scale and the norm of what they miss."""

    def __init__(self, units: np.ndarray):
        self.scale = np.abs(units).max(axis=1) / 127.0
        code = np.rint(units / self.scale[:, None])
        near = code * self.scale[:, None]
        self.miss = np.sqrt(((units - near) ** 2).sum(axis=1))
        self.size = np.sqrt((near**2).sum(axis=1))
        self.code = code.astype(np.int8)

    def take(self, rows: np.ndarray) -> Codes:
        some = object.__new__(Codes)
        some.scale, some.miss, some.size, some.code = self.scale[rows], self.miss[rows], self.size[rows], self.code[rows]
        return some


def products(a: Codes, rows: slice, b: Codes, cols: slice) -> np.ndarray:
    """Cosines of the coded vectors: integer products (up to 127 x 127 x length, exact in float32 below 2^24), then scaled."""
    tile = a.code[rows].astype(np.float32) @ b.code[cols].astype(np.float32).T
    tile *= a.scale[rows].astype(np.float32)[:, None]
    tile *= b.scale[cols].astype(np.float32)[None, :]
    return tile


class Best:
    """The ``keep`` best (similarity, class) of each row that reach its bar; equal similarities by smaller class number."""

    def __init__(self, n: int, keep: int, bar: np.ndarray | None = None):
        self.keep = keep
        self.bar = np.full(n, -np.inf) if bar is None else bar.copy()
        self.sim = np.full((n, keep), -np.inf)
        self.who = np.full((n, keep), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, sims: np.ndarray, who: np.ndarray) -> None:
        """Candidates of any rows, in any order; each row's best and new ones are merged, and its bar is raised."""
        ok = sims >= self.bar[rows]
        rows, sims, who = rows[ok], sims[ok], who[ok]
        if not len(rows):
            return
        order = np.lexsort((who, -sims, rows))
        rows, sims, who = rows[order], sims[order], who[order]
        first = np.r_[True, rows[1:] != rows[:-1]]
        place = np.arange(len(rows)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        kept = place < self.keep
        rows, sims, who, place = rows[kept], sims[kept], who[kept], place[kept]
        touched = np.unique(rows)
        at = np.searchsorted(touched, rows)
        s = np.concatenate([self.sim[touched], np.full((len(touched), self.keep), -np.inf)], axis=1)
        w = np.concatenate([self.who[touched], np.full((len(touched), self.keep), np.iinfo(np.int64).max)], axis=1)
        s[at, self.keep + place], w[at, self.keep + place] = sims, who
        o = np.lexsort((w, -s), axis=1)[:, : self.keep]
        self.sim[touched], self.who[touched] = np.take_along_axis(s, o, 1), np.take_along_axis(w, o, 1)
        self.bar[touched] = np.maximum(self.bar[touched], self.sim[touched, -1])


def _exact(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray):
    """Similarities of the pairs, a slice at a time."""
    for s in range(0, len(x), 1 << 18):
        i, j = x[s : s + (1 << 18)], y[s : s + (1 << 18)]
        yield i, j, np.round(np.einsum("ij,ij->i", a[i], b[j]), 12)


class Side:
    """Rows of one side of a block pair: unit vectors, codes, class numbers, home clusters and probed clusters."""

    def __init__(self, mat: np.ndarray, ids: np.ndarray, home: np.ndarray, probes: np.ndarray):
        self.units, self.ids, self.home, self.probes = _units(mat), ids, home, probes
        self.codes = Codes(self.units)


def visit(a: Side, best_a: Best, b: Side, best_b: Best) -> None:
    """Lets the rows of ``a`` meet the rows of ``b`` in the clusters they probe; a row of ``b`` learns of one only if it won't visit that one's cluster.

    Of a block with itself, rows meet those of their home first, which sets their bars.
    """
    within = a is b
    for cluster, near in [(c, near) for near in ((True, False) if within else (False,)) for c in np.unique(b.home)]:
        asked = a.home == cluster if near else (a.probes == cluster).any(axis=1) & (a.home != cluster if within else True)
        come, here = np.flatnonzero(asked), np.flatnonzero(b.home == cluster)
        if not len(come):
            continue
        ca, cb, keep = a.codes.take(come), b.codes.take(here), best_a.keep
        for lo in range(0, len(come), ROWS):
            hi = min(lo + ROWS, len(come))
            rows = come[lo:hi]
            for left in range(0, len(here), COLS):
                right = min(left + COLS, len(here))
                cols = here[left:right]
                tile = products(ca, slice(lo, hi), cb, slice(left, right))
                # |a.b - a'.b'| <= miss(a) + size(a') miss(b), here with the largest of the other side.
                off_a = ca.miss[lo:hi] + ca.size[lo:hi] * cb.miss[left:right].max() + SLACK
                if near:
                    both = np.arange(max(lo, left), min(hi, right))
                    tile[both - lo, both - left] = -2
                    if left == 0 and right - left > keep:
                        best_a.bar[rows] = np.partition(tile, right - left - keep, axis=1)[:, right - left - keep] - off_a
                hit = tile >= (best_a.bar[rows] - off_a).astype(np.float32)[:, None]
                if not near:
                    off_b = cb.miss[left:right] + cb.size[left:right] * ca.miss[lo:hi].max() + SLACK
                    hit |= tile >= (best_b.bar[cols] - off_b).astype(np.float32)[None, :]
                x, y = np.divmod(np.flatnonzero(hit), right - left)
                if near:
                    apart = rows[x] != cols[y]
                    x, y = x[apart], y[apart]
                for i, j, sims in _exact(a.units, rows[x], b.units, cols[y]):
                    best_a.add(i, sims, b.ids[j])
                    if not near:
                        untold = ~(b.probes[j] == a.home[i][:, None]).any(axis=1)
                        best_b.add(j[untold], sims[untold], a.ids[i[untold]])


_BEST = pa.schema([("cls", pa.int64()), ("sims", pa.list_(pa.float64())), ("near", pa.list_(pa.int64()))])


def _rows(ids: np.ndarray, best: Best) -> pa.Table:
    """Rows whose list holds anything."""
    live = np.isfinite(best.sim)
    some = live.any(axis=1)
    ends = pa.array(np.r_[0, np.cumsum(live[some].sum(axis=1))].astype(np.int32))
    return pa.Table.from_arrays([pa.array(ids[some]), pa.ListArray.from_arrays(ends, pa.array(best.sim[some][live[some]])), pa.ListArray.from_arrays(ends, pa.array(best.who[some][live[some]]))], schema=_BEST)


# --- classes of equal vectors


def _heads(dim: int, keep: int | None):
    """(vec, id) of usable rows; of each vector of a batch the ``keep`` smallest ids."""

    def run(batches):
        for batch in batches:
            vectors, ids = batch.column(1), batch.column(0)
            fit = pc.and_(pc.and_(pc.is_valid(ids), pc.is_valid(vectors)), pc.equal(pc.list_value_length(vectors), dim))
            some = batch.filter(pc.fill_null(fit, False))
            flat = some.column(1).flatten()
            mat = np.nan_to_num(flat.to_numpy(zero_copy_only=False).astype(np.float32), nan=np.inf).reshape(-1, dim)
            good = np.isfinite(mat).all(axis=1) & (mat != 0).any(axis=1)
            by: dict[bytes, set[str]] = {}
            for i, v in zip(some.column(0).filter(pa.array(good)).to_pylist(), mat[good]):
                by.setdefault(v.tobytes(), set()).add(i)
            kept = [(v, i) for v, own in by.items() for i in (own if keep is None else heapq.nsmallest(keep, own))]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in kept], pa.binary()), pa.array([i for _, i in kept], pa.string())], ["vec", "id"])

    return run


# --- clusters, and the layout of blocks


def fit_centers(units: np.ndarray, clusters: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from evenly taken rows; an empty cluster keeps its centre."""
    c = units[np.linspace(0, len(units) - 1, clusters).astype(np.int64)].copy()
    for _ in range(rounds if clusters > 1 else 0):
        at = nearest_centers(units, c, 1)[:, 0]
        total = np.zeros_like(c)
        np.add.at(total, at, units)
        size = np.sqrt((total**2).sum(axis=1))
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1e-300)[:, None], c)
    return c


def nearest_centers(units: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` centres nearest to each row, nearest first, equal ones by number."""
    out = np.empty((len(units), n), dtype=np.int16)
    for lo in range(0, len(units), 4096):
        s = units[lo : lo + 4096] @ centers.T
        if n < len(centers):
            part = np.sort(np.argpartition(-s, n - 1, axis=1)[:, :n], axis=1)
            out[lo : lo + 4096] = np.take_along_axis(part, np.argsort(-np.take_along_axis(s, part, 1), axis=1, kind="stable"), 1)
        else:
            out[lo : lo + 4096] = np.argsort(-s, axis=1, kind="stable")
    return out


class Layout:
    """Which blocks hold a cluster: one with its neighbours, or several parts of a large one; and the slices of each block's visitors."""

    def __init__(self, centers: np.ndarray, homes: np.ndarray, visits: np.ndarray, block_rows: int, visitors: int):
        self.centers = centers
        self.first = np.zeros(len(centers), dtype=np.int64)
        self.parts = np.maximum(1, -(-homes // block_rows))
        order, left = [0], set(range(1, len(centers)))
        while left:  # a chain of near centres, so that the clusters of a block are probed together
            rest = np.array(sorted(left))
            order.append(int(rest[np.argmax(centers[rest] @ centers[order[-1]])]))
            left.remove(order[-1])
        at, held, came, visited, total = 0, 0, 0, [], int(homes.sum())
        for c in order:
            if held and held + homes[c] > block_rows:
                visited.append(min(came, total))
                at, held, came = at + 1, 0, 0
            self.first[c] = at
            if self.parts[c] > 1:
                visited += [int(visits[c])] * int(self.parts[c])
                at += int(self.parts[c])
            else:
                held, came = held + int(homes[c]), came + int(visits[c])
        self.slices = np.maximum(1, -(-np.array([*visited, min(came, total), 0]) // visitors))

    def home(self, cluster: np.ndarray, vectors: list[bytes]) -> np.ndarray:
        """Block of each class; of a large cluster, the part goes by the vector's hash."""
        out = self.first[cluster]
        for i in np.flatnonzero(self.parts[cluster] > 1):
            out[i] += xxhash.xxh64_intdigest(vectors[i]) % int(self.parts[cluster[i]])
        return out


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, dim)


def _tally(centers: np.ndarray, probes: int, dim: int):
    """Classes that live in each cluster, and that visit it."""

    def run(batches):
        homes, visits = np.zeros(len(centers), dtype=np.int64), np.zeros(len(centers), dtype=np.int64)
        for batch in batches:
            near = nearest_centers(_units(_matrix(batch.column(0), dim)), centers, probes)
            homes += np.bincount(near[:, 0], minlength=len(centers))
            visits += np.bincount(near.ravel(), minlength=len(centers))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centers))), pa.array(homes), pa.array(visits)], ["c", "homes", "visits"])

    return run


def _assign(layout: Layout, probes: int, dim: int):
    def run(batches):
        for batch in batches:
            near = nearest_centers(_units(_matrix(batch.column(1), dim)), layout.centers, probes)
            asked = pa.array([row.tobytes() for row in near], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(layout.home(near[:, 0], batch.column(1).to_pylist()), pa.int64()), batch.column(0), batch.column(1), asked], ["block", "cls", "mat", "probes"])

    return run


def _joined(column: pa.ChunkedArray, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


_MESSAGE = "target bigint, slice int, source bigint, cls binary, mat binary, bar binary, probes binary, sims binary, near binary"


def skipped(units: np.ndarray, bar: np.ndarray, asked: np.ndarray, centers: np.ndarray, reach: float) -> np.ndarray:
    """Which probed clusters a row leaves out. A vector y of cluster c with centre c is nearer to c than to the row's centre h, so
    x.(h - c) <= (x - y).(h - c) <= |x - y| |h - c| for all y, and <= ``reach`` |x - y| |h - c| for most in a random direction."""
    far = np.sqrt(np.maximum(0.0, 2 - 2 * np.where(np.isfinite(bar), bar, -1.0)))
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * centers @ centers.T))
    near = np.take_along_axis(units @ centers.T, asked.astype(np.int64), 1)
    return near[:, :1] - near > reach * far[:, None] * apart[asked[:, :1], asked] + 1e-9


def _within(layout: Layout, probes: int, dim: int, keep: int, reach: float):
    """A block's own pairs; then one message to itself (a slice each) and one to each block that its rows probe."""

    def run(block: pa.Table) -> pa.Table:
        own = block.column("block")[0].as_py()
        asked = _joined(block.column("probes"), np.int16, probes)
        cls = block.column("cls").to_numpy()
        order = np.lexsort((cls, asked[:, 0]))
        cls, asked, mat = cls[order], asked[order], _joined(block.column("mat"), np.float32, dim)[order]
        best, side = Best(len(cls), keep), Side(mat, cls, asked[:, 0], asked)
        visit(side, best, side, best)
        bar = best.sim[:, -1]
        asked = asked.copy()
        first, parts = layout.first[asked], layout.parts[asked]
        out_of = ((first != own) | (parts > 1)) & skipped(side.units, bar, asked, layout.centers, reach)
        asked[out_of] = -1
        out = [(own, s, own, cls.tobytes(), mat.tobytes(), bar.tobytes(), asked.tobytes(), best.sim.tobytes() if s == 0 else b"", best.who.tobytes() if s == 0 else b"") for s in range(int(layout.slices[own]))]
        first, parts = np.where(out_of, -1, first), np.where(out_of, 0, parts)
        for target in sorted({b for f, n in set(zip(first.ravel().tolist(), parts.ravel().tolist())) for b in range(f, f + n)} - {own}):
            go = ((first <= target) & (target < first + parts)).any(axis=1)
            out.append((target, own % int(layout.slices[target]), own, cls[go].tobytes(), mat[go].tobytes(), bar[go].tobytes(), asked[go].tobytes(), b"", b""))
        kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 6]
        return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=[f.split()[0] for f in _MESSAGE.split(", ")])

    return run


def _between(probes: int, dim: int, keep: int):
    """Best of the visitors of a block, and of the block's own rows."""

    def side(m: dict) -> Side:
        asked = np.frombuffer(m["probes"], dtype=np.int16).reshape(-1, probes)
        return Side(np.frombuffer(m["mat"], dtype=np.float32).reshape(-1, dim), np.frombuffer(m["cls"], dtype=np.int64), asked[:, 0], asked)

    def run(messages: pa.Table) -> pa.Table:
        rows = sorted(messages.to_pylist(), key=lambda m: m["source"])
        own = next((m for m in rows if m["source"] == m["target"]), None)
        if own is None:  # a probed cluster in which no class lives
            return _BEST.empty_table()
        b, out = side(own), []
        best_b = Best(len(b.ids), keep, np.frombuffer(own["bar"], dtype=np.float64))
        for m in rows:
            if m is not own:
                a = side(m)
                best_a = Best(len(a.ids), keep, np.frombuffer(m["bar"], dtype=np.float64))
                visit(a, best_a, b, best_b)
                out.append(_rows(a.ids, best_a))
        out.append(_rows(b.ids, best_b))
        if own["sims"]:
            mine = Best(len(b.ids), keep)
            mine.sim, mine.who = (np.frombuffer(own[k], dtype=t).reshape(-1, keep) for k, t in (("sims", np.float64), ("near", np.int64)))
            out.append(_rows(b.ids, mine))
        return pa.concat_tables(out)

    return run


def _layout(classes: DataFrame, dim: int, probes: int | None, clusters: int | None, block_rows: int) -> tuple[Layout, int]:
    """Clusters fitted on a bounded sample, and the blocks for the counted classes; at most ``CLUSTERS`` rows of counts reach the driver."""
    n = classes.count()
    share = max(1, -(-n // SAMPLE))
    # Drawn and ordered by hash, so that equal data give equal clusters in every run.
    drawn = classes.select("vec", F.xxhash64("vec").alias("h")).where(F.pmod("h", F.lit(share)) == 0).orderBy("h", "vec").limit(SAMPLE).select("vec").toArrow()
    units = _units(_matrix(drawn.column("vec"), dim)) if drawn.num_rows else np.eye(1, dim)
    k = min(len(units), CLUSTERS, max(1, clusters or int(math.sqrt(n) / 7)))
    centers = fit_centers(units, k)
    asked = min(k, probes or k)
    homes, visits = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)
    for c, h, v in classes.select("vec").mapInArrow(_tally(centers, asked, dim), "c bigint, homes bigint, visits bigint").groupBy("c").agg(F.sum("homes"), F.sum("visits")).collect():
        homes[c], visits[c] = h, v
    return Layout(centers, homes, visits, block_rows, VISITORS), asked


def nearest(rows: DataFrame, k: int = 5, dim: int = 64, block_rows: int = 32_768, probes: int | None = PROBES, clusters: int | None = None, spread: float = SPREAD) -> DataFrame:
    """(id, near): ids of the k most similar by cosine (12 decimals), ties by smaller id, of every row of ``rows(id, vector)``."""
    keep = k + 1
    given = rows.select(F.col("id").cast("string").alias("id"), "vector")
    # Each task, and each batch in it, sends at most keep ids of a vector, so a class of any size sends few rows.
    heads = given.mapInArrow(_heads(dim, keep), "vec binary, id string").groupBy("vec").agg(F.slice(F.sort_array(F.collect_set("id")), 1, keep).alias("ids"))
    # Class numbers follow the smallest ids' order (range partitions), so ties between classes go by number.
    numbered = heads.withColumn("first", F.col("ids")[0]).repartitionByRange("first").sortWithinPartitions("first", "vec")
    classes = stage_table(numbered.select(F.monotonically_increasing_id().alias("cls"), "vec", "ids"), "classes")
    layout, asked = _layout(classes, dim, probes, clusters, block_rows)
    blocks = classes.select("cls", "vec").mapInArrow(_assign(layout, asked, dim), "block bigint, cls bigint, mat binary, probes binary")
    reach = min(1.0, spread / math.sqrt(dim)) if probes else 1.0
    messages = blocks.groupBy("block").applyInArrow(_within(layout, asked, dim, keep, reach), _MESSAGE)
    best = messages.groupBy("target", "slice").applyInArrow(_between(asked, dim, keep), "cls bigint, sims array<double>, near array<bigint>")
    found = stage_table(best, "best")
    merged = found.groupBy("cls").agg(F.flatten(F.collect_list("sims")).alias("sims"), F.flatten(F.collect_list("near")).alias("near"))
    entry = F.arrays_zip(F.transform("sims", lambda s: -s).alias("s"), F.col("near").alias("c"))
    near = merged.select("cls", F.explode(F.slice(F.sort_array(entry), 1, keep)).alias("e")).select("cls", F.col("e.s").alias("s"), F.col("e.c").alias("near"))
    # A class is also near itself, at similarity 1; its own ids count for its members.
    mine = classes.select("cls", F.lit(-1.0).alias("s"), F.explode("ids").alias("id"), F.lit(True).alias("own"))
    known = near.join(classes.select(F.col("cls").alias("near"), "ids"), "near").select("cls", "s", F.explode("ids").alias("id"), F.lit(False).alias("own")).unionByName(mine)
    entries = F.sort_array(F.collect_list(F.struct("s", "id"))), F.collect_list(F.when(F.col("own"), F.col("id")))
    top = known.groupBy("cls").agg(F.slice(entries[0], 1, keep).alias("e"), entries[1].alias("ids"))
    lists = stage_table(top.select("cls", "ids", F.transform("e", lambda x: x["id"]).alias("all")), "lists")
    direct = lists.select(F.explode("ids").alias("id"), "all")
    # A class with keep listed ids may have more: those are found by the vector, a class's members by salt, so that a class of any size is spread.
    large = stage_table(classes.where(F.size("ids") == keep).select("cls", "vec").join(lists, "cls").drop("cls"), "large-classes")
    if large.isEmpty():
        return direct.select("id", F.slice(F.filter("all", lambda x: x != F.col("id")), 1, k).alias("near"))
    members = given.mapInArrow(_heads(dim, None), "vec binary, id string").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    spread_out = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    more = members.join(spread_out, ["vec", "salt"]).where(~F.array_contains("ids", F.col("id"))).select("id", "all").distinct()
    return direct.unionByName(more).select("id", F.slice(F.filter("all", lambda x: x != F.col("id")), 1, k).alias("near"))


def neighbor_pairs(rows: DataFrame, k: int = 5, dim: int = 64, block_rows: int = 32_768, probes: int | None = PROBES, clusters: int | None = None) -> DataFrame:
    """Unordered pairs (id_a < id_b) of which at least one is among the k most similar of the other."""
    e = nearest(rows, k, dim, block_rows, probes, clusters).select("id", F.explode("near").alias("n"))
    return e.select(F.least("id", "n").alias("id_a"), F.greatest("id", "n").alias("id_b")).distinct()
