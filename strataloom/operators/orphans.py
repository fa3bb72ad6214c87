"""References to records that do not exist.

A blocked Bloom filter of all parent keys (built-in bitmap aggregates; blocks of 4 KiB, ``BITS_PER_KEY`` bits for each of the
counted keys, so that under 1 % of absent keys pass it at any size) proves most orphans. Only the distinct keys that pass it are
joined with the parents exactly. Up to ``BROADCAST_BLOCKS`` blocks (64 MiB, about 45 million keys) the filter is broadcast and
applied at the scan; a larger one is joined, block by block, with the distinct keys of the references.

Defined results: a null reference is none; a null ``from_file`` leaves a symbol without ``to_file`` unjudged; repeated
edges count once; empty parents make every reference an orphan; empty edges give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.session import stage_table

# Endings a path reference may leave out, and the endings that stand for another.
CODE_ENDINGS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs", "py", "pyi", "go", "rs")
WRITTEN_FOR = {"ts": ("js",), "tsx": ("js", "jsx"), "mts": ("mjs",), "cts": ("cjs",)}
BLOCK_BITS = 32768  # bits of one bitmap of Spark's bitmap_construct_agg
PROBES = 4
BITS_PER_KEY = 12
BROADCAST_BLOCKS = 16_384
SALTS = 16


def repo_of(path: Column) -> Column:
    return F.regexp_extract(path, "^/ws/([^/]+)/", 1)


def path_aliases(path: Column) -> Column:
    """Every reference that resolves to ``path``: itself, without its ending, its directory if it is an index, and the written endings."""
    end = F.regexp_extract(path, r"\.([a-z]+)$", 1)
    base = F.regexp_replace(path, r"\.[a-z]+$", "")
    none = F.array().cast("array<string>")
    known = F.when(end.isin(*CODE_ENDINGS), F.array(base)).otherwise(none)
    index = F.when(end.isin(*CODE_ENDINGS) & base.endswith("/index"), F.array(F.regexp_replace(base, "/index$", ""))).otherwise(none)
    written = none
    for e, forms in WRITTEN_FOR.items():
        written = F.when(end == e, F.array(*[F.concat(base, F.lit("." + x)) for x in forms])).otherwise(written)
    return F.array_distinct(F.concat(F.array(path), known, index, written))


def _key(kind: str, *parts: Column) -> Column:
    """Typed key of a reference."""
    return F.concat_ws("\x1f", F.lit(kind), *parts)


def parent_keys(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Distinct keys that references may hold on: chunk ids, paths with their aliases, symbols by repository and by alias."""
    present = manifest.where(F.col("removed_at").isNull() & F.col("path").isNotNull()).select("path").distinct()
    aliases = present.withColumn("alias", F.explode(path_aliases(F.col("path"))))
    of_chunk = F.array(_key("c", F.col("id")), _key("c", F.concat("file_path", F.lit(":0"))))
    ids = chunks.where(F.col("id").isNotNull() | F.col("file_path").isNotNull()).select(F.explode(of_chunk).alias("k"))
    named = chunks.where(F.col("name").isNotNull())
    in_repo = named.where(F.col("source_kind") == "file").select(_key("n", repo_of(F.col("file_path")), F.col("name")).alias("k"))
    in_file = named.select("file_path", "name").distinct().join(aliases, F.col("file_path") == F.col("path")).select(_key("s", F.col("alias"), F.col("name")).alias("k"))
    return ids.union(aliases.select(_key("f", F.col("alias")).alias("k"))).union(in_repo).union(in_file).where(F.col("k").isNotNull()).distinct()


def references(edges: DataFrame, known: DataFrame) -> DataFrame:
    """One row per judged reference: edge_id, ref_field, period column, key ``k`` and, for symbols of a file, the file's key."""
    lib = known.select(F.col("symbol").alias("to_symbol")).distinct().withColumn("__lib", F.lit(True))
    e = edges.select("edge_id", "from_chunk_id", "from_file", "to_symbol", "to_file", "edge_type", "indexed_at").join(lib, "to_symbol", "left")
    judged = (F.col("edge_type") == "call") & F.col("__lib").isNull() & F.col("to_symbol").isNotNull()
    ref = lambda when, field, k, need=F.lit(None).cast("string"): F.when(when, F.struct(F.lit(field).alias("ref_field"), k.alias("k"), need.alias("need")))
    refs = F.array(
        ref(F.col("from_chunk_id").isNotNull(), "from_chunk_id", _key("c", F.col("from_chunk_id"))),
        ref(F.col("to_file").isNotNull(), "to_file", _key("f", F.col("to_file"))),
        ref(judged & F.col("to_file").isNull() & F.col("from_file").isNotNull(), "to_symbol", _key("n", repo_of(F.col("from_file")), F.col("to_symbol"))),
        ref(judged & F.col("to_file").isNotNull(), "to_symbol", _key("s", F.col("to_file"), F.col("to_symbol")), _key("f", F.col("to_file"))),
    )
    return e.select("edge_id", "indexed_at", F.explode(F.filter(refs, lambda r: r.isNotNull())).alias("r")).select("edge_id", "indexed_at", "r.*")


def _block(k: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(k), F.lit(blocks)).cast("int")


def _probe(k: Column, i: int) -> Column:
    """Position of probe i in the key's block."""
    return F.pmod(F.shiftright(F.xxhash64(k, F.lit("probe")), 15 * i), F.lit(BLOCK_BITS))


def blocks_for(n_keys: int) -> int:
    """Blocks of a filter of that many keys."""
    return max(1, -(-n_keys * BITS_PER_KEY // BLOCK_BITS))


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, bits). Keys are moved as a block number and a hash; the bitmaps, one a block, are built where they stay."""
    hashed = keys.select(_block(F.col("k"), blocks).alias("block"), *[_probe(F.col("k"), i).cast("int").alias(f"p{i}") for i in range(PROBES)]).repartition("block")
    bits = hashed.select("block", F.explode(F.array(*[F.col(f"p{i}").cast("bigint") for i in range(PROBES)])).alias("at"))
    return bits.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))


def maybe_held(refs: DataFrame, filt: DataFrame, blocks: int) -> DataFrame:
    """``refs`` with ``maybe``: false proves that the key has no parent. The filter is broadcast if it is within the bound."""
    joined = refs.withColumn("block", _block(F.col("k"), blocks)).join(F.broadcast(filt) if blocks <= BROADCAST_BLOCKS else filt, "block", "left")
    held = F.col("bits").isNotNull()
    for i in range(PROBES):
        at = _probe(F.col("k"), i)
        byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        held = held & (F.call_function("getbit", byte, F.pmod(at, F.lit(8)).cast("int")) == 1)
    return joined.withColumn("maybe", F.coalesce(held, F.lit(False))).drop("block", "bits")


def orphan_references(edges: DataFrame, chunks: DataFrame, manifest: DataFrame, known: DataFrame, blocks: int | None = None) -> DataFrame:
    """Orphans (edge_id, indexed_at, ref_field), one row per reference row; see the module for nulls and repeats."""
    parents = stage_table(parent_keys(chunks, manifest), "parent-keys")  # read three times
    blocks = blocks or blocks_for(parents.count())
    refs, filt = references(edges, known), bloom(parents, blocks)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = lambda df: df.withColumn("salt", F.pmod(F.xxhash64("edge_id"), F.lit(SALTS)).cast("int"))
    if blocks <= BROADCAST_BLOCKS:
        refs = maybe_held(refs, filt, blocks)
        proven, passed = refs.where(~F.col("maybe")), refs.where("maybe")
        # Only keys that pass are verified, each once; a hot key shrinks to one row a task before the shuffle.
        missing = passed.select("k").distinct().join(parents, "k", "left_anti")
        orphans = proven.unionByName(salted(passed).join(missing.withColumn("salt", salts), ["k", "salt"]).drop("salt"))
    else:
        keys = maybe_held(refs.select("k").distinct(), filt, blocks)
        missing = keys.where(~F.col("maybe")).select("k").union(keys.where("maybe").select("k").join(parents, "k", "left_anti"))
        orphans = salted(refs).join(missing.withColumn("salt", salts), ["k", "salt"]).drop("salt")
    orphans = stage_table(orphans, "orphans")
    # A symbol of a file that does not resolve is not judged: such rows are found by the same keys.
    bound = orphans.where(F.col("need").isNotNull())
    files = bound.select(F.col("need").alias("k")).distinct().join(parents, "k", "left_semi").withColumn("salt", salts)
    judged = salted(bound).join(files.withColumnRenamed("k", "need"), ["need", "salt"], "left_semi")
    return orphans.where(F.col("need").isNull()).select("edge_id", "indexed_at", "ref_field").unionByName(judged.select("edge_id", "indexed_at", "ref_field"))


def orphan_report(edges: DataFrame, chunks: DataFrame, manifest: DataFrame, known: DataFrame, blocks: int | None = None) -> DataFrame:
    """Orphans per missing table, field and month of first sighting of the edge."""
    found = orphan_references(edges, chunks, manifest, known, blocks).groupBy("edge_id", "ref_field").agg(F.min("indexed_at").alias("at"))
    target = F.when(F.col("ref_field") == "to_file", "manifest").otherwise("chunks")
    return found.groupBy(target.alias("missing_in"), "ref_field", F.date_format("at", "yyyy-MM").alias("period")).agg(F.count("*").alias("n_orphans"))
