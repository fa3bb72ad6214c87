"""Generated, minified, vendored and data-only source files.

Vendored copies: a file's tokens (names kept; layout, comments, quotes and semicolons dropped) are fingerprinted by
winnowing, so any shared run of ``GRAM + WINDOW - 1`` tokens shares a fingerprint. A file whose fingerprints mostly recur in
``REPOS`` unrelated repositories, or in the released third-party files, is a copy, with small changes or without; a file of fewer than
``LEAST`` is one only if its whole token streams recur. Repositories
most of whose fingerprints agree (MinHash over all of a repository's) are forks of one family and count once. How often a
fingerprint recurs is counted over all files, pre-aggregated to one row per fingerprint and repository.

Generated files: names and literals are dropped too, and the runs of ``SHAPE`` such tokens are counted within the file. A tool
repeats one shape of declaration: at least ``REPEATED`` of the runs recur, lines come in few shapes, openings of blocks recur, and
nothing decides or loops (but for an accessor's guard). Stubs (.pyi), which hold signatures only, are told by notices alone.
Tools' notices count where tools put them, in the opening comment; names of directories count for nothing.

Minified and data files have no second copy to agree with: they are told by density and by the share of literals.

Defined results: a file is seen through its ``file`` rows, or else through its declarations; null and empty contents
have no signs; repeated rows count once; non-code endings are left out; a file of fewer than ``GRAM`` tokens has no fingerprint and
can't be told to be a copy; empty tables give no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.session import stage_table

# Endings of code files.
CODE = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs", "py", "pyi", "go", "rs")
GRAM, WINDOW = 24, 8
LEAST = 12  # fingerprints (about 80 tokens) below which a part of a file that recurs may be an idiom, so that only equal files count
SHARE, REPOS = 0.7, 3
SHAPE, REPEATED, LINES = 6, 0.8, 0.5  # tokens of a shape; least share of recurring ones, and most distinct shapes a line
BANDS, BAND = 4, 3  # MinHash of a repository: families agree in one of the bands
ROUNDS = 4  # of passing a family's name along
SALTS = 16

_STRING_OR_COMMENT = re.compile(r"""('(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*")|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)|//[^\n]*|(?m:^[ \t]*\#(?!!?\[)[^\n]*)""", re.S)
_TOKEN = re.compile(r"\w+|[^\w\s;,'\"`]")
# Openings of the notices that tools write at the top of their output.
_NOTICE = re.compile(
    r"""(?ix) ^\W* (?: code\ generated\b.*\bdo\ not\ (?:edit|modify) | @generated\b(?:\ by|\ from|\W*$)? | <auto-?generated | auto-?generated\ (?:file|code|by|from|--?)
      | (?:this\ (?:file|code|module)\ (?:is|was|has\ been)\ )(?:auto(?:matically|-)?\ ?|machine[- ]?)?(?:generated|written|produced|created)\ (?:by|from|with|automatically)
      | (?:automatically|machine)[- ](?:generated|written|produced)\b | generated\ (?:by|from|with|using|automatically)\ (?:the\ )?\S+ | (?:do\ not\ (?:edit|modify|change)\b.*\b(?:output|generated|produced|built|overwritten|lost)\b)
      | (?:produced|emitted|written|built|created)\ by\ (?:the\ )?\S+\ (?:compiler|generator|tool|codegen|v?\d)  | (?:do\ not\ (?:edit|modify)\W*$) )"""
)
_HEAD = re.compile(r"\A\ufeff?(?:\s*(?:/\*.*?\*/|//[^\n]*|\#[^\n]*|\"\"\".*?\"\"\"|<!--.*?-->|package\s+\w+;?|['\"]use strict['\"];?))+", re.S)
_GUARD = re.compile(r"\bif \w+ [!=]= nil \{[^{}]*\}")  # of an accessor
_CONTROL = re.compile(r"\b(?:if|for|while|switch|match|try|loop|await|yield|raise|throw)\b|\s\?\s")
_KEY_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]+-----[^-]{0,20000}-----END [A-Z0-9 ]+-----")
_LITERAL = re.compile(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`|(?<![\w.])-?(?:0[xXbBoO][0-9a-fA-F_]+|\d[\d_]*\.?\d*(?:[eE][+-]?\d+)?)\b")


def bare(text: str) -> str:
    """``text`` without comments."""
    return _STRING_OR_COMMENT.sub(r"\1", text)


def fingerprints(text: str) -> np.ndarray:
    """Distinct winnowed hashes (even) of the token stream: the smallest of each window of gram hashes; and one (odd) of the whole stream."""
    tokens = _TOKEN.findall(bare(text))
    whole = np.array([xxhash.xxh64_intdigest(" ".join(tokens).encode("utf-8", "surrogatepass")) - (1 << 63) | 1], dtype=np.int64)
    n = len(tokens) - GRAM + 1
    if n <= 0:
        return whole if tokens else whole[:0]
    codes = np.fromiter(map(xxhash.xxh64_intdigest, tokens), dtype=np.uint64, count=len(tokens))
    gram = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(GRAM):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
        gram ^= gram >> np.uint64(29)
    gram = gram.view(np.int64) & ~1
    low = np.lib.stride_tricks.sliding_window_view(gram, min(n, WINDOW)).min(axis=1)
    return np.r_[np.unique(low), whole]


def notice(text: str) -> bool:
    """Whether the opening comment holds a line in the form of a tool's notice."""
    head = _HEAD.match(text)
    return bool(head) and any(_NOTICE.search(line.strip(" \t\r/*#<!->\"'")) for line in head.group().split("\n"))


_PART = re.compile(r"[^\W\d]\w*|\d[\w.]*|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|[^\w\s;,]")
# Words of the languages that stay in a shape; others become one name.
_KEPT = frozenset(
    """abstract as async await bool boolean case catch class const def default else enum export extends false final float fn for from func function get if impl implements import in int interface is lambda let
match mut new nil none None not null number or package private protected pub public raise readonly return self set static str string struct super switch this throw trait true True False try type union use var while with yield""".split()
)


def _shaped(line: str) -> list[str]:
    return [t if t in _KEPT else "n" if (c := t[0]).isalpha() or c == "_" else "0" if c.isdigit() else "s" if c in "'\"`" else t for t in _PART.findall(line)]


def shapes(text: str) -> list[int] | None:
    """Hashes of the shapes in ``text``, or None if it decides or loops: runs of tokens (4n), lines (4n + 1), lines that open a block (4n + 2)."""
    code = bare(text)
    if _CONTROL.search(code) and _CONTROL.search(_GUARD.sub("", code)):
        return None
    out, run = [], []
    for line in code.split("\n"):
        part = _shaped(line)
        if part:
            opens = part[-1] in "{:"
            out.append(xxhash.xxh64_intdigest(" ".join(part)) >> 2 << 1 | opens)
            run += part
    lines = [(h >> 1 << 2) + 1 + (h & 1) for h in out]
    runs = [xxhash.xxh64_intdigest(" ".join(run[i : i + SHAPE])) >> 2 << 2 for i in range(len(run) - SHAPE + 1)]
    return [x - (1 << 63) for x in lines + runs]


def minified(text: str) -> bool:
    """Mostly long lines with hardly any white space between tokens that aren't literals."""
    code = _LITERAL.sub("0", bare(text))
    if len(code) < 0.25 * len(text):
        return False
    dense = sum(len(x) for x in code.split("\n") if len(x) > 180)
    return bool(dense) and dense >= 0.7 * len(code) and len(code) - len("".join(code.split())) <= 0.1 * len(code)


def mostly_data(text: str) -> bool:
    """Literals, with the commas between them, make up most of a file; a key block is a setting, not data."""
    code = _KEY_BLOCK.sub("", bare(text))
    solid = len("".join(code.split()))
    return bool(solid) and len("".join("".join(_LITERAL.findall(code)).split())) + code.count(",") >= 0.8 * solid


def repo_of(path: Column) -> Column:
    return F.regexp_extract(path, "^/ws/([^/]+)/", 1)


_SEEN = "file_path string, repo string, kinds int, size int, prints array<bigint>, h bigint, shapes array<bigint>"
PART = 0.6  # of a file's text that has to be minified or data


def _lists(parts: list) -> pa.ListArray:
    ends = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([0 if x is None else len(x) for x in parts], out=ends[1:])
    flat = [np.asarray(x, dtype=np.int64) for x in parts if x is not None]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.empty(0, dtype=np.int64)), mask=pa.array([x is None for x in parts]))


def _signs(batches):
    for batch in batches:
        paths, repos, texts = (batch.column(i).to_pylist() for i in range(3))
        texts = [t or "" for t in texts]
        kinds = [notice(t) | minified(t) << 2 | mostly_data(t) << 3 for t in texts]
        shaped = [None if p.endswith(".pyi") else shapes(t) for p, t in zip(paths, texts)]
        hashes = [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t in texts]
        columns = [pa.array(paths, pa.string()), pa.array(repos, pa.string()), pa.array(kinds, pa.int32()), pa.array([len(t) for t in texts], pa.int32()), _lists([fingerprints(t) for t in texts]), pa.array(hashes, pa.int64()), _lists(shaped)]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _SEEN.split(", ")])


def families(prints: DataFrame) -> DataFrame:
    """(repo, family) of ``prints(repo, p)``: repositories that agree in a band of MinHashes, directly or along a chain, have one family.

    One row of ``BANDS`` x ``BAND`` hashes a repository; agreement is passed on by the smallest name of a band, not by pairs.
    """
    least = [F.min(F.xxhash64("p", F.lit(i))).alias(f"m{i}") for i in range(BANDS * BAND)]
    mins = prints.groupBy("repo").agg(*least)
    bands = F.array(*[F.xxhash64(F.lit(b), *[F.col(f"m{b * BAND + i}") for i in range(BAND)]) for b in range(BANDS)])
    known = stage_table(mins.select("repo", bands.alias("bands"), F.col("repo").alias("family")), "families")
    for _ in range(ROUNDS):
        lowest = known.select(F.explode("bands").alias("band"), "family").groupBy("band").agg(F.min("family").alias("low"))
        named = known.select("repo", F.explode("bands").alias("band")).join(lowest, "band").groupBy("repo").agg(F.min("low").alias("family"))
        after = stage_table(known.select("repo", "bands").join(named, "repo"), "families")
        done = after.join(known.select("repo", F.col("family").alias("was")), "repo").where("family <> was").isEmpty()
        known = after
        if done:
            break
    return known.select("repo", "family")


def repeated(seen: DataFrame) -> DataFrame:
    """(file_path) of files of one shape of declaration, from the shapes of their distinct parts."""
    counted = seen.where("shapes is not null").select("file_path", "h", "shapes").dropDuplicates(["file_path", "h"]).select("file_path", F.explode("shapes").alias("v")).groupBy("file_path", "v").agg(F.count("*").alias("n"))
    tag = F.col("v").bitwiseAND(3)
    total = lambda when, what=F.col("n"): F.coalesce(F.sum(F.when(when, what)), F.lit(0))
    out = counted.groupBy("file_path").agg(total(tag == 0).alias("runs"), total((tag == 0) & (F.col("n") > 1)).alias("again"), total(tag > 0).alias("lines"), total(tag > 0, F.lit(1)).alias("kinds"), F.max(F.when(tag == 2, F.col("n"))).alias("opened"))
    return out.where((F.col("runs") > 0) & (F.col("again") >= REPEATED * F.col("runs")) & (F.col("kinds") <= LINES * F.col("lines")) & (F.col("opened") > 1)).select("file_path")


def not_hand_written(chunks: DataFrame, releases: DataFrame) -> DataFrame:
    """(file_path, generated, minified, data, vendored) of every code file that has one of these signs."""
    code = chunks.where((F.coalesce("source_kind", F.lit("file")) == "file") & F.regexp_extract("file_path", r"\.([a-z]+)$", 1).isin(*CODE))
    # A method's text is part of its class, but for Go, whose methods stand alone.
    parts = code.where((F.coalesce("chunk_type", F.lit("file")) != "method") | F.col("file_path").endswith(".go")).select("file_path", repo_of(F.col("file_path")).alias("repo"), "content")
    seen = stage_table(parts.mapInArrow(_signs, _SEEN), "signs")
    bit = lambda b: F.col("kinds").bitwiseAND(b) > 0
    part = lambda b: F.coalesce(F.sum(F.when(bit(b), F.col("size"))) >= PART * F.sum("size"), F.lit(False))
    signs = seen.groupBy("file_path").agg(F.bool_or(bit(1)).alias("notice"), part(4).alias("minified"), part(8).alias("data"), F.bool_and(F.col("shapes").isNotNull()).alias("plain"))
    shaped = repeated(seen).withColumn("repeated", F.lit(True))
    signed = signs.join(shaped, "file_path", "left").withColumn("generated", F.col("notice") | (F.col("plain") & F.coalesce("repeated", F.lit(False)) & ~F.col("data") & ~F.col("minified"))).where("generated or minified or data")
    prints = seen.select("file_path", "repo", F.explode("prints").alias("p")).distinct()
    known = releases.select(F.lit("").alias("file_path"), F.lit("").alias("repo"), "content").mapInArrow(_signs, _SEEN).select(F.explode("prints").alias("p")).distinct()
    in_repo = prints.select("p", "repo").distinct()
    spread = in_repo.join(families(in_repo), "repo").groupBy("p").agg(F.count_distinct("family").alias("n")).where(F.col("n") >= REPOS).select("p")
    # A fingerprint that very many files hold is met by salt.
    foreign = spread.union(known).distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("foreign", F.lit(1))
    salted = prints.withColumn("salt", F.pmod(F.xxhash64("file_path"), F.lit(SALTS)).cast("int"))
    whole = F.col("p").bitwiseAND(1) == 1
    shares = salted.join(foreign, ["p", "salt"], "left").groupBy("file_path").agg(F.count_if(~whole).alias("n"), F.count_if(~whole & F.col("foreign").isNotNull()).alias("f"), F.count_if(whole & F.col("foreign").isNull()).alias("own"))
    copies = shares.where((F.col("n") > 0) & ((F.col("n") >= LEAST) & (F.col("f") >= SHARE * F.col("n")) | (F.col("own") == 0))).select("file_path", F.lit(True).alias("vendored"))
    both = signed.join(copies, "file_path", "full_outer")
    return both.select("file_path", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("generated", "minified", "data", "vendored")])
