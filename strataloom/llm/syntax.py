"""Source files that do not parse, and what they are instead.

Each chunk is parsed by all supported grammars. If its own accepts it, it is valid; else a foreign grammar that accepts it names
its language, the likeliest one if several do; if none does, it is corrupt. Likeliest is the language under whose token
statistics the text's tokens are, and these count every token of all contents (of the extensions' languages); only texts with
several foreign languages are joined with them. A file is invalid if one of its chunks is; its language is then the one that
most of its failing text reads as.

Defined results: null, empty and blank contents are valid and accepted by all; rows whose file has no known extension are not
looked at; repeated rows count once in (file_path); a text nested too deeply for the parser of Python counts as valid; without any
content the ranking is the order of the grammars.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm import syntax_go, syntax_rust, syntax_ts
from strataloom.session import stage_table

# Languages of the extensions.
LANGUAGES = {"ts": "typescript", "mts": "typescript", "cts": "typescript", "js": "typescript", "mjs": "typescript", "cjs": "typescript", "tsx": "tsx", "jsx": "tsx", "py": "python", "pyi": "python", "go": "go", "rs": "rust"}
_TOKEN = re.compile(r"[A-Za-z_]\w*|[^\w\s]{1,2}")


def tokens_of(text: str) -> list[str]:
    """Words of up to 12 letters and signs; what only one text holds tells no language apart and costs little."""
    return [t for t in _TOKEN.findall(text) if len(t) <= 12]


class Ranking:
    """Log-probabilities of the corpus's tokens in each language, with additive smoothing; ``settle`` does the same for counts in a table."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        total = Counter()
        for c in counts.values():
            total.update(c)
        words = [t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))]
        self.at = {t: i for i, t in enumerate(words)}
        table = np.array([[counts.get(g, {}).get(t, 0) + 0.5 for t in words] for g in PARSERS]).reshape(len(PARSERS), -1)
        self.log = np.log(table / table.sum(axis=1, keepdims=True)) if words else table

    def rank(self, text: str) -> list[str]:
        """Languages, the likeliest first; equal ones in the order of the grammars."""
        seen = Counter(i for t in tokens_of(text) if (i := self.at.get(t)) is not None)
        score = self.log[:, list(seen)] @ np.array(list(seen.values())) if seen else np.zeros(len(PARSERS))
        names = list(PARSERS)
        return [names[i] for i in np.argsort(-score, kind="stable")]


def _python(text: str, chunk_type: str) -> bool:
    def parse(source: str):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(source.removeprefix("\ufeff")).body

    try:
        body = parse(text)
    except (SyntaxError, ValueError):
        # A member whose first line lost its indent: put it back into a class.
        later = [len(x) - len(x.lstrip()) for x in text.split("\n")[1:] if x.strip()]
        if chunk_type == "file" or not later or not text[:1].strip() or not min(later):
            return False
        try:
            body = parse("class _:\n" + " " * min(later) + text)[0].body
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
    except (RecursionError, MemoryError):
        return True
    return chunk_type == "file" or len(body) == 1 and (isinstance(body[0], (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) or isinstance(body[0], (ast.Expr, ast.Assign)) and isinstance(body[0].value, ast.Lambda))


PARSERS = {
    "typescript": lambda text, kind: syntax_ts.valid(text, kind, False),
    "tsx": lambda text, kind: syntax_ts.valid(text, kind, True),
    "python": _python,
    "go": syntax_go.valid,
    "rust": syntax_rust.valid,
}


def accepted(text: str | None, chunk_type: str, ranking: Ranking | None = None) -> list[tuple[str, bool]]:
    """Grammars that accept the text, the likeliest language first if there is a ranking, and whether as what it is said to be (else as a whole file)."""
    if not text or not text.strip():
        return [(g, True) for g in PARSERS]
    out = []
    for g in ranking.rank(text) if ranking else PARSERS:
        if PARSERS[g](text, chunk_type):
            out.append((g, True))
        elif chunk_type != "file" and PARSERS[g](text, "file"):
            out.append((g, False))
    return out


def verdict(text: str | None, chunk_type: str, language: str, ranking: Ranking | None = None) -> tuple[str, list[str]]:
    """``ok``, the language that the text is in instead, or ``corrupt``; and the grammars that accept it."""
    by = accepted(text, chunk_type, ranking)
    if (language, True) in by:
        return "ok", [g for g, _ in by]
    names = [g for g, _ in by if g != language]
    return (names[0] if names else "corrupt"), names


def judge(text: str | None, chunk_type: str, language: str, ranking: Ranking | None = None) -> str:
    return verdict(text, chunk_type, language, ranking or Ranking({}))[0]


HELD = 200_000  # tokens that a task counts before it hands the counts on
SCALE = 1e9  # logarithms are summed as whole numbers of this fraction, which no order of rows changes
_OUT = "file_path string, language string, verdict string, size bigint, grammars int, tokens map<string,bigint>"


def _count(batches):
    """Tokens of each language in a task's contents, all of them; a token may come in several parts, to be summed."""

    def part():
        rows = [(g, t, n) for g, c in counts.items() for t, n in c.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], ["language", "token", "n"])

    counts: dict[str, Counter] = {}
    for batch in batches:
        for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.setdefault(LANGUAGES[p.rsplit(".", 1)[1]], Counter()).update(tokens_of(t or ""))
            if sum(map(len, counts.values())) > HELD:
                yield part()
                counts.clear()
    yield part()


def learn(code: DataFrame) -> DataFrame:
    """Token statistics over all rows of ``code(file_path, content)``: each token once, with its number in each language."""
    counted = code.select("file_path", "content").mapInArrow(_count, "language string, token string, n bigint")
    return counted.groupBy("token").agg(*[F.sum(F.when(F.col("language") == g, F.col("n")).otherwise(0)).alias(g) for g in PARSERS])


def _judge(batches):
    """Verdicts; texts that several foreign grammars accept have none yet, but their tokens."""
    bit = {g: 1 << i for i, g in enumerate(PARSERS)}
    for batch in batches:
        paths, kinds, texts = (batch.column(i).to_pylist() for i in range(3))
        langs = [LANGUAGES[p.rsplit(".", 1)[1]] for p in paths]
        verdicts = [verdict(t, k, g) for t, k, g in zip(texts, kinds, langs)]
        open_ = [v != "ok" and len(by) > 1 for v, by in verdicts]
        columns = [
            pa.array(paths, pa.string()), pa.array(langs, pa.string()), pa.array([None if o else v for o, (v, _) in zip(open_, verdicts)], pa.string()), pa.array([len(t or "") for t in texts], pa.int64()),
            pa.array([sum(bit[g] for g in by) for _, by in verdicts], pa.int32()), pa.array([list(Counter(tokens_of(t)).items()) if o else None for o, t in zip(open_, texts)], pa.map_(pa.string(), pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _OUT.split(", ")])


def settle(seen: DataFrame, counts: DataFrame) -> DataFrame:
    """``seen(row, verdict, grammars, tokens, ...)`` with the likeliest of the accepting languages where no verdict was given, equal
    ones in the order of the grammars. The tokens of these texts are joined with the whole ``counts``."""
    known = counts.agg(F.count("*").alias("tokens"), *[F.sum(g).alias(g) for g in PARSERS]).first()
    mass = {g: (known[g] or 0) + 0.5 * known["tokens"] or 1.0 for g in PARSERS}
    texts = seen.where(F.col("verdict").isNull())
    terms = [F.sum(F.col("n") * F.round(F.log((F.col(g) + 0.5) / mass[g]) * SCALE).cast("bigint")).alias(f"s_{g}") for g in PARSERS]
    scores = texts.select("row", F.explode("tokens").alias("token", "n")).join(counts.hint("merge"), "token").groupBy("row").agg(*terms)
    able = [F.when(F.col("grammars").bitwiseAND(1 << i) > 0, F.struct(F.coalesce(f"s_{g}", F.lit(0)).alias("score"), F.lit(-i).alias("order"), F.lit(g).alias("name"))) for i, g in enumerate(PARSERS)]
    best = F.array_max(F.filter(F.array(*able), lambda x: x.isNotNull()))["name"]
    named = texts.join(scores.hint("merge"), "row", "left").withColumn("verdict", best)
    return seen.where(F.col("verdict").isNotNull()).unionByName(named.select(*seen.columns))


def judge_files(chunks: DataFrame) -> DataFrame:
    """(file_path, repo, language, valid, reads_as, grammars): one row a file; ``reads_as`` is the foreign language of an invalid file, else
    ``corrupt``; ``grammars`` are those that accept all of its chunks."""
    code = chunks.where((F.coalesce("source_kind", F.lit("file")) == "file") & F.regexp_extract("file_path", r"\.([a-z]+)$", 1).isin(*LANGUAGES))
    parsed = code.select("file_path", F.coalesce("chunk_type", F.lit("file")).alias("chunk_type"), "content").mapInArrow(_judge, _OUT)
    parsed = stage_table(parsed.withColumn("row", F.monotonically_increasing_id()), "parsed")  # read three times
    seen = settle(parsed, stage_table(learn(code), "tokens"))
    read = [F.sum(F.when(F.col("verdict") == g, F.col("size"))).alias(f"r_{g}") for g in PARSERS]
    files = seen.groupBy("file_path", "language").agg(F.count_if(F.col("verdict") != "ok").alias("n"), F.bit_and("grammars").alias("g"), *read)
    most = F.array_max(F.filter(F.array(*[F.struct(F.col(f"r_{g}").alias("size"), F.lit(-i).alias("order"), F.lit(g).alias("name")) for i, g in enumerate(PARSERS)]), lambda x: x["size"].isNotNull()))
    reads = F.when(F.col("n") > 0, F.coalesce(most["name"], F.lit("corrupt")))
    by = F.filter(F.array(*[F.when(F.col("g").bitwiseAND(1 << i) > 0, F.lit(g)) for i, g in enumerate(PARSERS)]), lambda x: x.isNotNull())
    return files.select("file_path", F.regexp_extract("file_path", "^/ws/([^/]+)/", 1).alias("repo"), "language", (F.col("n") == 0).alias("valid"), reads.alias("reads_as"), by.alias("grammars"))


def grammars(files: DataFrame) -> DataFrame:
    """(language, grammar, n_files): files of each extension's language that each grammar accepts."""
    return files.select("language", F.explode("grammars").alias("grammar")).groupBy("language", "grammar").agg(F.count("*").alias("n_files"))


def rates(files: DataFrame) -> DataFrame:
    """Files, invalid files and wrong extensions per repository and language."""
    wrong = ~F.col("valid") & (F.col("reads_as") != "corrupt")
    out = files.groupBy("repo", "language").agg(F.count("*").alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid"), F.count_if(wrong).alias("n_wrong_extension"))
    return out.withColumn("invalid_rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
