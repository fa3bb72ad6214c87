"""Ranking rules on hand-made rows: scores, penalties, modes, ties, nulls and empty tables."""

import pytest
from pyspark.sql import functions as F

from strataloom.functions import display as D
from strataloom.functions import ranking as R
from strataloom.functions import text as X
from strataloom.functions.vector import cosine_distance
from strataloom.operators import context as C
from strataloom.operators import search as S

ROW = "id string, file_path string, name string, source_kind string, similarity double, dist double"


def hit(i, dist, name="myFunc", path="src/foo.ts", kind="file"):
    return (i, path, name, kind, 1 - dist, dist)


def order(spark, rows, query, weight=0.1):
    return [r["id"] for r in S.hybrid_rerank(spark.createDataFrame(rows, ROW), query, weight).orderBy("rank").collect()]


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_exact_symbol_beats_nearer_vector(spark):
    assert order(spark, [hit("near", 0.20, "other", "src/b.ts"), hit("exact", 0.55, "compressChunk", "src/a.ts")], "compressChunk function", 0.4) == ["exact", "near"]


def test_two_words_of_a_name(spark):
    assert order(spark, [hit("near", 0.10, "zzz", "src/b.ts"), hit("words", 0.45, "searchChunks", "src/a.ts")], "search chunks function", 0.4) == ["words", "near"]


def test_boosted_similarity_is_raised(spark):
    r = S.hybrid_rerank(spark.createDataFrame([hit("a", 0.5, "loader")], ROW), "the loader").first()
    assert r["similarity"] == 0.85 and r["score"] < 0.85


def test_penalties(spark):
    rows = [hit("t", 0.1, None, "src/a.test.ts"), hit("c", 0.1, None, "vitest.config.ts"), hit("h", 0.1, None, "", "history"), hit("p", 0.1, None, "src/a.go")]
    assert order(spark, rows, "general question about") == ["p", "h", "c", "t"]
    assert order(spark, rows[:1] + rows[3:], "unit test coverage") == ["t", "p"]  # no penalty, and a token in the file name


def test_ties_go_by_id_and_null_names_count_as_none(spark):
    assert order(spark, [hit("b", 0.2, None), hit("a", 0.2, None)], "zzz yyy") == ["a", "b"]


@pytest.mark.parametrize(
    "query,mode",
    [("trace the call of x", "trace"), ("trace the architecture of this repo", "explore"), ("how does the request flow work", "trace"), ("where is loadConfig", "lookup"), ("what does the error handler do", "explore"), ("null pointer in parser", "lookup"), ("", "explore"), (None, "explore")],
)
def test_modes(spark, query, mode):
    assert one(spark, R.retrieval_mode(F.lit(query).cast("string"))) == mode


def test_tokens_and_names(spark):
    assert one(spark, X.query_tokens(F.lit("Where's the fooBar(x)? a.b"))) == ["where", "the", "foobar"]
    assert one(spark, X.query_tokens(F.lit(None).cast("string"))) == []
    assert one(spark, X.camel_split(F.lit("parseHTTPBodyNow"))) == ["parse", "http", "body", "now"]
    assert one(spark, X.file_stem(F.lit("/a/b.test.ts"))) == "b.test"


@pytest.mark.parametrize("path,want", [("/r/src/a.ts", True), ("/r/node_modules/a.ts", False), ("/r/a.min.js", False), ("/r/yarn.lock", False), ("/r/x.egg-info/a.py", False), ("/r/a.json", False), (None, False)])
def test_indexable(spark, path, want):
    assert one(spark, X.indexable(F.lit(path).cast("string"))) is want


@pytest.mark.parametrize("n,want", [(7, "7"), (1500, "2k"), (999499, "999k"), (2_340_000, "2.3M")])
def test_short_count(spark, n, want):
    assert one(spark, X.short_count(F.lit(n))) == want


def test_rounding_and_dates(spark):
    assert one(spark, X.js_round(F.lit(-2.5))) == -2
    assert one(spark, X.iso_date(F.lit("2026-01-02T03:04:05+01:00"))) == "2026-01-02T02:04:05.000Z"
    assert one(spark, X.iso_date(F.lit("yesterday"))) == "yesterday"
    assert one(spark, X.leading_int(F.lit("12x"))) == 12 and one(spark, X.leading_int(F.lit("-"))) == 0


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    assert one(spark, cosine_distance(v(1, 0), v(0, 1))) == 1.0
    assert one(spark, cosine_distance(v(0, 0), v(0, 1))) is None
    assert one(spark, cosine_distance(v(1), v(0, 1))) is None


def test_test_filter(spark):
    rows = lambda *p: spark.createDataFrame([(x, i + 1) for i, x in enumerate(p)], "file_path string, rank int")
    got = lambda df, q: [r["file_path"] for r in S.test_filter(df, q).orderBy("rank").collect()]
    assert got(rows("a.ts", "a.spec.ts", "b.ts", "c.ts"), "how does it work") == ["a.ts", "b.ts", "c.ts"]
    assert got(rows("a.spec.ts", "b.ts", "c.spec.ts", "d.spec.ts"), "how does it work") == ["b.ts", "a.spec.ts", "c.spec.ts"]
    assert got(rows("a.spec.ts", "b.ts"), "jest unit test") == ["a.spec.ts", "b.ts"]
    assert got(rows("a.spec.ts", "b.spec.ts"), "how does it work") == ["a.spec.ts", "b.spec.ts"]


def test_threshold_after_limit(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("z", [0.0, 0.0]), ("n", None)], "id string, vector array<float>")
    out = S.after_limit(S.vector_topk(df, "vector", [1.0, 0.0], 2), 0.5, "vector").collect()
    assert [(r["id"], r["similarity"]) for r in out] == [("a", 1.0)]
    assert S.vector_topk(df.limit(0), "vector", [1.0, 0.0], 2).count() == 0


def test_dedup_keeps_the_first_and_null_keys(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 1, "z")], "id string, rank int, key string")
    assert sorted((r["id"] or "", r["key"]) for r in S.dedup_first(df, "id", "rank").collect()) == [("", "z"), ("a", "y")]


@pytest.mark.parametrize("tokens,budget,want", [([5, 5, 5], 13, 2), ([20, 1], 10, 0), ([4, 100, 1], 50, 1), ([0, 0], 2, 1), ([None, 3], 10, 2)])
def test_budget_stops_at_the_first_that_does_not_fit(spark, tokens, budget, want):
    df = spark.createDataFrame([("g", i, t) for i, t in enumerate(tokens)], "g string, n int, tokens int")
    assert C.budget_fill(df, budget, 3, ["g"], "n").count() == want


def test_commit_text(spark):
    files = F.array(F.struct(F.lit("a b.ts").alias("path"), F.lit(1).alias("insertions"), F.lit(None).cast("int").alias("deletions")))
    assert one(spark, D.commit_text(F.lit("h"), F.lit("me"), F.lit(None).cast("string"), F.lit(" "), files)) == "Commit: h\nAuthor: me\nDate: \n\n(no commit message)\n\nTouched files:\n- a b.ts (+1/-0)"


def test_batched_topk_in_blocks(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(99, None), (98, [0.0, 0.0, 0.0])], "id int, vec array<double>")
    queries = rows.where("id < 12").selectExpr("id as qid", "vec as qvec")
    got = lambda block: sorted((r["qid"], r["rank"], r["id"]) for r in S.vector_topk_batch(rows, queries, 4, block).collect())
    assert got(1000) == got(5) and len(got(5)) == 48
    assert S.vector_topk_batch(rows, queries.limit(0), 4).count() == 0


def test_batched_topk_equals_brute_force(spark):
    import random

    from strataloom.operators import search as S

    rng = random.Random(9)
    rows = [(f"r{i:03d}", [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(200)] + [("zero", [0.0] * 4), ("short", [1.0, 2.0]), ("none", None), ("hole", [1.0, None, 1.0, 1.0])]
    queries = [(i, [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(30)] + [(90, [0.0] * 4), (91, [1.0, 2.0]), (92, None)]
    norm = lambda v: sum(x * x for x in v) ** 0.5
    want = set()
    for q, u in queries:
        if u and norm(u):
            near = sorted((round(1 - sum(a * b for a, b in zip(u, v)) / (norm(u) * norm(v)), 12) + 0.0, i) for i, v in rows if v and len(v) == len(u) and None not in v and norm(v))
            want |= {(q, i, r) for r, (_, i) in enumerate(near[:7], 1)}
    df, qs = spark.createDataFrame(rows, "id string, vec array<double>").repartition(3), spark.createDataFrame(queries, "qid int, qvec array<double>")
    for block in (8192, 8):
        assert {(r["qid"], r["id"], r["rank"]) for r in S.vector_topk_batch(df, qs, 7, block).collect()} == want
    assert S.vector_topk_batch(df, qs.limit(0), 7).count() == S.vector_topk_batch(df.limit(0), qs, 7).count() == 0
