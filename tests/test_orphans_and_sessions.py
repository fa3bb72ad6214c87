"""Orphan references on hand-made rows, and sessions in batch and as a stream."""

import datetime as dt

from pyspark.sql import functions as F

import pytest

from strataloom.operators import orphans as O
from strataloom.operators.orphans import orphan_references, orphan_report
from strataloom.streaming import sessions as K

EDGE = "edge_id bigint, from_chunk_id string, from_file string, from_symbol string, to_symbol string, to_file string, edge_type string, indexed_at timestamp, k string"
T0 = dt.datetime(2026, 1, 31)


def tables(spark, edges, blocks=16):
    e = spark.createDataFrame([(*x, T0, "clash") for x in edges], EDGE)
    c = spark.createDataFrame([("/ws/r/src/a.ts:0", "/ws/r/src/a.ts", "f", "file", "x"), ("/ws/r/lib/index.ts:4", "/ws/r/lib/index.ts", "g", "file", "x"), ("git:1", "", "1", "history", "x"), (None, None, None, None, None)], "id string, file_path string, name string, source_kind string, block string")
    m = spark.createDataFrame([("/ws/r/src/a.ts", None), ("/ws/r/lib/index.ts", None), ("/ws/r/gone.ts", T0), (None, None)], "path string, removed_at timestamp")
    n = spark.createDataFrame([("log",)], "symbol string")
    return e, c, m, n


@pytest.fixture(params=["broadcast", "joined"])
def filter_form(request, monkeypatch):
    if request.param == "joined":
        monkeypatch.setattr(O, "BROADCAST_BLOCKS", 0)


def found(spark, edges):
    return {(r["edge_id"], r["ref_field"]) for r in orphan_references(*tables(spark, edges), blocks=16).collect()}


def test_each_field(spark, filter_form):
    a, f = "/ws/r/src/a.ts:0", "/ws/r/src/a.ts"
    edges = [
        (1, a, f, None, "f", None, "call"),  # all holds
        (2, "/ws/r/nope:3", f, None, "f", None, "call"),
        (3, "/ws/r/lib/index.ts:0", f, None, "f", None, "import"),  # path + :0 of a file with chunks
        (4, a, f, None, "x", "/ws/r/src/a", "import"),
        (5, a, f, None, "x", "/ws/r/lib", "import"),
        (6, a, f, None, "x", "/ws/r/src/a.js", "import"),
        (7, a, f, None, "x", "/ws/r/gone.ts", "call"),  # the file is gone, so the symbol isn't judged
        (8, a, f, None, "x", "", "import"),
        (9, a, f, None, "g", "/ws/r/src/a.ts", "call"),  # another file's symbol
        (10, a, f, None, "g", "/ws/r/lib", "call"),
        (11, a, f, None, "missing", None, "call"),
        (12, a, f, None, "log", None, "call"),  # provided by the language
        (13, a, "/ws/other/a.ts", None, "f", None, "call"),  # of another repository
        (14, a, None, None, "missing", None, "call"),
        (15, None, f, None, None, None, "call"),
        (2, "/ws/r/nope:3", f, None, "f", None, "call"),
    ]
    assert found(spark, edges) == {(2, "from_chunk_id"), (7, "to_file"), (8, "to_file"), (9, "to_symbol"), (11, "to_symbol"), (13, "to_symbol")}


def test_small_filter_gives_the_same(spark, filter_form):
    edges = [(i, f"/ws/r/x{i}:1", "/ws/r/src/a.ts", None, "f", None, "call") for i in range(300)]
    got = {(r["edge_id"]) for r in orphan_references(*tables(spark, edges), blocks=1).collect()}
    assert got == set(range(300))


def test_a_filter_of_its_keys_passes_few_others(spark, filter_form):
    keys = spark.range(200_000).select(F.concat(F.lit("k"), "id").alias("k"))
    n = O.blocks_for(200_000)
    filt = O.bloom(keys, n)
    assert O.maybe_held(keys, filt, n).where("not maybe").count() == 0
    absent = spark.range(200_000).select(F.concat(F.lit("absent"), "id").alias("k"))
    assert O.maybe_held(absent, filt, n).where("maybe").count() < 0.02 * 200_000


def test_empty_tables_and_report(spark, filter_form):
    e, c, m, n = tables(spark, [(1, "x", "/ws/r/a.ts", None, "f", "/p", "call")])
    assert orphan_references(e.limit(0), c, m, n).count() == 0
    assert {r["ref_field"] for r in orphan_references(e, c.limit(0), m.limit(0), n.limit(0)).collect()} == {"from_chunk_id", "to_file"}
    assert [tuple(r) for r in orphan_report(e.union(e), c, m, n).orderBy("ref_field").collect()] == [("chunks", "from_chunk_id", "2026-01", 1), ("manifest", "to_file", "2026-01", 1)]


def stamp(*seconds):
    return [("u", T0 + dt.timedelta(seconds=s), 50, 150, i) for i, s in enumerate(seconds)]


CALLS = "session_id string, called_at timestamp, tokens_sent int, tokens_estimated int, call_id int"


def test_sessions_reset_after_the_limit(spark):
    df = spark.createDataFrame(stamp(0, 100, 201, 400), CALLS)
    out = K.session_totals(df, "session_id", "called_at", 100, "tokens_sent", "tokens_estimated", "call_id").orderBy("session_no").collect()
    assert [(r["tokens_sent"], r["calls"]) for r in out] == [(100, 2), (50, 1), (50, 1)]


def test_sessions_over_days_and_of_a_null_key(spark):
    day = 86_400
    times = [0, 50, day - 10, day + 10, day + 500, 3 * day, 3 * day + 5]
    rows = [(key, T0 + dt.timedelta(seconds=s), 1, 1, i) for key in ("u", None) for i, s in enumerate(times)] + [("u", None, 1, 1, 99)]
    got = K.sessionize(spark.createDataFrame(rows, CALLS), "session_id", "called_at", 100, "call_id").orderBy("session_id", "call_id").collect()
    assert [r["session_no"] for r in got] == [1, 1, 2, 2, 3, 4, 4] * 2


def test_streams_agree_with_batch(spark, tmp_path):
    rows = stamp(0, 50, 400, 420, 4000)
    spark.createDataFrame(rows, CALLS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CALLS).parquet(str(tmp_path / "in"))
    out = K.stream_session_totals(stream, "session_id", "called_at", "100 seconds", "10 seconds", "tokens_sent", "tokens_estimated")
    q = out.writeStream.format("memory").queryName("totals").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["calls"] for r in spark.table("totals").collect()) == [2, 2]
    b = K.stream_bursts(spark.readStream.schema(CALLS).parquet(str(tmp_path / "in")), "session_id", "called_at", "100 seconds", "10 seconds")
    q = b.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n_events"] for r in spark.table("bursts").collect()) == [2, 2]


def test_bursts(spark):
    df = spark.createDataFrame(stamp(0, 5, 100), CALLS)
    assert sorted(r["n_events"] for r in K.bursts(df, "session_id", "called_at", 10).collect()) == [1, 2]
    assert K.bursts(df.limit(0), "session_id", "called_at", 10).count() == 0
    assert K.sessionize(df.withColumn("called_at", F.lit(None).cast("timestamp")), "session_id", "called_at", 10).count() == 0
