"""Watch loop, manifest import, health and the embedder's time limit."""

import json
import time

import pytest

from strataloom import index as I
from strataloom.operators import embed
from strataloom.streaming import watch as W


def test_a_burst_gives_one_run(spark):
    states = iter([[1], [1], [2], [3], [3], [3], [3], [3]])
    said, runs = [], []
    n = W.watch(spark, "/x", lambda: runs.append(1) or {"new": 1}, said.append, every=0.01, quiet=0.02, rounds=7, listing=lambda: next(states))
    assert n == len(runs) == 1 and said[0].startswith("re-indexed (1 new, 0 changed, 0 removed) in ")


def test_a_locked_index_is_skipped(spark):
    states = iter([[1], [2], [2], [2], [2], [2]])

    def busy():
        raise RuntimeError("another run is indexing; try again later")

    said = []
    assert W.watch(spark, "/x", busy, said.append, every=0.01, quiet=0.02, rounds=5, listing=lambda: next(states)) == 0
    assert said == ["skipped: another run is indexing; try again later"]


def test_changes(spark, tmp_path):
    (tmp_path / "a.ts").write_text("a")
    (tmp_path / "b.ts").write_text("b")
    before = spark.createDataFrame(W.stamps(spark, str(tmp_path)).collect(), "path string, sha256 string")
    (tmp_path / "a.ts").write_text("longer")
    (tmp_path / "b.ts").unlink()
    (tmp_path / "c.py").write_text("c")
    (tmp_path / "d.json").write_text("d")
    got = {r["path"].rsplit("/", 1)[1]: r["status"] for r in W.changes(before, W.stamps(spark, str(tmp_path))).collect()}
    assert got == {"a.ts": "changed", "b.ts": "removed", "c.py": "new"}


def test_manifest_import(spark, tmp_path):
    new, old, bad = (tmp_path / n for n in ("new.json", "old.json", "bad.json"))
    new.write_text(json.dumps({"hashes": {"/a": "h1", "/b": "h2"}, "tokenCounts": {"/a": 3}, "stats": {"/a": {"size": 5, "mtimeMs": 7}}}))
    old.write_text(json.dumps({"/a": "h1"}))
    bad.write_text("{")
    assert sorted(map(tuple, I.import_manifest(spark, str(new)).collect())) == [("/a", "h1", 3, 5, 7.0), ("/b", "h2", None, None, None)]
    assert [tuple(r) for r in I.import_manifest(spark, str(old)).collect()] == [("/a", "h1", None, None, None)]
    assert I.import_manifest(spark, str(bad)).count() == I.import_manifest(spark, str(tmp_path / "none")).count() == 0


def test_health_without_index(spark, tmp_path):
    assert not any(I.health(spark, str(tmp_path)).values())


def test_embedder_time_limit():
    slow = embed.within(lambda texts: time.sleep(1) or [[1.0]], 0.05)
    with pytest.raises(TimeoutError, match="timed out"):
        slow(["a"])
    assert embed.within(lambda t: [[1.0]])(["a"]) == [[1.0]]
