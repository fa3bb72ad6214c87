"""Listing of trees, incremental runs, and the service's totals."""

import json
import os
import time

import pytest

from strataloom import index as I
from strataloom import service
from strataloom.operators import embed
from strataloom.sources import files


def tree(at, names):
    for n, text in names.items():
        (at / n).parent.mkdir(parents=True, exist_ok=True)
        (at / n).write_text(text)
    return str(at)


def rels(spark, root, **kw):
    return sorted(r["rel"] for r in files.list_files(spark, root, **kw).collect())


@pytest.mark.parametrize("spread", [1, 2, 256])
def test_listing(spark, tmp_path, monkeypatch, spread):
    monkeypatch.setattr(files, "SPREAD", spread)
    kept = ["src/__init__.py", "src/__tests__/a.test.ts", "_lib/u.ts", "src/_app.tsx", "src/a.ts", "keep.ts", "deep/a/b/c/d.go"]
    left = [".hidden/x.ts", "src/.eslintrc.js", "node_modules/x/i.js", "a/dist/x.js", "pkg.egg-info/a.txt", "x.min.js", "Cargo.lock", "image.png", "gen/out.ts", "keep.log.ts", "extra.ts"]
    root = tree(tmp_path, {n: "x" for n in kept + left} | {".gitignore": "# generated\ngen/\n*.ts\n!src/**\n!_lib/*.ts\n!keep.ts\n"})
    assert rels(spark, root, ignore=["extra.ts"]) == sorted(kept)
    assert rels(spark, tree(tmp_path / "none", {"a.png": ""})) == []


def test_only_wanted_files_are_opened(spark, tmp_path):
    root = tree(tmp_path, {"a.ts": "let a = 1", "secret.ts": "x", "bad.ts": "x"})
    (tmp_path / "bad.ts").write_bytes(b"\xff\xfe ok")
    os.utime(tmp_path / "secret.ts", (1, 1))
    before = os.stat(tmp_path / "secret.ts").st_atime_ns
    got = files.read_files(spark, root, spark.createDataFrame([(f"{root}/a.ts",), (f"{root}/gone.ts",), (f"{root}/bad.ts",)], "path string")).collect()
    assert {(r["path"].rsplit("/", 1)[1], r["content"], r["token_count"]) for r in got} == {("a.ts", "let a = 1", 4), ("bad.ts", "�� ok", 2)}
    assert os.stat(tmp_path / "secret.ts").st_atime_ns == before


def data(ix):
    return sorted(os.path.relpath(os.path.join(f, n), ix) for f, _, names in os.walk(os.path.join(ix, "data")) for n in names if n.endswith(".parquet"))


def test_runs_write_only_what_changed(spark, tmp_path):
    root = tree(tmp_path / "p", {f"src/f{i}.ts": f"export function f{i}(x) {{ return g{i}(x); }}\n" for i in range(30)})
    ix = str(tmp_path / "ix")
    first = I.build_index(spark, root, ix)
    assert (first["new"], first["chunkCount"], first["skipped"]) == (30, 30, 0)
    was, state = data(ix), open(os.path.join(ix, "CURRENT.json")).read()
    again = I.build_index(spark, root, ix)
    assert (again["new"], again["changed"], again["removed"], again["unchanged"]) == (0, 0, 0, 30)
    assert data(ix) == was and open(os.path.join(ix, "CURRENT.json")).read() == state
    (tmp_path / "p/src/f3.ts").write_text("export function other(x) { return x; }\n")
    third = I.build_index(spark, root, ix)
    assert (third["changed"], third["unchanged"], third["chunkCount"]) == (1, 29, 30)
    new = [p for p in data(ix) if p not in was]
    assert 0 < len({p.split("/")[3] for p in new}) <= 2  # of one bucket or, for the manifest, another
    assert {r["name"] for r in I.load(spark, ix, "chunks").collect()} == {f"f{i}" for i in range(30) if i != 3} | {"other"}
    for i in range(3):
        (tmp_path / "p/src/f3.ts").write_text(f"export function other{i}(x) {{ return x + {i}; }}\n")
        I.build_index(spark, root, ix)
    assert len(data(ix)) < len(was) + 8  # old folders are gone
    os.remove(tmp_path / "p/src/f4.ts")
    last = I.build_index(spark, root, ix)
    assert (last["removed"], last["fileCount"]) == (1, 29) and "f4" not in {r["name"] for r in I.load(spark, ix, "chunks").collect()}
    assert I.build_index(spark, root, ix, model="other")["new"] == 29


def test_a_failed_run_leaves_the_index(spark, tmp_path):
    root, ix = tree(tmp_path / "p", {"a.ts": "function a() {}\n"}), str(tmp_path / "ix")
    I.build_index(spark, root, ix)
    (tmp_path / "p/b.ts").write_text("function b() {}\n")

    def slow(texts):
        time.sleep(5)
        return [[1.0] * 64 for _ in texts]

    with pytest.raises(Exception, match="timed out"):
        I.build_index(spark, root, ix, embedder=slow, embed_seconds=0.1)
    assert {r["name"] for r in I.load(spark, ix, "chunks").collect()} == {"a"}


@pytest.mark.parametrize("path", ["/", "~", "/etc", "/etc/x", "/var/log", "~/.ssh", "~/.aws/x", "~/.gnupg", "~/.config/y"])
def test_forbidden_roots(path):
    with pytest.raises(ValueError):
        I.check_root(os.path.expanduser(path))


def test_allowed_roots():
    assert I.check_root("/usr/lib") and I.check_root("/var/folders/ab")


def test_service_indexes_on_demand_and_keeps_totals(spark, tmp_path):
    root = tree(tmp_path, {"src/a.ts": "export function loadConfig(p) { return parse(p); }\n", "src/b.ts": "export function parse(x) { return x; }\n"})
    out = service.search(spark, root, "where is loadConfig", embed.hashed_words(64), threshold=2.0)
    assert out["hits"][0]["name"] == "loadConfig" and "loadConfig" in service.format_hits(out)
    at = os.path.join(service.index_of(root), "session-stats.json")
    assert service.read_stats(at)["callCount"] == 1
    assert service.build_context(spark, root, "loadConfig", embed.hashed_words(64))["tokensSent"] >= 0
    assert service.read_stats(at)["callCount"] == 2
    assert "error" in service.search(spark, str(tmp_path / "none"), "x")
    line = service.status_line(at, "idle", "saved {} ({} %)", ", last {}", str)
    assert line.startswith("saved ") and ", last " in line


def test_totals_expire(tmp_path):
    at = str(tmp_path / "s" / "stats.json")
    assert service.read_stats(at) is None and service.accumulate(at, 10, 100)["callCount"] == 1
    assert service.accumulate(at, 5, 50)["tokensSent"] == 15
    s = json.load(open(at)) | {"lastUpdatedAt": "2020-01-01T00:00:00+00:00"}
    json.dump(s, open(at, "w"))
    assert service.read_stats(at) is None and service.status_line(at, "idle", "", "", str) == "idle"
    assert service.accumulate(at, 1, 2)["callCount"] == 1
    open(at, "w").write("{")
    assert service.read_stats(at) is None


def test_logs_hide_values():
    assert service.redact_log('call failed: api_key="abc123", x=1') == 'call failed: api_key="[redacted]", x=1'
