"""Chunkers, ignore rules, log parser, embedding stage, and an index from a tree to a context."""

import os

import pytest
from pyspark.sql import functions as F

from strataloom import index as I
from strataloom.operators import embed
from strataloom.sources import code_scan, commits, doc_scan, files

TS = """import { a } from './x.js';
boot();
export const go = async (x: number) => { await run(x); };
export abstract class Foo<T> extends Bar {
  constructor(private a: string) { super(a); }
  async load(x = `${y(`{`)}`): Promise<{ a: string }> {
    const r = raw.replace(/[{}()]/g, '');
    return [1].map((it) => it.go());
  }
}
function outer(a: string): string;
function outer(a) {
  return inner(function named() { return 2; });
}
"""


def parts(path, text):
    return [(c["chunk_type"], c["scope"], c["name"], c["start_line"], c["end_line"]) for c in code_scan.chunk_code(path, text)[0]]


def test_typescript():
    assert parts("/r/a.ts", TS) == [("function", None, None, 3, 3), ("class", None, "Foo", 4, 10), ("method", "Foo", "constructor", 5, 5), ("method", "Foo", "load", 6, 9), ("function", None, "outer", 12, 14), ("function", None, "named", 13, 13)]
    edges = code_scan.chunk_code("/r/a.ts", TS)[1]
    assert [(e["from_chunk_id"], e["to_symbol"], e["to_file"]) for e in edges] == [("/r/a.ts:0", "./x.js", "/r/x.js"), ("/r/a.ts:0", "boot", None), ("/r/a.ts:2", "run", None), ("/r/a.ts:5", "y", None), ("/r/a.ts:5", "replace", None), ("/r/a.ts:5", "map", None), ("/r/a.ts:5", "go", None), ("/r/a.ts:11", "inner", None)]


def test_other_languages():
    assert parts("a.py", "@d\ndef f(a):\n    g(a)\n\nclass C:\n    async def m(self):\n        pass\n") == [("function", None, "f", 2, 3), ("class", None, "C", 5, 7), ("function", "C", "m", 6, 7)]
    assert parts("a.py", "def f(:\n    pass\n") == [("function", None, "f", 1, 2)]
    assert parts("a.go", "package x\nfunc (s *T) Run(a int) error {\n\treturn do(a)\n}\nfunc New() *T {\n\treturn nil\n}\n") == [("method", None, "Run", 2, 4), ("function", None, "New", 5, 7)]
    assert parts("a.rs", "pub fn a(s: &str) -> usize { call(s) }\nimpl Foo {\n fn b(&self) {}\n}\n") == [("function", None, "a", 1, 1), ("class", None, None, 2, 4), ("function", None, "b", 3, 3)]


def test_fallback_and_unknown():
    assert parts("t.ts", "export type A = { b: string };\n") == [("file", None, None, 1, 2)]
    assert code_scan.chunk_code("a.json", "{}") == ([], [])
    assert parts("e.ts", "") == [("file", None, None, 1, 1)]


def test_markdown():
    got = doc_scan.chunk_markdown("---\na: 1\n---\nintro\n## Hello\n\nWorld\n### Deep\nx\n## Bye\nend\n# B\nmore\n```\n## no\n```")
    assert got == [(None, None, "intro", 4), ("Hello", "## Hello > ### Deep", "World\n### Deep\nx", 7), ("Bye", "# B", "end\n# B\nmore\n```\n## no\n```", 11)]
    assert doc_scan.chunk_markdown("") == []


def test_oversized_sections_are_packed():
    para = "w " * 900
    assert [len(c.split()) for _, _, c, _ in doc_scan.chunk_markdown("\n\n".join([para, para, "x " * 1600, "end"]))] == [900, 900, 1600, 1]
    sizes = [len(c.split()) for c, _ in doc_scan.pack("\n\n".join([para, "a b", para]), 1, doc_scan.words)]
    assert sizes == [902, 900]


@pytest.mark.parametrize("rules,path,want", [(["*.log"], "a/b.log", True), (["/build"], "build/x.ts", True), (["/build"], "a/build/x.ts", False), (["tmp/"], "a/tmp/x.ts", True), (["*.ts", "!keep.ts"], "keep.ts", False), (["docs/**/x.ts"], "docs/a/b/x.ts", True), (["# c", ""], "a.ts", False)])
def test_ignore_rules(spark, rules, path, want):
    assert spark.range(1).select(files.ignored(F.lit(path), files.ignore_rules(rules)).alias("x")).first()["x"] is want


def test_git_log(spark):
    log = "\x1eCOMMIT\x1eabc\x1eMe\x1e2026-01-02T03:04:05+00:00\nfix: x\n\nbody\n3\t1\tsrc/a.ts\n-\t-\timg.png\nbad\tline\n\x1eCOMMIT\x1edef\x1eYou\x1enever\nempty"
    a, b = commits.parse_log(spark.createDataFrame([(log,), (None,), ("",)], "log string"), "log").collect()
    assert (a["short_hash"], a["date"], a["message"]) == ("abc", "2026-01-02T03:04:05.000Z", "fix: x\n\nbody")
    assert [tuple(f) for f in a["files"]] == [("src/a.ts", 3, 1), ("img.png", 0, 0)]
    assert (b["date"], b["message"], b["files"]) == ("never", "empty", [])


def test_embed_isolates_bad_texts_in_few_calls():
    calls = []

    def embedder(texts):
        calls.append(len(texts))
        if any("BAD" in t for t in texts):
            raise embed.TooLong("context length")
        return [[1.0] for _ in texts]

    assert embed.embed_batch(["a", "BAD", "c", "d", "e", "BAD", "g", "h"], embedder) == [[1.0], None, [1.0], [1.0], [1.0], None, [1.0], [1.0]]
    assert len(calls) < 16
    assert embed.embed_batch([], embedder) == []


def test_embed_retries_once():
    seen = []

    def embedder(texts):
        seen.append(1)
        if len(seen) == 1:
            raise OSError("Connection refused")
        return [[1.0] for _ in texts]

    assert embed.embed_batch(["a"], embedder, 0) == [[1.0]]
    with pytest.raises(OSError):
        embed.embed_batch(["a"], lambda t: (_ for _ in ()).throw(OSError("disk full")), 0)


def test_index_end_to_end(spark, tmp_path):
    src = tmp_path / "proj" / "src"
    src.mkdir(parents=True)
    (src / "a.ts").write_text("import { parse } from './b';\nexport function loadConfig(p) { return parse(p); }\n")
    (src / "b.ts").write_text("export function parse(x) { return x; }\n")
    (tmp_path / "proj" / "README.md").write_text("## Hello\nload the config file\n")
    root, ix = str(tmp_path / "proj"), str(tmp_path / "index")
    with pytest.raises(I.NoIndexError):
        I.read_state(ix)
    first = I.build_index(spark, root, ix)
    assert (first["new"], first["changed"], first["removed"], first["chunkCount"]) == (3, 0, 0, 3)
    (src / "b.ts").write_text("export function parse(x) { return x + 1; }\n")
    os.remove(tmp_path / "proj" / "README.md")
    second = I.build_index(spark, root, ix)
    assert (second["new"], second["changed"], second["removed"], second["unchanged"], second["chunkCount"]) == (0, 1, 1, 1, 2)
    assert sorted(r["content"] for r in I.load(spark, ix, "chunks").collect())[1] == "function parse(x) { return x + 1; }"
    forced = I.build_index(spark, root, ix, force=True)
    assert forced["chunkCount"] == 2
    e = embed.hashed_words(64)
    assert I.find(spark, ix, "where is loadConfig", e, threshold=2.0).orderBy("rank").first()["name"] == "loadConfig"
    assert I.find(spark, ix, "loadConfig parse").count() == 2
    c = I.build_context(spark, ix, "explain loadConfig", e, threshold=2.0)
    assert "// File:" in c["content"] and c["tokensSent"] <= 4096 and c["filesInContext"] == 2
    assert I.status(spark, ix, root)["fileCount"] == 2
    with pytest.raises(ValueError):
        I.build_index(spark, "/etc", ix)
