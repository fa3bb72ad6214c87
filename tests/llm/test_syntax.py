"""Grammars on valid and broken snippets of each language, and the verdicts over files."""

from collections import Counter

import pyarrow as pa
import pytest

from strataloom.llm import syntax
from strataloom.llm.pushdown import Grammar

VALID = [
    ("ts", "file", "import a, { b as c, type D } from './x.js';\nimport * as fs from 'node:fs'\nexport * from './y'\nexport default class extends A.B<C> { }\n"),
    ("ts", "file", "const f = async <T,>(a: T, ...r: number[]): Promise<T> => { await g(a!); return a as unknown as T }\nlet x = y\n  .map((it) => ({ it }))\nfor (const [k, v] of Object.entries(o)) { if (k) continue; else break }\n"),
    ("ts", "file", "const t = `${a ?? `${b}}`} (open`; const r = raw.replace(/[{}()\\[\\]'\"]/g, '').split(/\\s+/); label: while (1) { break label }\n"),
    ("ts", "file", "interface A<T extends B = C> extends D { a?: string; readonly [k: string]: T, m(x: number): void }\ntype M = { [K in keyof T]?: T[K] extends infer U ? U : never }\nenum E { A = 1, B }\ndeclare module 'x' { export const y: number }\nabstract class Q { private static async *go<T>(): AsyncGenerator<T> {} get a() { return 1 } #p = 2; static { } }\n"),
    ("ts", "file", "switch (a) { case 'x': f(); break; default: break }\ntry { a() } catch { b() } finally { c() }\nif (a < b && c > d) e = f >>> 2; x >>= 1; y ||= z ? 1 : 2; new Foo<Bar>(1); a?.[0]?.b?.(c); void 0; delete a.b\n"),
    ("ts", "file", "if (a) /re/.test(b); while (x) /[)]/.exec(y); const z = (a) / 2 / b;\n"),
    ("tsx", "file", "const a = <div className=\"x\" {...p} on={() => <b/>}>{c} it&apos;s <>ok</></div>;\nconst g = <T,>(x: T) => x;\n"),
    ("ts", "function", "async (a: string) => a + 1"), ("ts", "function", "function* g() { yield* h() }"), ("ts", "method", "static async load(a, b = {}): Promise<void> { for await (const x of y) { } }"), ("ts", "class", "class A { b: string; c = 1\n d() {} }"),
    ("py", "file", "match x:\n    case {'a': 1, **r}: pass\n\nasync def f(a, /, b, *, c=1) -> int:\n    return (y := 2)\n"), ("py", "method", "def f(self):\n        return 1\n"), ("py", "method", "@property\n    def f(self):\n        return 1\n"),
    ("go", "file", "package a\n\nimport (\n\t\"fmt\"\n)\n\ntype T[K comparable, V any] struct {\n\ta, b map[K][]V `json:\"x\"`\n\t*fmt.X\n}\n\nfunc (t *T[K, V]) F(a int, b ...string) (x int, err error) {\n\tif v, ok := m[a]; ok && v > 1 {\n\t\treturn 1, nil\n\t} else if x := T{1, 2}; x.a {\n\t}\n\tfor i, v := range []int{1, 2} { go func() { ch <- i }() }\n\tswitch y := z.(type) { case int, *T: default: }\n\tselect { case v := <-ch: _ = v }\n\traw := `a { ( \" `\n\tdefer f(x...)\n\tx++\n\treturn\n}\n"),
    ("go", "function", "func f(a, b int) {}"),
    ("rs", "file", "use std::{fmt, io::*};\n#[derive(Debug)]\npub struct A<'a, T: Fn(i32) -> i32 + 'a> where T: Clone { pub a: &'a T, b: [u8; 4] }\nimpl<'a, T> A<'a, T> { pub(crate) async fn f(&mut self, x: impl Fn()) -> Result<(), Box<dyn E>> { let v: Vec<&'a str> = x.iter().map(|it| it.as_str()).collect::<Vec<_>>(); match v { Some(n @ 1..=5) | None if a => {} _ => return Ok(()), } if let Some(x) = y && z { } 'l: loop { break 'l; } println!(\"{{}} {}\", r#\"a \" {\"#); a.0.1?; 1..; -x as u8 } }\nmacro_rules! m { ($a:expr) => { $a }; }\n"),
    ("rs", "function", "fn f(&self) -> usize { if ch == '{' || ch == '\\'' { depth += 1; } 0 }"),
]
BROKEN = [
    ("ts", "file", "function f() {\n  const a = g("), ("ts", "file", "const x1 = ] + 4;"), ("ts", "file", "const x = total(1, (2);"), ("ts", "file", "<<<<<<< HEAD\nconst a = 1;\n=======\nconst a = 2;\n>>>>>>> x\n"), ("ts", "file", "def f(a):\n    return a\n"), ("ts", "file", "const a = 'open;\n"),
    ("ts", "file", "const a = <div>x</div>;"), ("tsx", "file", "const a = <div>x</span>;"), ("ts", "file", "a b"), ("ts", "file", "This is prose. It goes on, with words."), ("ts", "class", "class A { const x = 1; }"), ("ts", "function", "function f() {} function g() {}"), ("ts", "file", "/* open"), ("ts", "file", "`${a"), ("ts", "file", "}"),
    ("py", "file", "def f(:\n    pass"), ("py", "file", "print 'x'"), ("py", "function", "just_a_name"),
    ("go", "file", "func f() {}"), ("go", "file", "package a\nfunc f() {\n\tx1 := ] + 4\n}\n"), ("go", "function", "func f() {\n=======\n}"), ("go", "file", "package a\nfunc f() { if x { return }"), ("go", "function", "func f() { s := \"open\n}"),
    ("rs", "file", "fn f() { let x = ; }"), ("rs", "file", "package main\nfunc f() {}"), ("rs", "function", "fn f() -> usize { match a { Some(x) => g(x),"), ("rs", "file", "/* /* nested */"), ("rs", "file", "<!doctype html>"),
]


STATISTICS: dict = {}
for _ext, _, _text in VALID:
    _counts = STATISTICS.setdefault(syntax.LANGUAGES[_ext], {})
    for _t in syntax.tokens_of(_text):
        _counts[_t] = _counts.get(_t, 0) + 1


@pytest.mark.parametrize("ext,kind,text", VALID)
def test_valid(ext, kind, text):
    assert syntax.PARSERS[syntax.LANGUAGES[ext]](text, kind)
    assert syntax.PARSERS[syntax.LANGUAGES[ext]](text.replace("\n", "\r\n"), kind)


@pytest.mark.parametrize("ext,kind,text", BROKEN)
def test_broken(ext, kind, text):
    assert not syntax.PARSERS[syntax.LANGUAGES[ext]](text, kind)


def test_automaton_against_recursion():
    g = Grammar("s: [ 'a' s 'b' ] { 'c' }\n", ("s",))
    assert g.accepts(list("aacbcbcc"), "s") and g.accepts([], "s")
    assert not g.accepts(list("aab"), "s") and not g.accepts(list("ba"), "s")


def test_tables_may_start_anew(monkeypatch):
    from strataloom.llm import pushdown, syntax_go

    monkeypatch.setattr(pushdown, "MAX_SETS", 1)
    assert all(syntax_go.valid("func f() { g(1) }", "function") for _ in range(3))


def test_tokens_rank_languages():
    r = syntax.Ranking(STATISTICS)
    assert r.rank("def g(b):\n    return b if b is None else f(b)\n")[0] == "python"
    assert r.rank("func g(b int) error {\n\treturn nil\n}")[0] == "go"
    assert syntax.Ranking({}).rank("x") == list(syntax.PARSERS)


def test_several_foreign_grammars_the_likeliest_names_the_language():
    r = syntax.Ranking(STATISTICS)
    verdict, by = syntax.verdict("x = f(1)", "file", "go", r)
    assert set(by) >= {"python", "typescript"} and verdict == by[0] == r.rank("x = f(1)")[0]


def test_verdicts():
    assert syntax.judge("def f(a):\n    return a\n", "file", "typescript") == "python"
    assert syntax.judge("func f() int { return 1 }", "function", "python") == "go"
    assert syntax.judge("fn f( {", "file", "rust") == "corrupt"
    assert syntax.judge("", "file", "rust") == syntax.judge(None, "file", "go") == syntax.judge(" \n", "class", "python") == "ok"


def test_files_and_rates(spark):
    rows = [("/ws/r/a.ts", "const a = 1;", "file"), ("/ws/r/a.ts", "function f( {", "function"), ("/ws/r/b.py", "package x\n", "file"), ("/ws/r/c.go", "", "file"), ("/ws/r/d.rs", None, "file"), ("/ws/r/e.md", "a b c", "file"), ("/ws/r/a.ts", "function f( {", "function")]
    df = spark.createDataFrame([(*r, "file", "clash") for r in rows], "file_path string, content string, chunk_type string, source_kind string, language string")
    got = {r["file_path"]: (r["valid"], r["reads_as"]) for r in syntax.judge_files(df).collect()}
    assert got == {"/ws/r/a.ts": (False, "corrupt"), "/ws/r/b.py": (False, "go"), "/ws/r/c.go": (True, None), "/ws/r/d.rs": (True, None)}
    rate = {r["language"]: (r["n_files"], r["n_invalid"], r["n_wrong_extension"]) for r in syntax.rates(syntax.judge_files(df)).collect()}
    assert rate["python"] == (1, 1, 1) and rate["typescript"] == (1, 1, 0)
    assert syntax.judge_files(df.limit(0)).count() == 0


def test_no_token_is_dropped(monkeypatch):
    monkeypatch.setattr(syntax, "HELD", 1000, raising=False)
    rows = [("/ws/r/a.py", " ".join(f"w{i}" for i in range(3000))), ("/ws/r/b.go", "w1 w1 zz"), ("/ws/r/c.py", "w2999 rare"), ("/ws/r/d.py", None)]
    want, got = Counter(), Counter()
    for path, text in rows:
        want.update((syntax.LANGUAGES[path.rsplit(".", 1)[1]], t) for t in syntax.tokens_of(text or ""))
    for batch in syntax._count(pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[r])], ["file_path", "content"]) for r in [(p, t or "") for p, t in rows]):
        for r in batch.to_pylist():
            got[r["language"], r["token"]] += r["n"]
    assert got == want


@pytest.mark.parametrize("parts", [1, 3])
def test_a_rare_token_tells_languages_apart(spark, parts):
    words = "\n".join(f"w{i}; w{i}" for i in range(2500)) + "\n"
    rows = [("/ws/r/a.py", words + "hush"), ("/ws/r/b.ts", words + "mute"), ("/ws/r/c.tsx", words + "numb"), ("/ws/r/d.rs", ""), ("/ws/r/e.go", "hush"), ("/ws/r/f.go", "mute"), ("/ws/r/g.go", "numb"), ("/ws/r/h.go", "1"), ("/ws/r/i.rs", "hush = mute"), ("/ws/r/j.py", "const mute = 1")]
    df = spark.createDataFrame([(*r, "file", "file") for r in rows], "file_path string, content string, chunk_type string, source_kind string").repartition(parts)
    got = {r["file_path"][6:]: r["reads_as"] for r in syntax.judge_files(df).collect()}
    assert [got[x] for x in ("e.go", "f.go", "g.go", "h.go")] == ["python", "typescript", "tsx", "typescript"]
    counts = {}
    for path, text in rows:
        counts.setdefault(syntax.LANGUAGES[path.rsplit(".", 1)[1]], Counter()).update(syntax.tokens_of(text))
    whole = syntax.Ranking(counts)
    assert got == {p[6:]: None if v == "ok" else v for p, t in rows for v in [syntax.verdict(t, "file", syntax.LANGUAGES[p.rsplit(".", 1)[1]], whole)[0]]}
