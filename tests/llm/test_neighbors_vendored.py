"""Nearest vectors against brute force; vendored, generated, minified and data files on planted cases."""

import random

import numpy as np

from strataloom.llm import neighbors, vendored

VEC = "id string, vector array<float>, vec string"


def brute(rows, k=5, dim=64):
    d = {i: v for i, v, *_ in rows if v is not None and len(v) == dim and any(v)}
    ids = sorted(d)
    x = np.array([d[i] for i in ids], dtype=np.float32).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s, out = np.round(u @ u.T, 12), set()
    for j in range(len(ids)):
        s[j, j] = -9
        for n in np.lexsort((np.arange(len(ids)), -s[j]))[:k]:
            if n != j:
                out.add((min(ids[j], ids[n]), max(ids[j], ids[n])))
    return out


def found(spark, rows, **kw):
    return set(map(tuple, neighbors.neighbor_pairs(spark.createDataFrame(rows, VEC), **kw).collect()))


def test_equals_brute_force_with_copies_and_ties(spark):
    rng = random.Random(1)
    rows = [(f"id{n:05d}", [rng.random() - 0.5 for _ in range(64)] if n % 3 else [1.0] * 64, "clash") for n in range(600)]
    rows += [(f"scaled{n}", [2.0 + n] * 64, "") for n in range(9)] + [("nul", None, ""), ("zero", [0.0] * 64, ""), ("short", [1.0] * 5, ""), (None, [1.0] * 64, "")]
    rows += rows[:20]
    assert found(spark, rows, block_rows=150) == brute([r for r in rows if r[0]])


def test_blocks_parts_and_slices(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 64))
    near = [(f"n{i:04d}", [float(x) for x in np.float32(base[i % 12 if i % 3 else 0] + rng.normal(size=64) * 0.4)], "") for i in range(900)]
    want = brute(near)
    monkeypatch.setattr(neighbors, "VISITORS", 100)
    assert found(spark, near, block_rows=60, clusters=9, probes=None) == want  # exact over clusters, parts of the large one and slices
    got = found(spark, near, block_rows=60, clusters=9, probes=3)
    assert len(got & want) >= 0.9 * len(want)
    assert got == found(spark, near[::-1], block_rows=60, clusters=9, probes=3)  # the same in every run


def test_an_id_with_two_vectors_has_the_neighbours_of_each(spark):
    a, b = [1.0, 2.0], [2.0, 1.0]
    rows = [("x", b, ""), ("x", a, ""), ("y", a, ""), ("z", b, "")]
    assert found(spark, rows, dim=2, k=1) == found(spark, rows[::-1], dim=2, k=1) == {("x", "y"), ("x", "z")}


def test_few_and_none(spark):
    rows = [(f"i{n}", [float(n + 1), 1.0], "") for n in range(3)]
    assert found(spark, rows, dim=2) == brute(rows, dim=2)
    assert found(spark, rows[:1], dim=2) == set()
    assert neighbors.neighbor_pairs(spark.createDataFrame([], VEC)).count() == 0


def test_quantised_bound_holds():
    rng = np.random.default_rng(2)
    u = rng.normal(size=(200, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    c = neighbors.Codes(u)
    near = c.code * c.scale[:, None]
    bound = c.miss[:, None] + c.size[:, None] * c.miss[None, :]
    assert (np.abs(u @ u.T - near @ near.T) <= bound + 1e-12).all()


def release(rng, n=30):
    body = []
    for i in range(n):
        a, b = (rng.choice("alpha beta gamma delta omega sigma theta kappa".split()) + str(rng.randrange(10**6)) for _ in range(2))
        body.append(f"export function {a}(x, y) {{\n  const {b} = x.{a} + {rng.randrange(999)};\n  return {b} > y ? {a}(y, {b}) : x;\n}}")
    return "\n\n".join(body)


def test_files(spark):
    rng = random.Random(3)
    lib, spread = release(rng), release(rng)
    own = [release(rng) for _ in range(6)]
    changed = "// local header\n" + lib.replace("\n  ", "\n      ").replace("return", "return ", 2).replace("999", "998") + "\nexport const extra = 1;\n"
    gen = "\n".join(f"export class Order{i}Message {{\n  static typeName = 'v1.Order{i}';\n  a = null;\n}}" for i in range(4))
    mini = "!function(a){try{a.b(c)}catch(d){}}(this);" * 30
    data = "export const t = [\n" + "  0.1234, 0.5678, 99, -3,\n" * 80 + "];\n"
    rows = [("/ws/r0/lib/copy.js", "file", changed), ("/ws/r0/vendor/own.js", "file", own[0]), ("/ws/r1/src/generated/notes.js", "file", "// skips files that start with @generated\n" + own[1])]
    rows += [(f"/ws/r{i}/x/spread.js", "file", spread) for i in range(2, 5)] + [(f"/ws/r{i}/src/main.js", "file", release(rng, 120)) for i in range(2, 5)]  # repositories of their own
    rows += [("/ws/r5/a.js", "file", gen), ("/ws/r5/b.js", "file", "/*\n * Code generated by protoc. DO NOT EDIT.\n */\n" + own[2]), ("/ws/r5/c.js", "file", mini), ("/ws/r5/d.js", "file", data)]
    rows += [("/ws/r6/e.js", "file", own[3] + "\nconst line = '" + "word " * 120 + "';\n"), ("/ws/r6/f.js", "file", own[4] + "\nexport const small = [1, 2, 3, 4, 5];\n"), ("/ws/r6/empty.js", "file", ""), ("/ws/r6/null.js", "file", None), ("/ws/r6/README.md", "file", data)]
    rows += [("/ws/r6/parts.js", "function", own[5])] * 2
    rows += [("/ws/r7/order.pb.go", "method", f'func (x *Order{i}) GetA() string {{\n\tif x != nil {{\n\t\treturn x.A\n\t}}\n\treturn ""\n}}') for i in range(2)]
    tiny = "export function pad(s, n) { while (s.length < n) { s = ' ' + s; } return s; }\nexport const trim = (s) => s.replace(/x/g, y);\n"
    rows += [(f"/ws/r{i}/y/tiny.js", "file", tiny) for i in range(2, 5)] + [(f"/ws/r{i}/y/alike.js", "file", tiny.replace("pad", f"pad{i}")) for i in range(2, 5)]
    rows += [("/ws/r8/types.pyi", "file", "class A:\n    def f(self, n: int = ...) -> int: ...\nclass B:\n    def f(self, n: int = ...) -> int: ...\n" * 2)]
    rows += [("/ws/r7/hand.go", "method", 'func (x *Order) GetA() string {\n\treturn x.a\n}')]
    df = spark.createDataFrame([(*r, "file", 1) for r in rows], "file_path string, chunk_type string, content string, source_kind string, kinds int")
    rel = spark.createDataFrame([(1, lib)], "release_id bigint, content string")
    got = {r["file_path"]: r for r in vendored.not_hand_written(df, rel).collect()}
    kinds = {p: [k for k in ("generated", "minified", "data", "vendored") if r[k]] for p, r in got.items()}
    assert kinds == {"/ws/r0/lib/copy.js": ["vendored"], **{f"/ws/r{i}/x/spread.js": ["vendored"] for i in range(2, 5)}, "/ws/r5/a.js": ["generated"], "/ws/r5/b.js": ["generated"], "/ws/r5/c.js": ["minified"], "/ws/r5/d.js": ["data"], "/ws/r7/order.pb.go": ["generated"], **{f"/ws/r{i}/y/tiny.js": ["vendored"] for i in range(2, 5)}}
    assert vendored.not_hand_written(df.limit(0), rel.limit(0)).count() == 0


def test_forks_are_one_family(spark):
    rng = random.Random(6)
    text = release(rng)
    forks = [(f"/ws/fork{i}/src/f{j}.js", "file", release(random.Random(100 + j)) if j else text, "file") for i in range(5) for j in range(6)]
    df = spark.createDataFrame(forks + [("/ws/other/a.js", "file", release(rng), "file")], "file_path string, chunk_type string, content string, source_kind string")
    rel = spark.createDataFrame([], "release_id bigint, content string")
    assert vendored.not_hand_written(df, rel).count() == 0
    assert vendored.not_hand_written(df.union(spark.createDataFrame([(f"/ws/far{i}/{n}.js", "file", t, "file") for i in range(2) for n, t in (("b", text), ("own", release(rng, 90)))], df.schema)), rel).count() == 7


def test_winnowing_guarantee():
    rng = random.Random(4)
    shared = " ".join(f"s{rng.randrange(10**6)}" for _ in range(vendored.GRAM + vendored.WINDOW - 1))
    a, b = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(100)) for _ in range(2))
    x, y = vendored.fingerprints(f"{a} {shared} {b}"), vendored.fingerprints(f"{b} {shared} {a}")
    assert {v for v in x.tolist() if v % 2 == 0} & set(y.tolist())
    assert [v for v in vendored.fingerprints("a  b;").tolist()] == [v for v in vendored.fingerprints("a b // c").tolist()]
    assert len(vendored.fingerprints("")) == 0 and len(vendored.fingerprints("one two")) == 1
