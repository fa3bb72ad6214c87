"""Long parameter lists, imports and return types are read to their end; unended statements don't run into others."""

import time

import pytest

from strataloom.sources.code_scan import chunk_code

PROPS = "{ " + ", ".join(f"p{i}" for i in range(150)) + " }: { " + "; ".join(f"p{i}: string" for i in range(150)) + " }"
NAMES = ", ".join(f"name{i}" for i in range(300))
RETURNS = " | ".join(f"Kind{i}" for i in range(300))


@pytest.mark.parametrize(
    "text,kind",
    [(f"const Card = ({PROPS}) => {{ return load(p1); }};\n", "function"), (f"const Card = ({PROPS}): {RETURNS} => load(p1);\n", "function"), (f"function pick({PROPS}): {RETURNS} {{ return load(p1); }}\n", "function"), (f"class A {{ pick(): {RETURNS} {{ return load(p1); }} }}\n", "method")],
)
def test_long_heads(text, kind):
    chunks, edges = chunk_code("/a/b.tsx", text)
    assert kind in [c["chunk_type"] for c in chunks]
    assert ("load", "/a/b.tsx:0") in [(e["to_symbol"], e["from_chunk_id"]) for e in edges]
    assert "file" not in [c["chunk_type"] for c in chunks]


def test_long_import():
    _, edges = chunk_code("/a/b.ts", f"import {{ {NAMES} }} from './names';\n")
    assert [(e["to_symbol"], e["to_file"]) for e in edges if e["edge_type"] == "import"] == [("./names", "/a/names")]


def test_statement_without_semicolon_is_no_head():
    text = "const size = (4)\n" + "use(size)\n" * 150 + "export default (x) => { use(x) }\n"
    assert [c["chunk_type"] for c in chunk_code("/a/b.ts", text)[0]] == ["file"]


def test_linear_time():
    began = time.process_time()
    chunk_code("/a/b.ts", "foo(1)\nconst x = (2)\n" * 10_000)
    assert time.process_time() - began < 10
