"""Declarations, calls and imports of a source text, by a scanner that knows strings, comments and brackets (no parser needed).

A documented approximation of a syntax tree: ids, lines, names, scopes and the whole-file fallback are exact; odd syntax may
lose or add a declaration.
"""

from __future__ import annotations

import ast
import posixpath
import re
import warnings
from dataclasses import dataclass, field

# The language of each ending.
LANGUAGE = {"ts": "ts", "tsx": "ts", "mts": "ts", "cts": "ts", "js": "ts", "jsx": "ts", "mjs": "ts", "cjs": "ts", "py": "py", "pyi": "py", "go": "go", "rs": "rs"}
_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<raw>r\#*".*?"\#*)|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<tpl>`)|(?P<life>'[A-Za-z_]\w*(?!'))
    |(?P<id>[A-Za-z_$][\w$]*)|(?P<num>\d[\w.]*)|(?P<op>=>|->|::|\?\.|&&|\|\||[=!]==?|[^\s\w])""",
    re.S | re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_NOT_CALLS = {
    "ts": set("async if for while switch catch function return typeof await new delete void in of do else case super import yield throw instanceof with constructor".split()),
    "go": set("if for switch return func go defer select range import case var const type struct interface map chan".split()),
    "rs": set("if for while match loop return fn in as let impl where pub move unsafe async await mut ref else use mod struct enum dyn".split()),
}
_MODIFIERS = set("async static get set public private protected readonly override abstract accessor declare".split())
# Words that begin another statement, so that a head has ended before them.
_STATEMENTS = set("export import const let var function class interface enum return if for while switch try throw".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass
class Scan:
    """(kind, scope, name, start, end) of declarations in order, (position, callee) of calls, and imported paths."""

    chunks: list[tuple[str, str | None, str | None, int, int]] = field(default_factory=list)
    calls: list[tuple[int, str]] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)


def _lex(text: str, lang: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, end); the text of templates is skipped, their expressions are not."""
    out, at, n, templates = [], 0, len(text), []
    while at < n:
        if lang == "ts" and text[at] == "/" and (not out or out[-1][1] in ("(", ",", "=", ":", "[", "!", "&", "|", "?", "{", ";", "=>", "&&", "||", "return")):
            m = _REGEX.match(text, at)
            if m:
                out.append(("str", m.group(), at, m.end()))
                at = m.end()
                continue
        m = _TOKEN.match(text, at)
        kind, word, end = m.lastgroup, m.group(), m.end()
        if kind == "life" and lang != "rs" or kind == "raw" and lang != "rs":
            kind, word, end = ("op", "'", at + 1) if kind == "life" else ("id", "r", at + 1)
        if kind == "str" and lang == "rs" and word[0] == "'" and len(word) > 12:
            kind, word, end = "op", "'", at + 1
        if kind == "tpl" and lang == "go":
            close = text.find("`", at + 1)
            end = n if close < 0 else close + 1
            out.append(("str", text[at:end], at, end))
        elif kind == "tpl" and lang == "ts" or word == "}" and templates and templates[-1] == 0:
            if word == "}":
                templates.pop()
                out.append(("op", "}", at, end))
            stop = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S).match(text, end).end()
            if text[stop : stop + 2] == "${":
                templates.append(0)
                out.append(("op", "{", stop, stop + 2))
                end = stop + 2
            else:
                out.append(("str", "`", at, min(stop + 1, n)))
                end = stop + 1
        elif kind != "skip":
            if templates and word in "{}":
                templates[-1] += 1 if word == "{" else -1
            out.append((kind, word, at, end))
        at = end
    return out


def _pairs(toks: list) -> dict[int, int]:
    """Index of the closing bracket of each opening one, as far as they match."""
    stack, out = [], {}
    for i, (kind, word, _, _) in enumerate(toks):
        if kind != "op":
            continue
        if word in _OPEN:
            stack.append(i)
        elif word in _CLOSE:
            while stack:
                j = stack.pop()
                if _OPEN[toks[j][1]] == word:
                    out[j] = i
                    break
    return out


def _body(toks, pairs, i):
    """Index of the brace that opens a body after a closing parenthesis at i, past a return type of any length; else None."""
    j = i + 1
    if j < len(toks) and toks[j][1] not in ("{", ":"):
        return None
    while j < len(toks):
        word = toks[j][1]
        if word in _STATEMENTS and word != "import":  # import('x').T is a type
            return None
        if word == "{" and not (toks[j - 1][1] in (":", "|", "&", "<", ",") and pairs.get(j) is not None):
            return j if j in pairs else None
        if word in (";", "}", ")", "=>") or toks[j][0] == "op" and word in ("=", ",") and toks[j - 1][1] != "<":
            return None
        j = pairs.get(j, j) + 1 if word in _OPEN else j + 1
    return None


def _expression_end(toks, pairs, i):
    """Index of the last token of an expression that starts at i."""
    j = i
    while j < len(toks):
        word = toks[j][1]
        if word in (";", ",") or word in _CLOSE:
            return max(i, j - 1)
        j = pairs.get(j, j) + 1 if word in _OPEN else j + 1
    return len(toks) - 1


def _braces(text: str, lang: str) -> Scan:
    toks = _lex(text, lang)
    pairs = _pairs(toks)
    scan, classes, defined = Scan(), [], set()
    word = lambda i: toks[i][1] if 0 <= i < len(toks) else ""
    depth = 0

    def scope(pos):
        inner = [c for c in classes if c[0] <= pos < c[1]]
        return inner[-1][2] if inner else None

    def add(kind, name, first, last):
        scan.chunks.append((kind, scope(toks[first][2]), name, toks[first][2], toks[last][3]))

    for i, (kind, w, a, _) in enumerate(toks):
        if kind == "op":
            depth += (w in _OPEN) - (w in _CLOSE)
        if lang == "ts" and kind == "id":
            if w == "import" and word(i + 1) != "(" and word(i - 1) != ".":
                j = i + 1
                while j < len(toks) and word(j) not in (";", "=", "(", "import"):
                    if toks[j][0] == "str":
                        scan.imports.append(toks[j][1][1:-1])
                        break
                    j = pairs.get(j, j) + 1 if word(j) == "{" else j + 1
            elif w == "class" and word(i - 1) not in (".", "=", "(", ",", "return", ":", "=>", "?"):
                j = i + 1
                while j < len(toks) and word(j) != "{" and word(j) != ";":
                    j += 1
                if word(j) == "{" and j in pairs:
                    first = i - 1 if word(i - 1) == "abstract" else i
                    name = word(i + 1) if toks[i + 1][0] == "id" and word(i + 1) not in ("extends", "implements") else None
                    add("class", name, first, pairs[j])
                    classes.append((toks[j][2], toks[pairs[j]][2], name))
            elif w == "function" and word(i - 1) != ".":
                j = i + 2 if word(i + 1) == "*" else i + 1
                name = word(j) if j < len(toks) and toks[j][0] == "id" else None
                p = j + 1 if name else j
                while p < len(toks) and word(p) != "(" and word(p) not in ("{", ";"):
                    p += 1
                b = _body(toks, pairs, pairs[p]) if word(p) == "(" and p in pairs else None
                if b is not None:
                    defined.add(j)
                    if name or word(i + 1) != "*":
                        add("function", name, i - 1 if word(i - 1) == "async" else i, pairs[b])
            elif w in ("const", "let") and depth == 0 and toks[min(i + 1, len(toks) - 1)][0] == "id":
                j = i + 2
                while j < len(toks) and word(j) not in ("=", ";"):
                    j = pairs.get(j, j) + 1 if word(j) in _OPEN else j + 1
                s = j + 1
                p = s + 1 if word(s) == "async" else s
                q = p
                if word(p) == "<":
                    while q < len(toks) and word(q) != "(":
                        q += 1
                q = pairs.get(q, q) + 1 if word(q) in _OPEN else q
                while q < len(toks) and word(q) not in ("=>", ";", "=") and word(q) not in _STATEMENTS - {"import"} and word(j) == "=":
                    q = pairs.get(q, q) + 1 if word(q) in _OPEN else q + 1
                if word(j) == "=" and word(q) == "=>" and (word(p) in ("(", "<") or toks[p][0] == "id") and word(s - 1) == "=":
                    last = pairs.get(q + 1) if word(q + 1) == "{" else _expression_end(toks, pairs, q + 1)
                    if last is not None:
                        add("function", None, s, min(last, len(toks) - 1))
            if word(i + 1) == "(" and i + 1 in pairs and lang == "ts" and (w not in _NOT_CALLS["ts"] or w in ("catch", "delete")) and word(i - 1) not in ("function", "new", ".", "?.", "*") or w == "constructor" and word(i + 1) == "(" and i + 1 in pairs:
                b = _body(toks, pairs, pairs[i + 1]) if word(i - 1) in ("{", "}", ";", ",", "*", "") or word(i - 1) in _MODIFIERS else None
                if b is not None:
                    if i not in defined and w not in ("if", "for", "while", "switch", "catch", "with"):
                        first = i
                        while word(first - 1) in _MODIFIERS or word(first - 1) == "*":
                            first -= 1
                        add("method", w, first, pairs[b])
                        defined.add(i)
        elif lang == "go" and w == "func" and kind == "id":
            p = i + 1
            if word(p) == "(" and depth == 0 and p in pairs and word(pairs[p] + 2) in ("(", "[") and toks[pairs[p] + 1][0] == "id":
                n = pairs[p] + 1
                kind2, name = "method", word(n)
            elif p < len(toks) and toks[p][0] == "id":
                n, kind2, name = p, "function", word(p)
            else:
                n, kind2, name = i, "function", None
            q = n + 1
            if word(q) == "[" and q in pairs:
                q = pairs[q] + 1
            if word(q) == "(" and q in pairs:
                j = pairs[q] + 1
                while j < len(toks) and word(j) not in ("{", ";") and "\n" not in text[toks[j - 1][3] : toks[j][2]]:
                    j = pairs.get(j, j) + 1 if word(j) in ("(", "[") else j + (2 if word(j) == "interface" and word(j + 1) == "{" else 1)
                if word(j) == "{" and j in pairs:
                    add(kind2, name, i, pairs[j])
                    defined.add(n)
        elif lang == "rs":
            if w == "fn" and kind == "id" and i + 1 < len(toks) and toks[i + 1][0] == "id":
                j = i + 2
                while j < len(toks) and word(j) not in ("{", ";"):
                    j = pairs.get(j, j) + 1 if word(j) in ("(", "[") else j + 1
                if word(j) == "{" and j in pairs:
                    first = i
                    while word(first - 1) in ("pub", "async", "unsafe", "const", "extern") or word(first - 1) == ")" and word(first - 4) == "pub":
                        first -= 4 if word(first - 1) == ")" else 1
                    add("function", word(i + 1), first, pairs[j])
                    defined.add(i + 1)
            elif w == "impl" and kind == "id" and word(i - 1) in ("", "}", ";", "]", "unsafe"):
                j = i + 1
                while j < len(toks) and word(j) not in ("{", ";"):
                    j += 1
                if word(j) == "{" and j in pairs:
                    add("class", None, i, pairs[j])
                    classes.append((toks[j][2], toks[pairs[j]][2], None))
            elif w in ("|", "||") and kind == "op" and word(i - 1) in ("(", ",", "=", "{", ";", "move", "=>", "return"):
                q = i
                if w == "|":
                    q = i + 1
                    while q < len(toks) and word(q) != "|":
                        q += 1
                if q + 1 < len(toks):
                    last = pairs.get(q + 1) if word(q + 1) == "{" else _expression_end(toks, pairs, q + 1)
                    if last is not None:
                        add("function", None, i - 1 if word(i - 1) == "move" else i, last)
        if kind == "id" and word(i + 1) == "(" and i not in defined and w not in _NOT_CALLS[lang] and word(i - 1) not in ("new", "function", "func", "fn"):
            if lang == "ts" or word(i - 1) not in (".", "::", "?."):
                scan.calls.append((a, w))
    scan.chunks.sort(key=lambda c: (c[3], -c[4]))
    return scan


def _python(text: str) -> Scan:
    scan = Scan()
    offsets = [0]
    for line in text.split("\n"):
        offsets.append(offsets[-1] + len(line) + 1)
    lines = text.split("\n")
    place = lambda row, col: offsets[row - 1] + len(lines[row - 1].encode()[:col].decode(errors="ignore"))
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _indented(text, lines, offsets)

    def walk(node, scope):
        for child in ast.iter_child_nodes(node):
            inner = scope
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "function"
                scan.chunks.append((kind, scope, child.name, place(child.lineno, child.col_offset), place(child.end_lineno, child.end_col_offset)))
                inner = child.name if kind == "class" else scope
            walk(child, inner)

    walk(tree, None)
    return scan


def _indented(text: str, lines: list[str], offsets: list[int]) -> Scan:
    """Declarations by indentation, for Python that doesn't parse."""
    scan, stack = Scan(), []
    for i, line in enumerate(lines):
        m = re.match(r"(\s*)(async\s+def|def|class)\s+(\w+)", line)
        if not m:
            continue
        indent, end = len(m[1]), i
        for j in range(i + 1, len(lines)):
            if lines[j].strip():
                if len(lines[j]) - len(lines[j].lstrip()) <= indent:
                    break
                end = j
        while stack and stack[-1][0] >= indent:
            stack.pop()
        kind = "class" if m[2] == "class" else "function"
        scan.chunks.append((kind, next((s[1] for s in reversed(stack) if s[2] == "class"), None), m[3], offsets[i] + indent, offsets[end] + len(lines[end])))
        stack.append((indent, m[3], kind))
    return scan


def chunk_code(path: str, text: str) -> tuple[list[dict], list[dict]]:
    """Chunk and edge rows of a source file; both empty for an unknown ending.

    A file without a declaration gives one ``file`` chunk. Calls belong to the declaration begun last before them; calls
    before the first one, and imports, come from ``path:0``. Only TypeScript and its kin have member calls and imports.
    """
    lang = LANGUAGE.get(path.rsplit(".", 1)[-1] if "." in path else "")
    if lang is None:
        return [], []
    scan = _python(text) if lang == "py" else _braces(text, lang)
    row = lambda pos: text.count("\n", 0, pos)
    chunks, starts = [], []
    for kind, scope, name, a, b in scan.chunks:
        first = row(a)
        chunks.append({"id": f"{path}:{first}", "file_path": path, "chunk_type": kind, "scope": scope, "name": name, "content": text[a:b], "start_line": first + 1, "end_line": row(b) + 1})
        starts.append((a, f"{path}:{first}", name))
    if not chunks:
        chunks.append({"id": f"{path}:0", "file_path": path, "chunk_type": "file", "scope": None, "name": None, "content": text, "start_line": 1, "end_line": text.count("\n") + 1})
    edges, k = [], -1
    for raw in scan.imports:
        near = raw.startswith(("./", "../"))
        edges.append({"from_chunk_id": f"{path}:0", "from_file": path, "from_symbol": None, "to_symbol": raw, "to_file": posixpath.normpath(posixpath.join(posixpath.dirname(path), raw)) if near else None, "edge_type": "import"})
    for pos, callee in scan.calls:
        while k + 1 < len(starts) and starts[k + 1][0] <= pos:
            k += 1
        here = starts[k] if k >= 0 else (0, f"{path}:0", None)
        edges.append({"from_chunk_id": here[1], "from_file": path, "from_symbol": here[2], "to_symbol": callee, "to_file": None, "edge_type": "call"})
    return chunks, edges
