"""Markdown and text documents into sections within a token limit."""

from __future__ import annotations

import re
from collections.abc import Callable

# Fixed value: tokens above which a section is packed by paragraphs.
SECTION_TOKENS = 1500
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")


def words(text: str) -> int:
    return len(text.split())


def strip_front_matter(text: str) -> tuple[str, int]:
    """The text after a leading YAML block, and how many lines that took."""
    m = re.match(r"---\r?\n.*?\n---[ \t]*(?:\r?\n|\Z)", text, re.S)
    return (text[m.end() :], m.group().count("\n")) if m else (text, 0)


def pack(body: str, line: int, count: Callable[[str], int]) -> list[tuple[str, int]]:
    """(text, start line) of a section: whole if within the limit, else paragraphs packed in order, an oversized one alone."""
    text = body.strip()
    if not text:
        return []
    if count(text) <= SECTION_TOKENS:
        return [(text, line)]
    out: list[tuple[str, int]] = []
    held: list[str] = []
    held_at = at = line
    for para in (p for p in re.split(r"\n\n+", text) if p.strip()):
        if held and count("\n\n".join([*held, para])) > SECTION_TOKENS:
            # The paragraph that didn't fit begins the next piece, whatever its size.
            out.append(("\n\n".join(held), held_at))
            held, held_at = [para], at
        elif not held and count(para) > SECTION_TOKENS:
            out.append((para, at))
        else:
            if not held:
                held_at = at
            held.append(para)
        at += para.count("\n") + 3
    if held:
        out.append(("\n\n".join(held), held_at))
    return out


def chunk_markdown(text: str, count: Callable[[str], int] = words) -> list[tuple[str | None, str | None, str, int]]:
    """(name, scope, content, start line): sections begin at second-level headings only; the scope is the trail of headings
    in force where a section ends; other headings stay in the body. Lines are true lines."""
    text, skipped = strip_front_matter(text)
    out, trail, name = [], [], None
    held: list[str] = []
    first, fence = None, None

    def flush():
        nonlocal held, first
        body = "\n".join(held)
        lead = len(body) - len(body.lstrip("\n"))
        scope = " > ".join(f"{'#' * d} {t}" for d, t in trail) or None
        out.extend((name, scope, c, a) for c, a in pack(body, (first or 1) + lead, count))
        held, first = [], None

    for i, line in enumerate(text.replace("\r\n", "\n").split("\n"), 1 + skipped):
        mark = _FENCE.match(line)
        if mark:
            fence = None if fence and line.strip().startswith(fence) else fence or mark[1]
        head = None if fence or mark else _HEADING.match(line)
        depth = len(head[1]) if head else 0
        if depth == 2:
            flush()
        if depth:
            title = (head[2] or "").strip()
            while trail and trail[-1][0] >= depth:
                trail.pop()
            trail.append((depth, title))
            if depth == 2:
                name = title
                continue
        if first is None:
            first = i
        held.append(line)
    flush()
    return out


def chunk_text(text: str, count: Callable[[str], int] = words) -> list[tuple[str | None, str | None, str, int]]:
    """Paragraphs of plain text, each at least one chunk; a gap counts as two lines."""
    out, at = [], 1
    for para in (p for p in re.split(r"\n\n+", text) if p.strip()):
        out.extend((None, None, c, a) for c, a in pack(para, at, count))
        at += para.count("\n") + 3
    return out


def chunk_document(path: str, text: str, count: Callable[[str], int] = words) -> list[dict]:
    """Rows of the chunk table of a document."""
    parts = chunk_markdown(text, count) if path.endswith(".md") else chunk_text(text, count) if path.endswith((".txt", ".rst")) else []
    return [{"id": f"{path}:{a - 1}", "file_path": path, "chunk_type": "file", "scope": s, "name": n, "content": c, "start_line": a, "end_line": a + c.count("\n")} for n, s, c, a in parts]
