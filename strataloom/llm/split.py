"""Splitting oversized items at natural boundaries.

Every position of a text has a boundary strength; a sparse table over the strengths answers range-maximum queries, so
each piece ends at the strongest cut in its window of permissible lengths, ties to the right; the next piece starts
``overlap`` characters before that cut. Only rows over the limit reach Python. Tables cover a stretch of the text at a
time and reach up to the window's length, so memory is bounded for texts of any length.

Defined results: null, empty and short contents give no pieces; repeated rows give their pieces each; the pieces of a
row cover its whole content in order; rows with start_line 0 (not from a file) keep 0/0.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Boundary strengths, strongest last: within a word, at a space, after a sentence, at a line end, before a declaration, at a blank line.
WORD, SPACE, SENTENCE, LINE, DECLARATION, BLANK = 1, 2, 3, 4, 5, 6
_RULES = (
    (SPACE, re.compile(r"[^\S\r\n]+")),
    (SENTENCE, re.compile(r"[.!?;]\s+|[。！？；]")),
    (LINE, re.compile(r"\r\n|\n|\r")),
    (DECLARATION, re.compile(r"(?:\r\n|\n|\r)(?=(?:export |async |pub |public |private |static )*(?:function|class|def|func|fn|impl|struct|interface|#{1,6} )\b)")),
    (BLANK, re.compile(r"(?:\r\n|\n)[^\S\r\n]*(?:\r\n|\n)")),
)
_INSIDE = re.compile("\r(?=\n)|.(?=[\u0300-\u036f\u200d\ufe0e\ufe0f\U0001f3fb-\U0001f3ff])|\u200d", re.S)
_STRETCH = 1 << 16


def strengths(text: str) -> np.ndarray:
    """Strength of a cut before each position 0..len(text)."""
    s = np.full(len(text) + 1, WORD, dtype=np.int64)
    for value, rule in _RULES:
        at = [m.end() for m in rule.finditer(text)]
        s[at] = np.maximum(s[at], value)
    s[[m.end() for m in _INSIDE.finditer(text)]] = 0
    return s


class SparseTable:
    """Position of the maximum in any range of up to ``reach`` values, the rightmost of equals."""

    def __init__(self, values: np.ndarray, reach: int):
        key = values.astype(np.int64) << 40 | np.arange(len(values))
        self.rows, width = [key], 1
        while 2 * width <= min(reach, len(key)):
            last = self.rows[-1]
            self.rows.append(np.maximum(last[:-width], last[width:]))
            width *= 2

    def argmax(self, lo: int, hi: int) -> int:
        """Of the values lo..hi, both included."""
        k = (hi - lo + 1).bit_length() - 1
        row = self.rows[k]
        return int(max(row[lo], row[hi - (1 << k) + 1]) & ((1 << 40) - 1))


def cut(text: str, limit: int, least: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of the pieces of ``text``; one span if it is within the limit."""
    if not 0 <= overlap < least <= limit:
        raise ValueError("0 <= overlap < least <= limit doesn't hold")
    n, start, spans = len(text), 0, []
    base, table = 0, None
    stretch = max(_STRETCH, 4 * limit)
    while n - start > limit:
        if table is None or start + limit > base + stretch:
            base = start
            part = text[base : base + stretch + 1]
            table = SparseTable(strengths(part)[: len(part)], limit - least + 1)
        end = base + table.argmax(start + least - base, start + limit - base)
        spans.append((start, end))
        start = end - overlap
    return [*spans, (start, n)]


def split_oversized(chunks: DataFrame, limit: int = 4000, least: int = 2000, overlap: int = 200) -> DataFrame:
    """Pieces of every row over ``limit`` characters, with their place in characters and lines."""
    big = chunks.where(F.length("content") > limit).select("id", "content", "start_line")

    def pieces(batches):
        for pdf in batches:
            out = []
            for i, text, first in zip(pdf["id"], pdf["content"], pdf["start_line"]):
                known = first is not None and first == first and first > 0
                line, seen = int(first) if known else 0, 0
                for k, (a, b) in enumerate(cut(text, limit, least, overlap)):
                    line += text.count("\n", seen, a) if known else 0
                    seen = a
                    out.append((i, int(first) if first is not None and first == first else 0, k, a, b, line, line + text.count("\n", a, b - 1) if known else 0, text[a:b]))
            yield pd.DataFrame(out, columns=["id", "item_line", "piece", "from_char", "to_char", "start_line", "end_line", "content"])

    return big.mapInPandas(pieces, "id string, item_line int, piece int, from_char int, to_char int, start_line int, end_line int, content string")
