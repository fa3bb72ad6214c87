"""Splitting, encoding and packing: exact properties, round trips, and the library's own encoding."""

import os
import random

import numpy as np
import pytest

from strataloom.llm import bpe, pack, split

VOCAB = bpe.vocabulary_path()
needs_vocab = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary file")


def check_pieces(text, limit, least, overlap):
    spans = split.cut(text, limit, least, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert least <= b - a <= limit and c == b - overlap
    assert all(b - a <= limit for a, b in spans)
    return spans


def test_cuts_cover_the_text_within_limits():
    rng = random.Random(3)
    for n in (0, 1, 39, 40, 41, 500, 70_000):
        text = "".join(rng.choice("ab .\n") for _ in range(n))
        check_pieces(text, 40, 20, 5)


def test_strongest_boundary_of_the_window_and_rightmost_of_equals():
    rng = random.Random(4)
    for _ in range(50):
        text = "".join(rng.choice("abc  .\n") for _ in range(300))
        s = split.strengths(text)
        for a, b in split.cut(text, 50, 25, 4)[:-1]:
            window = s[a + 25 : a + 51]
            assert b == a + 25 + int(np.flatnonzero(window == window.max())[-1])


def test_long_text_spans_several_stretches():
    text = ("word " * 9 + "\n") * 20_000
    spans = check_pieces(text, 4000, 2000, 200)
    assert all(text[b - 1] == "\n" for _, b in spans[:-1])


def test_line_ends_and_marks_stay_together():
    text = "x\r\n" * 30 + "e\u0301" * 100
    for a, b in split.cut(text, 20, 10, 2)[:-1]:
        assert text[b - 1 : b + 1] != "\r\n" and text[b] != "\u0301"


def test_sparse_table_against_brute_force():
    v = np.array([random.Random(1).randrange(5) for _ in range(300)])
    t = split.SparseTable(v, 64)
    for lo in range(0, 230, 7):
        for width in (1, 2, 3, 17, 64):
            part = v[lo : lo + width]
            assert t.argmax(lo, lo + width - 1) == lo + int(np.flatnonzero(part == part.max())[-1])


def test_split_rows(spark):
    text = "line\n" * 1000
    rows = [("a", text, 10, "clash"), ("a", text, 10, "clash"), ("h", "x" * 4001, 0, ""), ("s", "x" * 4000, 1, ""), ("e", "", 1, ""), ("n", None, None, "")]
    out = split.split_oversized(spark.createDataFrame(rows, "id string, content string, start_line int, piece string")).orderBy("id", "piece").collect()
    assert {r["id"] for r in out} == {"a", "h"}
    a = [r for r in out if r["id"] == "a"]
    assert len(a) == 4 and a[0]["start_line"] == 10 and a[0]["end_line"] == 809 and a[-1]["end_line"] == 1009
    assert all((r["start_line"], r["end_line"]) == (0, 0) for r in out if r["id"] == "h")
    assert split.split_oversized(spark.createDataFrame([], "id string, content string, start_line int")).count() == 0


@needs_vocab
def test_encoding_equals_the_library_and_round_trips():
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(VOCAB)
    lib.encode_special_tokens = True
    a = bpe.Automaton(VOCAB)
    rng = random.Random(5)
    texts = ["", "Hello world", "<|endoftext|> x", "a" * 3000, "漢字" * 500, "=-" * 900, " \n\t  x", "don't I'll", "naïve café 🧭🧭", "\u200d\ufeff"]
    texts += ["".join(rng.choice("abcdeinorst  ABé漢\n\t01'aaa🧭") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for t in texts:
        ids = a.encode(t)
        assert ids == lib.encode(t, add_special_tokens=False).ids, repr(t)
        assert a.decode(ids) == t and a.count(t) == len(ids)
    assert a.encode(None) == []


@needs_vocab
def test_tables_may_start_anew(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 5)
    monkeypatch.setattr(bpe, "MAX_WORDS", 3)
    small, big = bpe.Automaton(VOCAB), bpe.Automaton(VOCAB)
    for t in ("the quick brown fox", "jumps over the lazy dog", "z" * 70_000):
        ids = small.encode(t)
        assert small.decode(ids) == t and ids == big.encode(t)


@needs_vocab
def test_every_document_has_a_row(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "", "x"), (3, None, "x"), (4, "a b", "x")], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_documents(df).collect()}
    assert set(got) == {1, 2, 3, 4} and got[2] == got[3] == [] and got[1] == got[4] != []


def test_patterns_and_plan():
    p = pack.patterns(12)
    assert (p.sum(axis=1) == 12).all() and len({tuple(x) for x in p}) == len(p) == 19
    rng = np.random.default_rng(0)
    for n in (0, 1, 50, 20_000):
        hist = np.bincount(np.clip(rng.lognormal(3.5, 1.0, n).astype(int), 1, 256), minlength=257)
        plan = pack.plan(hist)
        used = np.zeros(257, dtype=int)
        for lengths, times in plan:
            assert times > 0 and sum(lengths) <= 256
            for x in lengths:
                used[x] += times
        assert (used == hist).all()
        if n == 20_000:
            assert (hist * np.arange(257)).sum() / (256 * sum(t for _, t in plan)) > 0.99


def test_fit_is_non_negative_and_close():
    pats = pack.patterns(16)
    hist = np.bincount(np.repeat(pats[[3, 9, 14]], [40, 20, 10], axis=0).ravel(), minlength=17).astype(float)
    x = pack.fit_counts(hist, pats, 2000)
    used = np.bincount(pats.ravel(), weights=np.repeat(x, 3), minlength=17)
    assert (x >= 0).all() and np.abs(used - hist)[1:].max() < 2


@needs_vocab
def test_packed_documents(spark):
    word = " the"
    rows = [(i, word * n, "clash") for i, n in enumerate([0, 1, 5, 31, 32, 33, 64, 100, *[7] * 40, *[20] * 40])] + [(900, None, "")]
    out = pack.pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string, salt string"), capacity=32).toPandas()
    assert set(out.doc_id) == {r[0] for r in rows}
    placed = out.dropna()
    room = placed.groupby("container_id").n_tokens.sum()
    assert room.max() <= 32 and sorted(room.index) == list(range(len(room)))
    sizes = placed.groupby("doc_id").n_tokens.sum()
    assert all(sizes.get(i, 0) == (len(t) // 4 if t else 0) for i, t, _ in rows)
    assert all(len(g) == 1 for i, g in placed.groupby("doc_id") if len(rows[int(i)][1]) // 4 <= 32)
    assert set(out[out.container_id.isna()].doc_id) == {0, 900}
    assert room.sum() / (32 * len(room)) > 0.85  # a 20 leaves room for one 7 only
    assert pack.pack_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
