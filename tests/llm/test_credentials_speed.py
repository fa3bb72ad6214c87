"""Candidates are looked for at likely places only and scored many at a time, with the results of a plain search and of one at a time."""

import random
import time

import numpy as np
import pytest
from test_credentials_residue import HARMLESS, SECRETS
from test_credentials_whole import RANDOM, model  # noqa: F401

from strataloom.llm import credentials as C

CODE = "\n".join(SECRETS + HARMLESS) + "\nexport function loadRows(reader: Reader, limit = 10): Row[] {\n  // reads every row in order, the last one first\n  return reader.rows(limit).filter((row) => row.open);\n}\n" * 40
ODD = ["ſecret is abcdef12", "to\u212aen abcdefgh1234", "passſcode = Zx9kQ2vL", "pın is 12345678", "PİN 12345678", "basıc dXNlcjpwYXNz", "contraseña Zx9kQ2vL", "mot de passe: Zx9kQ2vL", "a+b+c://u:pw@h", "ключ=abcdefg7", "a:==bcdefg", "a=  bcdefg", "+a=bcdefg", ".a=bcdefg", "-a=bcdefg", "/usr1bin2abcdefghijkl", "=a1b2c3d4e5f6g7h8i9", "?t=abcdef&u=ghijkl", "--user=me:Zx9kQ2", "-u me:Zx9kQ2", "x://:pass@h", "9a=bcdefg", "_=bcdefg"]


def _spent(f) -> float:
    best = 1e9
    for _ in range(3):
        began = time.process_time()
        f()
        best = min(best, time.process_time() - began)
    return best


def _all(search, text):
    at, out = 0, []
    while m := search(text, at):
        out.append((m.span(), m.lastgroup))
        at = m.start() + 1
    return out


def test_likely_places_are_all_places_of_a_plain_search():
    r = random.Random(7)
    texts = [CODE[:9000], *ODD, *(r.choice([" ", "", ".", "+", "\n"]).join(r.sample(ODD, 4)) for _ in range(400))]
    for text in texts:
        assert _all(C._next, text) == _all(C._FIND.search, text), text


def test_candidates_cost_less_than_a_plain_search():
    text = CODE * 5
    assert _spent(lambda: C.candidates(text)) < 0.8 * _spent(lambda: _all(lambda t, at: C._FIND.search(t, at), text))


@pytest.mark.parametrize("text", ["a+" * 50_000, "a/" * 50_000, "a." * 50_000 + "=", "+/" * 50_000, "a-" * 50_000 + "=x", "a =" * 50_000])
def test_runs_of_signs_take_linear_time(text):
    assert _spent(lambda: C.candidates(text)) < 3


def test_scores_of_many_are_those_of_each_and_cost_less(model):  # noqa: F811
    rows = [(k, v, w, p) for p in ("a.ts", "", "tests/B.MD") for _, _, k, v, w in C.candidates(CODE[:4000])]
    rows += [("said", v, "", "") for v in ("", "a", "é", "\x00\x1f", "\ud800x", "------", "....", "1234", "ABCdef", RANDOM * 3)]
    rows = (rows * 40)[:4500]  # more than are worked on at once
    one = np.concatenate([model.score([r]) for r in rows])
    assert np.abs(model.score(rows) - one).max() < 1e-9
    assert _spent(lambda: model.score(rows)) < 0.3 * _spent(lambda: [model.score([r]) for r in rows])


def test_pairs_of_joined_texts_are_the_sum_of_each():
    each, joined = np.zeros(97 * 97, dtype=np.int64), np.zeros(97 * 97, dtype=np.int64)
    texts = [CODE[:500], "", "é", "a", " b", "c\x7f", *ODD]
    for t in texts:
        C.count_pairs(t, each)
    C.count_pairs(" ".join(texts), joined)
    assert (each == joined).all() and each[: 2 * 97].sum() == 0 and each.sum() > 500
