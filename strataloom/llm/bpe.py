"""Byte-level BPE by a tokenization automaton.

Each merge (a, b) -> c adds a gadget to the automaton of correct token sequences: every state with an arc a gets an
arc c to where the path a b led, and the path a b is cut. The state after a token depends on that token alone, so the
arcs are kept as a rule over (last token, next token) that the gadgets decide, one after the other. Reading bytes, the
deterministic automaton's state is the set of vocabulary paths still open, each with the token before it; exactly one of
the paths that end at a byte is a correct arc, and its label is the last token of the text so far. States and transitions
are tabled when first reached; the arcs walked backwards give the token ids, their labels forwards give the text.

Null and empty texts have no ids.
"""

from __future__ import annotations

import importlib
import json
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

MAX_WORDS, MAX_STATES = 400_000, 200_000


def vocabulary_path(name: str = "byte_bpe_50k.json", path: str | None = None) -> str:
    """Place of a public vocabulary: ``path`` if given, else of the installed files."""
    return path or os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), name)


def shipped(spark: SparkSession, path: str) -> Callable[[], str]:
    """Sends the vocabulary along with the job, unless the master is local; the returned function gives its place on a worker."""
    if spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local["):
        return lambda: path
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)

    def place() -> str:
        near = SparkFiles.get(name)
        return near if os.path.exists(near) else path

    return place


def _pattern() -> str:
    try:
        return importlib.import_module("public_tokenizers").PATTERN
    except ImportError:
        return r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The automaton of one vocabulary; built once a worker, its tables grow as texts are read and start anew when full."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letter = _byte_letters()
        vocab = {k: v for k, v in model["vocab"].items() if all(c in letter for c in k)}
        self.bytes_of = {v: bytes(letter[c] for c in k) for k, v in vocab.items()}
        self.length = {v: len(b) for v, b in self.bytes_of.items()}
        self.born: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for time, pair in enumerate(model["merges"], 1):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if a + b in vocab:
                x, y, c = vocab[a], vocab[b], vocab[a + b]
                self.merged.setdefault((x, y), time)
                if c not in self.parts:
                    self.parts[c], self.born[c] = (x, y), time
        reachable = {v for v, b in self.bytes_of.items() if len(b) == 1} | set(self.parts)
        self.root: dict = {}
        for v in reachable:
            node = self.root
            for byte in self.bytes_of[v]:
                node = node.setdefault(byte, {})
            node[-1] = v
        self.arc_memo: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(_pattern()).findall
        self.words = _Words(self)
        self._restart()

    def _restart(self) -> None:
        self.states: dict[tuple, dict] = {}
        self.start = self._state(((self.root, -1),))

    def arc(self, x: int, y: int) -> bool:
        """Whether token y may follow token x."""
        if x < 0:
            return True
        hit = self.arc_memo.get((x, y))
        if hit is None:
            if len(self.arc_memo) > 4_000_000:
                self.arc_memo.clear()
            hit = self.arc_memo[x, y] = self._gadgets(x, y, 1 << 60)
        return hit

    def _gadgets(self, x: int, y: int, time: int) -> bool:
        """Whether the state after x has an arc y once the gadgets up to ``time`` are in."""
        while True:
            cut = self.merged.get((x, y))
            if cut is not None and cut <= time:
                return False
            bx, by = self.born.get(x, 0), self.born.get(y, 0)
            if by > bx:  # the arc came with the arc of y's first part
                y, time = self.parts[y][0], by
            elif bx > by:  # the state is a copy of the one after x's second part
                x, time = self.parts[x][1], bx - 1
            elif bx:  # x is y
                (first, second), time = self.parts[x], bx - 1
                x, y = second, first
            else:
                return True

    def _state(self, paths: tuple) -> dict:
        key = tuple((id(n), t) for n, t in paths)
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = {-1: paths}
        return state

    def _step(self, state: dict, byte: int) -> tuple[dict, int]:
        """Builds the transition of ``state`` on ``byte``: the next state, and the arc's label."""
        label, paths = -1, []
        for node, before in state[-1]:
            nxt = node.get(byte)
            if nxt is not None:
                token = nxt.get(-1)
                if label < 0 and token is not None and self.arc(before, token):
                    label = token
                if len(nxt) > (token is not None):
                    paths.append((nxt, before))
        if label < 0:
            raise ValueError("the vocabulary lacks a byte")
        paths.append((self.root, label))
        out = state[byte] = (self._state(tuple(paths)), label)
        return out

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        if len(self.states) > MAX_STATES:
            self._restart()
        state, labels = self.start, []
        for n, byte in enumerate(word):
            if n & 0xFFFF == 0xFFFF and len(self.states) > 4 * MAX_STATES:
                keep = state[-1]
                self._restart()
                state = self._state(keep)
            to = state.get(byte)
            state, label = to if to is not None else self._step(state, byte)
            labels.append(label)
        ids, at = [], len(word)
        while at:
            token = labels[at - 1]
            ids.append(token)
            at -= self.length[token]
        ids.reverse()
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        words = self.words
        if len(words) > MAX_WORDS:
            words.clear()
        return [i for w in self.split(text) for i in words[w]]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        words = self.words
        if len(words) > MAX_WORDS:
            words.clear()
        return sum([len(words[w]) for w in self.split(text)])

    def decode(self, ids) -> str:
        """The labels of the arcs, put together."""
        return b"".join([self.bytes_of[int(i)] for i in ids]).decode("utf-8", errors="replace")


class _Words(dict):
    """Ids of words met before."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.automaton.encode_word(word.encode("utf-8", errors="surrogatepass"))
        if len(word) <= 64:
            self[word] = ids
        return ids


_LOADED: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    if path not in _LOADED:
        _LOADED[path] = Automaton(path)
    return _LOADED[path]


def encode_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row; no shuffle, one pass."""
    place = shipped(documents.sparkSession, vocabulary_path(path=path))

    def run(batches):
        a = automaton(place())
        for batch in batches:
            lists = [a.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(ends[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def count_tokens(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every row; no shuffle, one pass."""
    place = shipped(documents.sparkSession, vocabulary_path(path=path))

    def run(batches):
        a = automaton(place())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.count(t) for t in batch.column(1).to_pylist()], pa.int32())], ["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens int")


def decode_documents(ids: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, decoded) of every row of ``ids(doc_id, ids)``."""
    place = shipped(ids.sparkSession, vocabulary_path(path=path))

    def run(batches):
        a = automaton(place())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "decoded"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, decoded string")
