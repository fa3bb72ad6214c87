"""The embedding stage: batches through a pluggable callable, with a retry and the isolation of texts it can't take."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Texts a batch, pause before the one retry, time a batch may take, messages that call for the retry.
BATCH, RETRY_SECONDS = 50, 2.0
TIMEOUT_SECONDS = 30.0
COLD = ("connection refused", "connection reset", "timed out", "temporarily unavailable")

Embedder = Callable[[list[str]], list[list[float]]]


class TooLong(ValueError):
    """Raised by an embedder for a batch that holds a text over its context."""


def hashed_words(dim: int = 64) -> Embedder:
    """A deterministic embedder without a model: signed hashes of words and of their three-letter parts."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in t.lower().split():
                for part in [w, *(w[i : i + 3] for i in range(len(w) - 2))]:
                    h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "big")
                    v[h % dim] += 1 if h >> 63 else -1
            n = float(np.linalg.norm(v))
            out.append([float(x) for x in (v / n if n else v)])
        return out

    return embed


def within(embedder: Embedder, seconds: float = TIMEOUT_SECONDS) -> Embedder:
    """``embedder``, given up with TimeoutError ("timed out") after ``seconds``."""

    def call(texts: list[str]) -> list[list[float]]:
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(embedder, texts).result(seconds)
        except FutureTimeout:
            raise TimeoutError(f"the embedder timed out after {seconds:g} s") from None
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return call


def embed_batch(texts: list[str], embedder: Embedder, pause: float = RETRY_SECONDS) -> list[list[float] | None]:
    """Vectors of a batch; a text that can't be taken alone gets None. One retry after a cold-start failure."""
    if not texts:
        return []
    try:
        try:
            return list(embedder(texts))
        except TooLong:
            raise
        except Exception as e:
            if not any(m in str(e).lower() for m in COLD):
                raise
            time.sleep(pause)
            return list(embedder(texts))
    except TooLong:
        if len(texts) == 1:
            return [None]
        mid = len(texts) // 2
        return embed_batch(texts[:mid], embedder, pause) + embed_batch(texts[mid:], embedder, pause)


def embed_rows(rows: DataFrame, text: str, embedder: Embedder, tokens: str | None = None, most: int = 8192) -> DataFrame:
    """``rows`` with ``vector``; rows over ``most`` tokens, and those whose text can't be embedded or gives zeros, are dropped."""
    kept = rows if tokens is None else rows.where(F.col(tokens) <= most)
    names = kept.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", vector array<float>"

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            vectors: list = []
            for i in range(0, len(pdf), BATCH):
                vectors += embed_batch([t or "" for t in pdf[text].iloc[i : i + BATCH]], embedder)
            out = pdf.assign(vector=vectors)
            yield out[[v is not None and any(v) for v in vectors]][[*names, "vector"]]

    return kept.mapInPandas(run, schema)
