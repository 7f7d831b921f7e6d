"""Encoder and scorer extension points: Python callables behind Arrow-batched functions, with deterministic stand-ins."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashed_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A stand-in encoder: hashed bags of words, unit length; equal texts have equal vectors on every worker."""

    def encode(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return encode


def embed(text: Column, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 32) -> Column:
    """Vectors of a text column; the encoder is made once per task and called with up to ``batch`` texts."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_encoder()
        for s in parts:
            texts = s.fillna("").tolist()
            rows = [encode(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            yield pd.Series([v for m in rows for v in m.tolist()])

    return run(text)


def score_pairs(query: Column, text: Column, make_scorer: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> Column:
    """Scores of (query, text) pairs by an injected re-ranker, one call per Arrow batch."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = make_scorer()
        for q, t in parts:
            yield pd.Series(score(list(zip(q.fillna(""), t.fillna("")))), dtype=float)

    return run(query, text)


def overlap_scorer() -> Callable[[list[tuple[str, str]]], list[float]]:
    """A stand-in re-ranker: the share of the query's words that the text has."""

    def score(pairs):
        out = []
        for q, t in pairs:
            words = set(q.lower().split())
            out.append(len(words & set(t.lower().split())) / max(1, len(words)))
        return out

    return score


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], dict]]:
    """``df`` with a row count that is known once it has run, and the seconds since this call."""
    from pyspark.sql import Observation

    seen, began = Observation(name), time.time()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), lambda: {**seen.get, "seconds": time.time() - began}
