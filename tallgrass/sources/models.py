"""Embedding and reranking services behind two small protocols.

``clients`` has those over HTTP; a caller may pass any object that makes the calls.
Batching, bisection, retries and the time that all attempts have together are here,
so that every client gets them.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

BATCH, RETRIES, MAX_DELAY_S, CONTEXT_CHARACTERS = 100, 5, 60.0, 8000


class ServiceError(RuntimeError):
    """A failed call. ``status`` is that of HTTP; ``too_long`` means that the input exceeds the model's window."""

    def __init__(self, message: str, status: int | None = None, too_long: bool = False) -> None:
        super().__init__(message)
        self.status, self.too_long = status, too_long

    @property
    def passing(self) -> bool:
        return self.status == 429 or self.status is not None and 500 <= self.status < 600


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def rerank(self, query: str, texts: list[str], top_n: int) -> list[dict] | None: ...


def call_with_retry(
    call: Callable[..., object], wait: Callable[[float], None] = time.sleep, retries: int = RETRIES, only: Callable[[ServiceError], bool] = lambda e: e.passing, seconds: float | None = None, clock: Callable[[], float] = time.monotonic
):
    """``call()``, again after failures that pass. With ``seconds``, all attempts and waits share them, and ``call`` gets what is left."""
    end = None if seconds is None else clock() + seconds
    for attempt in range(retries + 1):
        left = None if end is None else end - clock()
        if left is not None and left <= 0:
            raise ServiceError("the time for all attempts is over")
        try:
            return call() if left is None else call(left)
        except ServiceError as e:
            if attempt == retries or not only(e):
                raise
            pause = min(2.0**attempt, MAX_DELAY_S)
            if end is not None and clock() + pause >= end:
                raise ServiceError("the time for all attempts is over") from e
            wait(pause)
    raise AssertionError


def embed_all(embedder: Embedder, texts: list[str], batch: int = BATCH, wait: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """Vectors in the order of the texts. A batch that is too long is halved; a single text is cut."""
    out: list[list[float]] = []
    for i in range(0, len(texts), batch):
        out += _embed(embedder, texts[i : i + batch], wait)
    return out


def _embed(embedder: Embedder, texts: list[str], wait) -> list[list[float]]:
    try:
        seconds = getattr(embedder, "timeout", None)
        vectors = call_with_retry(lambda *left: embedder.embed(texts, *left), wait, seconds=seconds)
    except ServiceError as e:
        if not e.too_long:
            raise
        if len(texts) == 1:
            if len(texts[0]) <= CONTEXT_CHARACTERS:
                raise
            return _embed(embedder, [texts[0][:CONTEXT_CHARACTERS]], wait)
        half = len(texts) // 2
        return _embed(embedder, texts[:half], wait) + _embed(embedder, texts[half:], wait)
    if len(vectors) != len(texts):
        raise ServiceError("as many vectors as texts were expected")
    return vectors


def with_embeddings(chunks: DataFrame, make_embedder: Callable[[], Embedder], batch: int = BATCH) -> DataFrame:
    """Add ``dense`` to chunks; one client per task, null texts get no vector."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields) + ", dense array<float>"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_embedder()
        for pdf in batches:
            has = pdf["text"].notna()
            found = iter(embed_all(client, pdf.loc[has, "text"].tolist(), getattr(client, "batch", batch)))
            yield pdf.assign(dense=[next(found) if h else None for h in has])

    return chunks.mapInPandas(run, schema)


class HashingEmbedder:
    """A stand-in without a model: signed term hashes, folded into ``dimensions`` numbers of length 1."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        import re
        import zlib

        import numpy as np

        out = []
        for t in texts:
            v = np.zeros(self.dimensions)
            for w in re.findall(r"[A-Za-z]+|\d+", t):
                h = zlib.crc32(w.lower().encode())
                v[h % self.dimensions] += 1 if h & 0x80000000 else -1
            n = float(np.linalg.norm(v))
            out.append((v / n if n else v).tolist())
        return out


def parse_rerank(answer: object) -> list[int] | None:
    """Order of positions from a service's answer; null if it has no list.

    Entries without a numeric index are dropped; ties keep their order.
    """
    if not isinstance(answer, dict):
        return None
    entries = answer.get("results")
    entries = answer.get("data") if entries is None else entries
    if not isinstance(entries, list):
        return None
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    usable = [e for e in entries if isinstance(e, dict) and number(e.get("index"))]
    score = lambda e: next((e[k] for k in ("relevance_score", "score") if number(e.get(k))), 0)
    return [int(e["index"]) for e in sorted(usable, key=lambda e: -score(e))]


def rerank(reranker: Reranker | None, query: str, texts: list[str], top_n: int, wait: Callable[[float], None] = time.sleep) -> list[int]:
    """Positions of the best ``top_n`` texts. Without a service, or if it fails, the given order."""
    plain = list(range(min(top_n, len(texts))))
    if reranker is None or not texts:
        return plain
    try:
        answer = call_with_retry(lambda *left: reranker.rerank(query, texts, top_n, *left), wait, only=lambda e: e.status == 429, seconds=getattr(reranker, "timeout", None))
    except Exception:
        return plain
    order = parse_rerank(answer if isinstance(answer, dict) else {"results": answer})
    return plain if order is None else [i for i in order if 0 <= i < len(texts)][:top_n]
