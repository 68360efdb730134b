"""Clients of embedding and reranking services over HTTP, configured by the environment."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from tallgrass.sources.models import HashingEmbedder, ServiceError

#: Seconds that all attempts of a call may take together.
EMBED_TIMEOUT, RERANK_TIMEOUT = 60.0, 30.0
#: Kinds of rerank services that take the same request, and where it goes without a URL.
RERANK_PROVIDERS = frozenset("cohere maas openai-compatible".split())
RERANK_URL = "https://api.cohere.com/v2/rerank"


def _post(url: str, key: str, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Authorization": f"Bearer {key}", "Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        text = e.read().decode("utf-8", "replace")
        raise ServiceError(text[:500], e.code, "maximum context length" in text.lower() or "context_length" in text.lower()) from e
    except (OSError, ValueError) as e:
        raise ServiceError(str(e)) from e


@dataclass
class HttpEmbedder:
    """Embeddings by the usual request ``{model, input}``; vectors come back in the order of the texts.

    ``timeout`` is what all attempts of one batch have together (see ``models.call_with_retry``).
    """

    url: str
    key: str
    model: str
    timeout: float = EMBED_TIMEOUT
    batch: int = 100

    def embed(self, texts: list[str], left: float | None = None) -> list[list[float]]:
        answer = _post(self.url.rstrip("/") + "/embeddings", self.key, {"model": self.model, "input": texts}, self.timeout if left is None else left)
        rows = answer.get("data") if isinstance(answer, dict) else None
        if not isinstance(rows, list):
            raise ServiceError("the answer has no vectors")
        return [r["embedding"] for r in sorted(rows, key=lambda r: r["index"])]


@dataclass
class HttpReranker:
    """Reranking by the usual request ``{model, query, documents, top_n}``."""

    url: str
    key: str
    model: str
    timeout: float = RERANK_TIMEOUT

    def rerank(self, query: str, texts: list[str], top_n: int, left: float | None = None) -> dict:
        return _post(self.url, self.key, {"model": self.model, "query": query, "documents": texts, "top_n": top_n}, self.timeout if left is None else left)


def embedder_of(env: Mapping[str, str], dimensions: int) -> Callable[[], object]:
    """What makes the embedder that the environment names: a service if there is a key, else the stand-in."""
    key = env.get("EMBEDDER_API_KEY") or env.get("OPENAI_API_KEY")
    if not key:
        return lambda: HashingEmbedder(dimensions)
    url, name, batch = env.get("EMBEDDER_URL") or "https://api.openai.com/v1", env.get("EMBEDDER_MODEL") or "text-embedding-3-small", int(env.get("EMBEDDER_BATCH_SIZE") or 100)
    return lambda: HttpEmbedder(url, key, name, batch=batch)


def reranker_of(env: Mapping[str, str]) -> HttpReranker | None:
    """The reranker that the environment names. Without a known ``RERANKER_PROVIDER`` or without a key there is none."""
    if (env.get("RERANKER_PROVIDER") or "none") not in RERANK_PROVIDERS or not env.get("RERANKER_API_KEY"):
        return None
    return HttpReranker(env.get("RERANKER_URL") or RERANK_URL, env["RERANKER_API_KEY"], env.get("RERANKER_MODEL") or "rerank-english-v3.0")
