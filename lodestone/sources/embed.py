"""Embedding providers: what they offer, and how rows are embedded in batches."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import time
import urllib.error
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..errors import DimMismatch, EmbedError, EngineError
from .policy import framed

Parts = Sequence[tuple[str, bytes]]


@dataclass(frozen=True)
class Model:
    provider: str
    name: str
    native_dim: int
    dims: tuple[int, ...]  # empty: any
    doc_task: str
    query_task: str
    media: bool = False
    pdf: str = "none"


def _models() -> list[Model]:
    #: Public models, their vector lengths and task labels.
    gemini, voyage = (768, 1536, 3072), (256, 512, 1024, 2048)
    out = [
        Model("gemini", "gemini-embedding-001", 3072, gemini, "RETRIEVAL_DOCUMENT", "RETRIEVAL_QUERY"),
        Model("gemini", "gemini-embedding-2", 3072, gemini, "document", "query", True, "native"),
    ]
    out += [Model("voyage", m, 1024, voyage, "document", "query") for m in ("voyage-4", "voyage-4-lite", "voyage-4-large", "voyage-context-4", "voyage-code-3")]
    return [*out, Model("voyage", "voyage-multimodal-3.5", 1024, voyage, "document", "query", True, "raster")]


MODELS = _models()
DEFAULTS = {"gemini": "gemini-embedding-2", "voyage": "voyage-4", "fake": "fake"}
KEYS = {"gemini": "GEMINI_API_KEY", "voyage": "VOYAGE_API_KEY"}


def provider_of(name: str, environment: dict[str, str]) -> str:
    """The named provider, or the first that has a key, or the fake one."""
    if name:
        if name not in DEFAULTS:
            raise EmbedError(f"unknown provider {name!r}; one of {', '.join(DEFAULTS)}")
        return name
    return next((p for p, key in KEYS.items() if environment.get(key)), "fake")


def lookup(provider: str, model: str, dim: int = 0) -> Model:
    """A registered model; with `dim`, only if it can give vectors of that length."""
    if provider == "fake":
        found = Model("fake", model or "fake", 128, (), "document", "query", True, "raster")
    else:
        known = [m for m in MODELS if m.provider == provider]
        found = next((m for m in known if m.name == (model or DEFAULTS.get(provider))), None)
        if found is None:
            raise EmbedError(f"unknown model {model!r}; one of {', '.join(m.name for m in known)}")
    if dim and found.dims and dim not in found.dims:
        raise EmbedError(f"{found.name} has no {dim} dimensions; one of {', '.join(map(str, found.dims))}")
    return found


class Embedder(ABC):
    """Embeds documents, given as text or as media parts, and queries."""

    dim: int
    batch = 128

    @abstractmethod
    def documents(self, inputs: list[str | Parts]) -> list[np.ndarray]: ...

    @abstractmethod
    def query(self, text: str) -> np.ndarray: ...


class Fake(Embedder):
    """Deterministic vectors from hashes, for tests and for lack of a key."""

    def __init__(self, dim: int = 128):
        self.dim = dim

    def _vector(self, seed: bytes) -> np.ndarray:
        blocks = (hashlib.sha256(seed + struct.pack("<Q", i)).digest()[:16] for i in range(0, self.dim, 8))
        v = (np.frombuffer(b"".join(blocks), dtype=">i2")[: self.dim].astype(np.float32) / np.float32(32768)).astype(np.float32)
        size = np.float32(np.sqrt((v.astype(np.float64) ** 2).sum()))
        return v / size if size else v

    def documents(self, inputs: list[str | Parts]) -> list[np.ndarray]:
        return [self._vector(b"document\0text\0" + x.encode() if isinstance(x, str) else b"document\0media\0" + framed(x)[8:]) for x in inputs]

    def query(self, text: str) -> np.ndarray:
        return self._vector(b"query\0" + text.encode())


@dataclass(frozen=True)
class Request:
    """What is sent to a provider, and the place of the vectors in its answer."""

    url: str
    headers: dict[str, str]
    body: dict
    found: Callable[[dict], list]


def _media(part: tuple[str, bytes]) -> str:
    return base64.b64encode(part[1]).decode()


def _rows_in_order(answer: dict) -> list:
    return [r["embedding"] for r in sorted(answer.get("data", []), key=lambda r: r.get("index", 0))]


def gemini_request(model: Model, dim: int, inputs: list[str | Parts], query: bool, key: str = "", base: str = "https://generativelanguage.googleapis.com") -> Request:
    """One text of the older model, with its task type; of the newer one, a query or a batch of documents."""
    headers, at = {"x-goog-api-key": key}, f"{base}/v1beta/models/{model.name}"
    one = lambda answer: [answer["embedding"]["values"]] if "embedding" in answer else []
    if not model.media:
        body = {"content": {"parts": [{"text": inputs[0]}]}, "taskType": model.query_task if query else model.doc_task, "outputDimensionality": dim}
        return Request(f"{at}:embedContent", headers, body, one)

    def shown(x: str | Parts) -> dict:
        if isinstance(x, str):
            return {"parts": [{"text": ("task: search result | query: " if query else "title: none | text: ") + x}]}
        return {"parts": [{"inlineData": {"mimeType": p[0], "data": _media(p)}} for p in x]}

    each = [{"model": f"models/{model.name}", "content": shown(x), "outputDimensionality": dim} for x in inputs]
    if query:
        return Request(f"{at}:embedContent", headers, each[0], one)
    return Request(f"{at}:batchEmbedContents", headers, {"requests": each}, lambda answer: [e["values"] for e in answer.get("embeddings", [])])


def voyage_request(model: Model, dim: int, inputs: list[str | Parts], query: bool, key: str = "", base: str = "https://api.voyageai.com") -> Request:
    """Texts, or for the model of several media each input's parts; nothing is cut short by the service."""
    common = {"model": model.name, "input_type": model.query_task if query else model.doc_task, "truncation": False, "output_dimension": dim}
    headers = {"Authorization": f"Bearer {key}"}
    if not model.media:
        return Request(f"{base}/v1/embeddings", headers, common | {"input": inputs}, _rows_in_order)

    def shown(x: str | Parts) -> dict:
        if isinstance(x, str):
            return {"content": [{"type": "text", "text": x}]}
        return {"content": [{"type": "image_base64", "image_base64": f"data:{p[0]};base64,{_media(p)}"} for p in x]}

    return Request(f"{base}/v1/multimodalembeddings", headers, common | {"inputs": [shown(x) for x in inputs]}, _rows_in_order)


REQUESTS = {"gemini": gemini_request, "voyage": voyage_request}
Post = Callable[[Request], tuple[int, dict, float | None]]


def http_post(timeout_s: float = 30.0) -> Post:
    """Transport over HTTP: status, answer and how long the service says to wait."""

    def post(request: Request) -> tuple[int, dict, float | None]:
        asked = urllib.request.Request(request.url, json.dumps(request.body).encode(), {"Content-Type": "application/json"} | request.headers)
        try:
            with urllib.request.urlopen(asked, timeout=timeout_s) as answer:
                return answer.status, json.loads(answer.read()), None
        except urllib.error.HTTPError as e:
            raw, after = e.read(), e.headers.get("Retry-After", "")
            try:
                body = json.loads(raw)
            except ValueError:
                body = {"error": raw.decode(errors="replace")}
            return e.code, body if isinstance(body, dict) else {"error": str(body)}, float(after) if after.isdigit() else None
        except ValueError as e:
            raise EmbedError(f"an answer that is no JSON: {e}") from e

    return post


class Remote(Embedder):
    """A provider behind a service.  `post` does the transport; 429, 5xx and transport errors (OSError) are tried again."""

    def __init__(self, model: Model, dim: int, post: Post, sleep: Callable[[float], None] = time.sleep, key: str = ""):
        self.model, self.dim, self.post, self.sleep, self.key = model, dim, post, sleep, key
        self.tries, self.first = (6, 1.0) if model.provider == "voyage" else (4, 0.2)
        self.batch = (4 if model.media else 128) if model.provider == "voyage" else (16 if model.media else 1)

    def _call(self, inputs: list[str | Parts], query: bool) -> list[np.ndarray]:
        request = REQUESTS[self.model.provider](self.model, self.dim, inputs, query, self.key)
        wait, why = self.first, ""
        for left in range(self.tries - 1, -1, -1):
            after = None
            try:
                status, body, after = self.post(request)
                if status == 200:
                    return self._vectors(request.found(body), len(inputs))
                error = body.get("error", body.get("detail", status))
                why = told(str(error.get("message", error) if isinstance(error, dict) else error))
                if status != 429 and status < 500:
                    raise EmbedError(why)
            except OSError as e:
                why = told(str(e))
            if left:
                self.sleep(delay(after, wait))
                wait *= 2
        raise EmbedError(why)

    def _vectors(self, rows: list, n: int) -> list[np.ndarray]:
        if len(rows) != n:
            raise EmbedError(f"{n} inputs, {len(rows)} embeddings")
        out = [np.asarray(r, dtype=np.float32) for r in rows]
        if bad := [len(v) for v in out if len(v) != self.dim]:
            raise DimMismatch(f"an embedding has {bad[0]} dimensions, not {self.dim}")
        return out

    def documents(self, inputs: list[str | Parts]) -> list[np.ndarray]:
        if not self.model.media and any(not isinstance(x, str) for x in inputs):
            raise EmbedError(f"{self.model.name} takes no media")
        out: list[np.ndarray] = []
        for s in range(0, len(inputs), self.batch):
            try:
                out += self._call(list(inputs[s : s + self.batch]), False)
            except EmbedError as e:
                raise EmbedError(f"doc[{s}]: {e}" if self.batch == 1 else str(e)) from e
        return out

    def query(self, text: str) -> np.ndarray:
        return self._call([text], True)[0]


def create(provider: str, model: str, dim: int, environment: dict[str, str], post: Post | None = None) -> tuple[Model, Embedder]:
    """The embedder that settings and keys in the environment ask for."""
    provider = provider_of(provider, environment)
    found = lookup(provider, model, dim)
    length = dim or found.native_dim
    if provider == "fake":
        return found, Fake(length)
    key = environment.get(KEYS[provider], "")
    if not key:
        raise EmbedError(f"{KEYS[provider]} is not set")
    return found, Remote(found, length, post or http_post(), key=key)


def delay(retry_after: float | None, backoff: float) -> float:
    """How long to wait: what the service says, up to a minute, or the backoff."""
    return min(retry_after, 60.0) if retry_after is not None else backoff


def told(message: str, most: int = 200) -> str:
    """An error in one short line."""
    clean = "".join(" " if ord(c) < 32 or ord(c) == 127 else c for c in message)
    return clean if len(clean) <= most else clean[:most] + "…"


def embedded(rows: DataFrame, embedder: Embedder, column: str = "content", key: str = "content_hash", isolate: bool = False) -> DataFrame:
    """key and embedding of rows of distinct contents, in batches of the provider's size.  A row with media parts in
    `parts` is embedded by these.  With `isolate`, a batch that fails is tried input by input, and those that fail alone
    have no embedding but an `error`."""
    with_parts = "parts" in rows.columns

    def each(inputs: list) -> list[tuple[np.ndarray | None, str | None]]:
        try:
            return [(v, None) for v in embedder.documents(inputs)]
        except EngineError as e:
            if not isolate:
                raise
            return [(None, told(str(e)) or type(e).__name__)] if len(inputs) == 1 else [r for x in inputs for r in each([x])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            inputs = f[column].tolist()
            if with_parts:
                inputs = [x if p is None else [(q["mime"], bytes(q["data"])) for q in p] for x, p in zip(inputs, f["parts"], strict=True)]
            got: list[tuple[np.ndarray | None, str | None]] = []
            for s in range(0, len(inputs), embedder.batch):
                got += each(inputs[s : s + embedder.batch])
            out = pd.DataFrame({key: f[key], "embedding": [v for v, _ in got]})
            yield out.assign(error=[e for _, e in got]) if isolate else out

    chosen = rows.select(key, column, "parts") if with_parts else rows.select(key, column)
    return chosen.mapInPandas(run, f"{key} string, embedding array<float>" + (", error string" if isolate else ""))


def encode_f32(vector: Sequence[float]) -> bytes:
    return np.asarray(vector, dtype="<f4").tobytes()


def decode_f32(data: bytes) -> np.ndarray:
    if len(data) % 4:
        raise ValueError("a vector's bytes must be a multiple of 4")
    return np.frombuffer(data, dtype="<f4")
