"""The query verbs over HTTP with JSON, and a client for them.

GET /health tells strangers only that the service is up.  POST /search and /similar want a bearer token.  Errors are
{"error": ..., "code": ...}; what went wrong inside is not told.
"""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .config import DEFAULT_LIMIT, Display
from .errors import AccessDenied, BadRequest, EngineError, NetworkFailure, NotFound, ServerFailure, Unauthorized, authorised
from .operators import search as S
from .sources.embed import Embedder
from .sources.store import Store

#: Bytes of a request's body, at most.
MOST_BYTES = 1 << 20


class Service:
    """Answers requests from the store's current version."""

    def __init__(self, store: Store, embedder: Embedder, model: str, token: str, display: Display | None = None, stem: bool = True):
        self.store, self.embedder, self.model, self.token = store, embedder, model, token
        self.display, self.stem = display or Display(), stem
        self._lock, self._held = threading.Lock(), (-1, None)

    def index(self) -> S.Index:
        """The current version's index, kept until the next version."""
        with self._lock:
            version = self.store.version
            if self._held[0] != version:
                self._held = version, self.store.index(self.stem)
            return self._held[1]

    def health(self, header: str | None) -> dict:
        try:
            authorised(header, self.token)
        except Unauthorized:
            return {"ok": True, "authenticated": False}
        return {"ok": True, "authenticated": True, "indexed_chunks": S.health(self.index()).first()[0], "last_reindex_ms": self.store.last_reindex_ms, "embedding_model": self.model, "dim": self.embedder.dim}

    def search(self, body: dict) -> dict:
        query, limit = _field(body, "query", str), _field(body, "limit", int, DEFAULT_LIMIT)
        alone, types = _field(body, "media_only", bool, False), _field(body, "media_types", list, [])
        if not query.strip():
            raise BadRequest("query must not be empty")
        index = self.index()
        return _hits(S.search(index, query, self.embedder.query(query.strip()).tolist(), limit, self.display, alone, types))

    def similar(self, body: dict) -> dict:
        path, limit = _field(body, "path", str), _field(body, "limit", int, DEFAULT_LIMIT)
        if not path.strip():
            raise BadRequest("path must not be empty")
        return _hits(S.similar(self.index(), path, limit, self.display))

    def answer(self, method: str, path: str, header: str | None, raw: bytes) -> tuple[int, dict]:
        """Status and body for one request."""
        try:
            if (method, path) == ("GET", "/health"):
                return 200, self.health(header)
            verb = {"/search": self.search, "/similar": self.similar}.get(path) if method == "POST" else None
            if verb is None:
                raise NotFound("no such path")
            authorised(header, self.token)
            try:
                body = json.loads(raw)
            except ValueError as e:
                raise BadRequest(f"the body is no JSON: {e}") from e
            if not isinstance(body, dict):
                raise BadRequest("the body must be an object")
            return 200, verb(body)
        except EngineError as e:
            status, code, message = (e.status, e.code, str(e)) if e.status != 500 else (500, "internal", "internal error")
        except Exception:  # noqa: BLE001  whatever it is, a caller must not see it
            status, code, message = 500, "internal", "internal error"
        return status, {"error": message, "code": code}

    def serve(self, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
        """Listens in a thread of its own; `server_address` of what it returns tells the port, `shutdown` ends it."""
        service = self

        class Handler(BaseHTTPRequestHandler):
            def _do(self) -> None:
                size = int(self.headers.get("Content-Length") or 0)
                if size > MOST_BYTES:
                    status, body = 400, {"error": "the body is too large", "code": "bad_request"}
                else:
                    status, body = service.answer(self.command, self.path.split("?")[0], self.headers.get("Authorization"), self.rfile.read(size))
                data = json.dumps(body, ensure_ascii=False).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            do_GET = do_POST = _do  # noqa: N815

            def log_message(self, *_: object) -> None:
                pass

        server = ThreadingHTTPServer((host, port), Handler)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        return server


def _field(body: dict, name: str, kind: type, default=None):
    value = body.get(name, default)
    if not isinstance(value, kind) or kind is int and isinstance(value, bool) or kind is int and value < 0 or kind is list and not all(isinstance(x, str) for x in value):
        raise BadRequest(f"{name}: invalid or missing")
    return value


def _hits(hits) -> dict:
    """At most as many as a request may ask for."""
    return {"hits": [json.loads(r[0]) for r in S.response(hits).collect()]}


class Client:
    """Asks a service."""

    def __init__(self, base: str, token: str, timeout_s: float = 30.0):
        self.base, self.token, self.timeout_s = base.rstrip("/"), token, timeout_s

    def _ask(self, path: str, body: dict | None = None) -> dict:
        request = urllib.request.Request(self.base + path, None if body is None else json.dumps(body).encode(), {"Authorization": f"Bearer {self.token}", "Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout_s) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            try:
                message = json.loads(e.read()).get("error") or "request failed"
            except (ValueError, AttributeError):
                message = "request failed"
            raise (AccessDenied if e.code in (401, 403) else ServerFailure)(f"{message} ({e.code})") from e
        except (OSError, ValueError) as e:
            raise NetworkFailure(str(e)) from e

    def health(self) -> dict:
        return self._ask("/health")

    def search(self, query: str, limit: int = DEFAULT_LIMIT, media_only: bool = False, media_types: list[str] | None = None) -> list[dict]:
        types = {"media_types": list(media_types)} if media_types else {}
        return self._ask("/search", {"query": query, "limit": limit, "media_only": media_only} | types)["hits"]

    def similar(self, path: str, limit: int = DEFAULT_LIMIT) -> list[dict]:
        return self._ask("/similar", {"path": path, "limit": limit})["hits"]
