"""Settings: named constants that shape results, dataclasses with validation, and layered loading (arguments over
environment over TOML over defaults)."""

from __future__ import annotations

import math
import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from .errors import BadRequest

#: Fixed values that results depend on.
RRF_K = 60
CANDIDATES = 30
MAX_LIMIT = 50
DEFAULT_LIMIT = 10
SNIPPET = 240
CHUNK_WORDS = 500
CHUNK_OVERLAP = 50
SCHEMA_VERSION = "3"
PATH_SCHEMA_VERSION = "1"
MEDIA_PROTOCOL = "media-v1"
MEDIA_TYPES = ("text", "image", "pdf", "audio", "video")
TRUE = ("1", "true", "yes", "on")


def clamp_limit(n: int) -> int:
    return DEFAULT_LIMIT if n == 0 else min(n, MAX_LIMIT)


def candidate_k(limit: int) -> int:
    return max(CANDIDATES, clamp_limit(limit))


@dataclass(frozen=True)
class MediaLane:
    enabled: bool = False
    fraction: float = 0.25
    gate_image: float = 0.40
    gate_pdf: float = 0.45
    best_image: float = 0.25
    worst_image: float = 0.50
    best_pdf: float = 0.35
    worst_pdf: float = 0.60

    def __post_init__(self) -> None:
        if not (math.isfinite(self.fraction) and 0 <= self.fraction <= 1):
            raise ValueError("media lane fraction must be within [0, 1]")
        for f in fields(self)[2:]:
            v = getattr(self, f.name)
            if not (math.isfinite(v) and v > 0):
                raise ValueError(f"media lane {f.name} must be finite and positive")
        if self.best_image >= self.worst_image or self.best_pdf >= self.worst_pdf:
            raise ValueError("media lane: best must be below worst")

    def gate(self, media_type: str) -> float | None:
        return None if media_type == "text" else self.gate_pdf if media_type == "pdf" else self.gate_image


@dataclass(frozen=True)
class Display:
    k: float = 10.0
    weight_vec: float = 0.55
    weight_bm25: float | None = None
    lane: MediaLane = field(default_factory=MediaLane)

    def __post_init__(self) -> None:
        if not self.k > 0:
            raise ValueError("display k must be positive")
        if self.weight_bm25 is None:
            object.__setattr__(self, "weight_bm25", 1 - self.weight_vec)
        if not (0 <= self.weight_vec <= 1 and 0 <= self.weight_bm25 <= 1):
            raise ValueError("display weights must be within [0, 1]")
        if not 0.99 <= self.weight_vec + self.weight_bm25 <= 1.01:
            raise ValueError("display weights must sum to 1")


@dataclass(frozen=True)
class MediaOptions:
    enabled: bool = False
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    exclude_types: tuple[str, ...] = ()
    max_file_mb: int = 20
    pdf_pages_per_chunk: int = 6
    pdf_dpi: int = 150

    def __post_init__(self) -> None:
        if self.max_file_mb <= 0:
            raise ValueError("max_file_mb must be positive")
        if not 1 <= self.pdf_pages_per_chunk <= 6:
            raise ValueError("pdf_pages_per_chunk must be within 1..6")
        if not 72 <= self.pdf_dpi <= 300:
            raise ValueError("pdf_dpi must be within 72..300")
        types = tuple(dict.fromkeys(t.strip().lower() for t in self.exclude_types))
        if bad := [t for t in types if t not in MEDIA_TYPES[1:]]:
            raise ValueError(f"exclude_types {bad[0]!r}: not a media type")
        object.__setattr__(self, "exclude_types", types)


@dataclass(frozen=True)
class Settings:
    root: str = "."
    index: str = "./index"
    provider: str = ""
    model: str = ""
    dim: int = 0
    listen: str = "127.0.0.1:8080"
    debounce_ms: int = 5000
    http_timeout_ms: int = 30_000
    display: Display = field(default_factory=Display)
    media: MediaOptions = field(default_factory=MediaOptions)


_SECTIONS = {"display": Display, "media": MediaOptions, "lane": MediaLane}


def _cast(kind: str, value):
    if not isinstance(value, str) or kind.startswith("str"):
        return tuple(value) if kind.startswith("tuple") and not isinstance(value, str) else value
    if kind.startswith("bool"):
        return value.strip().lower() in TRUE
    if kind.startswith("tuple"):
        return tuple(x.strip() for x in value.split(",") if x.strip())
    return (int if kind.startswith("int") else float)(value)


def _build(cls, prefix: str, layers: list[Mapping], errors: list[str]):
    values = {}
    for f in fields(cls):
        if f.name in _SECTIONS:
            nested = [x.get(f.name, {}) if not x.get("__flat__") else x for x in layers]
            values[f.name] = _build(_SECTIONS[f.name], f"{prefix}{f.name}_", nested, errors)
            continue
        for layer in layers:
            key = f"{prefix}{f.name}" if layer.get("__flat__") else f.name
            if layer.get(key) not in (None, ""):
                try:
                    values[f.name] = _cast(str(f.type), layer[key])
                except ValueError:
                    errors.append(f"{prefix}{f.name}: invalid value {layer[key]!r}")
                break
    try:
        return cls(**values)
    except ValueError as e:
        errors.append(str(e))
        return None


def load(flags: Mapping | None = None, environment: Mapping | None = None, path: str | None = None, prefix: str = "LODESTONE_") -> Settings:
    """Settings from all layers.  Every problem is reported, joined by "; "."""
    environment = os.environ if environment is None else environment
    env = {k.removeprefix(prefix).lower(): v for k, v in environment.items() if k.startswith(prefix)} | {"__flat__": True}
    file: dict = {}
    errors: list[str] = []
    if path:
        with open(path, "rb") as f:
            file = tomllib.load(f)
        known = {f.name for f in fields(Settings)}
        errors += [f"unknown key {k!r}" for k in file if k not in known]
        for name, cls in (("display", Display), ("media", MediaOptions)):
            errors += [f"unknown key {name}.{k}" for k in file.get(name, {}) if k not in {f.name for f in fields(cls)}]
    layers = [(flags or {}) | {"__flat__": True}, env, file]
    out = _build(Settings, "", layers, errors)
    if out is not None:
        if out.debounce_ms < 0 or out.http_timeout_ms < 0:
            errors.append("debounce_ms and http_timeout_ms must not be negative")
        host, _, port = out.listen.rpartition(":")
        if not host or not port.isdigit() or int(port) > 65535:
            errors.append(f"listen {out.listen!r}: expected host:port")
    if errors:
        raise BadRequest("; ".join(errors))
    return out
