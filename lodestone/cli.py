"""A thin command line over the query verbs.  Exit codes: 0 found, 1 usage, 2 failure, 3 access, 4 nothing found."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import AccessDenied, BadRequest, EngineError, Unauthorized, authorised
from .functions import text


def rendered(hits: DataFrame, width: int = 80) -> DataFrame:
    """Hits as text, one row each, in order."""
    tag = text.media_tag(F.col("media_type"), F.col("media_start"), F.col("media_end"), F.col("truncated"))
    rank = F.monotonically_increasing_id() + 1
    return hits.coalesce(1).select(text.format_hit(rank, F.col("score_normalized"), F.col("path"), F.col("heading_path"), F.col("snippet"), tag, width).alias("line"))


def arguments(argv: Sequence[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser("lodestone")
    p.add_argument("query")
    p.add_argument("--index", default="./index")
    p.add_argument("--server", default="", help="ask a service there instead of opening the index")
    p.add_argument("--token", default="")
    p.add_argument("--provider", default="")
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--path", default="")
    p.add_argument("--media-only", action="store_true")
    p.add_argument("--media-types", default="")
    p.add_argument("--json", action="store_true")
    a = p.parse_args(argv)
    if a.limit <= 0:
        raise BadRequest("limit must be positive")
    return a


def main(argv: Sequence[str] | None = None) -> int:
    try:
        a = arguments(sys.argv[1:] if argv is None else argv)
    except (SystemExit, BadRequest):
        return 1
    try:
        lines = _asked(a) if a.server else _opened(a)
    except (AccessDenied, Unauthorized) as e:
        print(e, file=sys.stderr)
        return 3
    except EngineError as e:
        print(e, file=sys.stderr)
        return 2
    print("\n".join(lines))
    return 0 if lines else 4


def _types(a: argparse.Namespace) -> list[str]:
    return [t for t in a.media_types.split(",") if t]


def _asked(a: argparse.Namespace) -> list[str]:
    """A service's hits, as JSON or as one line each."""
    from .service import Client

    hits = [h for h in Client(a.server, a.token).search(a.query, a.limit, a.media_only, _types(a)) if h["path"].startswith(a.path)]
    return [json.dumps(h, ensure_ascii=False) if a.json else f"{i}. {h['score_normalized']:.2f}  {h['path']}  {h['snippet']}" for i, h in enumerate(hits, 1)]


def _opened(a: argparse.Namespace) -> list[str]:
    from pyspark.sql import SparkSession

    from .operators import search as S
    from .session import ship
    from .sources import embed
    from .sources.store import Store

    spark = ship(SparkSession.builder.appName("lodestone").getOrCreate())
    store = Store(spark, a.index)
    index, meta = store.index(), store.meta()
    provider = a.provider or meta.get("embedding_provider", "")
    _, embedder = embed.create(provider, meta.get("embedding_model", ""), index.dim, dict(os.environ))
    hits = S.search(index, a.query, embedder.query(a.query).tolist(), a.limit, media_only=a.media_only, media_types=_types(a))
    hits = S.prefix_filter(hits, a.path) if a.path else hits
    return [r[0] for r in (S.response(hits) if a.json else rendered(hits)).collect()]


__all__ = ["arguments", "authorised", "main", "rendered"]

if __name__ == "__main__":
    sys.exit(main())
