"""The query verbs: search, similar and their batch form, each one plan over an index snapshot."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Display, candidate_k, clamp_limit
from ..errors import BadRequest, DimMismatch, PathNotIndexed
from ..functions import vectors
from . import retrieval as R


@dataclass
class Index:
    """A snapshot: chunks (with path, chunk_idx, content, media columns), vectors (chunk_id, embedding), terms as
    `retrieval.indexed` makes them from text chunks, and file states."""

    chunks: DataFrame
    vectors: DataFrame
    terms: DataFrame
    files: DataFrame
    dim: int
    stemmed: bool = False


def health(index: Index) -> DataFrame:
    return index.chunks.agg(F.count("*").alias("chunks"))


def _ranks(index: Index, vector, phrases: Sequence[Sequence[str]], k: int) -> DataFrame:
    v = R.ranked(R.knn(index.vectors, vector, k), "distance", name="v_rank").select("chunk_id", "v_rank")
    b = R.ranked(R.bm25(index.terms, phrases, k), "score", name="b_rank").select("chunk_id", "b_rank")
    return R.fuse(v, b)


def search(index: Index, query: str, vector: Sequence[float], limit: int = 10, display: Display | None = None, media_only: bool = False, media_types: Sequence[str] = ()) -> DataFrame:
    """Hits of a text query whose embedding is `vector`."""
    display = display or Display()
    types = R.request_media_types(media_only, media_types)
    query = query.strip()
    if not query:
        raise BadRequest("query must not be blank")
    if len(vector) != index.dim:
        raise DimMismatch(f"query has {len(vector)} dimensions, the index {index.dim}")
    n, k, q = clamp_limit(limit), candidate_k(limit), R.literal(vector)
    if media_only:
        near = R.knn_media(index.vectors, index.chunks, q, k, types)
        alone = R.fuse(R.ranked(near, "distance", name="v_rank"), near.select("chunk_id", F.lit(None).cast("long").alias("b_rank")).limit(0))
        return R.hydrate(alone.drop("distance"), index.chunks, n, display, distances=near if display.lane.enabled else None)
    hits = R.hydrate(_ranks(index, q, R.phrases_of(query, index.stemmed), k), index.chunks, n, display)
    if not display.lane.enabled:
        return hits
    near = R.knn_media(index.vectors, index.chunks, q, k)
    alone = R.fuse(R.ranked(near, "distance", name="v_rank"), near.select("chunk_id", F.lit(None).cast("long").alias("b_rank")).limit(0))
    candidates = R.hydrate(alone.drop("distance"), index.chunks, k, display, distances=near).join(F.broadcast(near), "chunk_id")
    return R.media_lane(hits, candidates, n, display.lane)


def similar(index: Index, path: str, limit: int = 10, display: Display | None = None) -> DataFrame:
    """Hits like a document: its vectors' mean and its first text chunks are the query."""
    path = path.strip()
    if not path:
        raise BadRequest("path must not be blank")
    own = index.chunks.filter(F.col("path") == path)
    # At most four rows and one vector come to the driver, as the query's literals.
    texts = own.filter("media_type = 'text'").orderBy("chunk_idx").select("content").limit(4).collect()
    if not texts and not own.limit(1).count():
        if not index.files.filter(F.col("path") == path).limit(1).count():
            raise PathNotIndexed(path)
        return R.hydrate(_ranks(index, R.literal([0.0] * index.dim), [], 0), index.chunks, 0, display or Display())
    mean = vectors.centroid(index.vectors.join(own.select("chunk_id"), "chunk_id", "left_semi").withColumn("g", F.lit(1)), ["g"], dim=index.dim)
    row = mean.select(F.transform(vectors.normalised(F.col("centroid")), lambda x: x.cast("float")).alias("v")).first()
    if row is None:
        raise DimMismatch(f"{path} has no vector of {index.dim} dimensions")
    bag = "".join(r[0] + " " for r in texts)
    fused = _ranks(index, R.literal(row[0]), R.phrases_of(bag, index.stemmed), candidate_k(limit))
    return R.hydrate(fused, index.chunks, clamp_limit(limit), display or Display(), exclude_path=path)


def prefix_filter(hits: DataFrame, prefix: str) -> DataFrame:
    """Hits under a path prefix; applied after the limit, as a client does."""
    return hits.filter(F.startswith("path", F.lit(prefix)))


def response(hits: DataFrame) -> DataFrame:
    """Hits as JSON: null fields are left out, and `truncated` where it is false."""
    shown = [F.when(F.col(c), F.col(c)).alias(c) if c == "truncated" else F.col(c) for c in hits.columns]
    return hits.select(F.to_json(F.struct(*shown)).alias("hit"))
