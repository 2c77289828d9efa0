"""Rank fusion and display scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import RRF_K, Display, MediaLane


def rrf(*ranks: Column, k: float = RRF_K) -> Column:
    """Reciprocal rank fusion of 1-based ranks; null is absent."""
    total = F.lit(0.0)
    for r in ranks:
        total = total + F.coalesce(F.lit(1.0) / (F.lit(float(k)) + r), F.lit(0.0))
    return total


def branch_norm(rank: Column, k: float) -> Column:
    return F.coalesce(F.lit(k + 1.0) / (F.lit(float(k)) + rank), F.lit(0.0))


def normalized(v_rank: Column, b_rank: Column, display: Display) -> Column:
    return F.lit(display.weight_vec) * branch_norm(v_rank, display.k) + F.lit(display.weight_bm25) * branch_norm(b_rank, display.k)


def media_display(distance: Column, media_type: Column, lane: MediaLane) -> Column:
    """How near a medium is between its type's endpoints; null for text."""
    d = distance.cast("double")
    spread = lambda best, worst: F.least(F.greatest((F.lit(worst) - d) / F.lit(worst - best), F.lit(0.0)), F.lit(1.0))
    return F.when(media_type == "text", None).when(media_type == "pdf", spread(lane.best_pdf, lane.worst_pdf)).otherwise(spread(lane.best_image, lane.worst_image))


def gate(distance: Column, media_type: Column, lane: MediaLane) -> Column:
    """Whether a medium is near enough for the lane; compared as floats."""
    most = F.when(media_type == "pdf", F.lit(lane.gate_pdf)).otherwise(F.lit(lane.gate_image)).cast("float")
    return (media_type != "text") & (distance.cast("float") <= most)


def display_score(media_type: Column, v_rank: Column, b_rank: Column, distance: Column | None, display: Display) -> Column:
    """Text by both ranks; media by distance where known, else by vector rank."""
    media = branch_norm(v_rank, display.k)
    if distance is not None:
        media = F.coalesce(media_display(distance, media_type, display.lane), media)
    return F.when(media_type == "text", normalized(v_rank, b_rank, display)).otherwise(media)
