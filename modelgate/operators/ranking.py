"""Orderings and top-k reports over model-level tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelgate.functions.text import signed_percent
from modelgate.operators.common import top_k_per_group
from modelgate.operators.ordering import place_in_group
from modelgate.schema import MODEL_KEY


def worst_segments(deltas: DataFrame, segment_type: str | None = None) -> DataFrame:
    """Segment deltas of one segment column ranked by relative delta, worst
    first (ties keep comparison order), with display rounding and text."""
    d = deltas if segment_type is None else deltas.where(F.col("segment_column") == segment_type)
    ranked = place_in_group(d, [*MODEL_KEY, "segment_column"], [F.col("rmse_delta_pct").desc(), F.col("ord")], "rank")
    return ranked.select(
        *MODEL_KEY, "segment_column", F.col("segment_value").alias("segment"),
        F.bround("candidate_rmse", 2).alias("candidate_rmse"), F.bround("champion_rmse", 2).alias("champion_rmse"),
        signed_percent(F.col("rmse_delta_pct")).alias("delta_pct"),
        "rank",
    )


def segment_tail(segments: DataFrame, n: int = 10, keys: list[str] = MODEL_KEY) -> DataFrame:
    """The ``n`` worst segments (highest rmse) per model key and segment
    column: an exact, skew-safe top-n."""
    return top_k_per_group(
        segments, [*keys, "segment_column"], [F.col("rmse").desc(), F.col("segment")], n
    )


def newest_versions(runs: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` versions per model, versions compared as numbers."""
    return top_k_per_group(
        runs, ["model_name"], [F.col("model_version").cast("bigint").desc(), F.col("model_version").desc()], n
    )
