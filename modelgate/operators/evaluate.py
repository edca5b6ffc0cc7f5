"""Regression error metrics, overall and per segment, for a fleet of models.

Inputs are *scored* rows: one row per (model key, observation) with the
actual target and the model's prediction. All metrics are plain partial +
final hash aggregates, so a hot model key or segment is pre-aggregated
map-side and never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelgate.operators.ordering import place_in_group
from modelgate.schema import DEFAULT_SEGMENT_COLUMNS, MODEL_KEY, TARGET_COLUMN


def _metric_aggs(actual: str, prediction: str) -> list[Column]:
    err = F.col(actual) - F.col(prediction)
    return [
        F.count(F.lit(1)).alias("count"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.avg(F.col(actual)).alias("mean_actual"),
        F.avg(F.col(prediction)).alias("mean_prediction"),
    ]


def overall_metrics(
    scored: DataFrame,
    keys: list[str] = MODEL_KEY,
    actual: str = TARGET_COLUMN,
    prediction: str = "prediction",
) -> DataFrame:
    """RMSE and MAE per model key."""
    err = F.col(actual) - F.col(prediction)
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
    )


def require_rows(metrics: DataFrame) -> DataFrame:
    """Driver guard: metrics over an empty collection are an error."""
    if metrics.limit(1).count() == 0:
        raise ValueError("Cannot compute regression metrics for an empty collection.")
    return metrics


def segment_metrics(
    scored: DataFrame,
    segment_column: str,
    keys: list[str] = MODEL_KEY,
    actual: str = TARGET_COLUMN,
    prediction: str = "prediction",
) -> DataFrame:
    """count, rmse, mae, mean_actual, mean_prediction per segment value of one
    column (null segments dropped), with ``ord`` = position (from 1) in (rmse,
    segment) order within the model key."""
    seg = F.col(segment_column).cast("string")
    out = (
        scored.where(F.col(segment_column).isNotNull())
        .groupBy(*keys, seg.alias("segment"))
        .agg(*_metric_aggs(actual, prediction))
    )
    return place_in_group(out, list(keys), [F.col("rmse"), F.col("segment")], "ord")


def evaluate_grouping_sets(
    scored: DataFrame,
    segment_columns: tuple[str, ...] | list[str] = DEFAULT_SEGMENT_COLUMNS,
    keys: list[str] = MODEL_KEY,
    actual: str = TARGET_COLUMN,
    prediction: str = "prediction",
) -> DataFrame:
    """Overall and every per-segment table in ONE scan and ONE aggregate.

    ``GROUPING SETS ((keys), (keys, c1), (keys, c2), ...)`` expands each row
    once per set inside the scan stage and feeds a single partial/final
    aggregate. Output: ``keys, segment_column, segment, count, rmse, mae,
    mean_actual, mean_prediction``; the overall row has ``segment_column``
    null. Null segment values are dropped from the segment tables (a group
    with a null key is not a segment), told apart from subtotal rows by
    ``grouping()``.
    """
    segment_columns = list(segment_columns)
    sets = [[F.col(k) for k in keys]] + [[F.col(k) for k in keys] + [F.col(c)] for c in segment_columns]
    grouped = scored.groupingSets(sets, *[F.col(k) for k in keys], *[F.col(c) for c in segment_columns])
    flags = [F.grouping(c).alias(f"__g_{i}") for i, c in enumerate(segment_columns)]
    agg = grouped.agg(*_metric_aggs(actual, prediction), *flags)

    seg_col = F.lit(None).cast("string")
    seg_val = F.lit(None).cast("string")
    for i, c in reversed(list(enumerate(segment_columns))):
        is_set = F.col(f"__g_{i}") == 0
        seg_col = F.when(is_set, F.lit(c)).otherwise(seg_col)
        seg_val = F.when(is_set, F.col(c).cast("string")).otherwise(seg_val)
    drop_null_segment = F.lit(False)
    for i, c in enumerate(segment_columns):
        drop_null_segment = drop_null_segment | ((F.col(f"__g_{i}") == 0) & F.col(c).isNull())
    return agg.where(~drop_null_segment).select(
        *keys,
        seg_col.alias("segment_column"),
        seg_val.alias("segment"),
        "count",
        "rmse",
        "mae",
        "mean_actual",
        "mean_prediction",
    )


def split_evaluation(evaluation: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(overall rows, segment rows) of an ``evaluate_grouping_sets`` result."""
    overall = evaluation.where(F.col("segment_column").isNull()).drop("segment_column", "segment")
    segments = evaluation.where(F.col("segment_column").isNotNull())
    return overall, segments
