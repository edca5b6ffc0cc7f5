"""Deterministic promotion gate for a batch of candidates.

All rules are column expressions over one row per candidate, so the gate of
a whole fleet is a single projection. Inputs are model-level tables
(candidates x a handful of columns); nothing here touches observation rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelgate import fixed as T
from modelgate.functions.text import fill, percent, signed_percent, thousands
from modelgate.operators.common import top_k_per_group
from modelgate.fixed import (
    DECISION_MANUAL_REVIEW,
    DECISION_PROMOTE,
    DECISION_REJECT,
    DEFAULT_THRESHOLDS,
    REVIEW_STATUS_AUTO_REJECTED,
    REVIEW_STATUS_PENDING,
)

THRESHOLD_COLUMNS = list(DEFAULT_THRESHOLDS)
MAX_LISTED_SEGMENTS = 5


def with_thresholds(
    df: DataFrame, overrides: dict | None = None, per_model: DataFrame | None = None
) -> DataFrame:
    """Add the five threshold columns: per-model table value, else override,
    else default. ``per_model`` has ``model_name`` plus any threshold column."""
    merged = {**DEFAULT_THRESHOLDS, **(overrides or {})}
    out = df
    if per_model is not None:
        cols = [c for c in per_model.columns if c in THRESHOLD_COLUMNS]
        out = out.join(per_model.select("model_name", *[F.col(c).alias(f"__t_{c}") for c in cols]), "model_name", "left")
    else:
        cols = []
    exprs = []
    for name, value in merged.items():
        lit = F.lit(bool(value)) if isinstance(value, bool) else F.lit(float(value))
        exprs.append((F.coalesce(F.col(f"__t_{name}"), lit) if name in cols else lit).alias(name))
    return out.select(*df.columns, *exprs)


def segment_regressions(deltas: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Per candidate: number of segments whose rmse_delta_pct exceeds the
    model's limit, and labels ``col=value (+x.x%)`` of the first five in
    comparison order (not the five worst)."""
    t = thresholds.select("model_name", "max_segment_rmse_regression_pct").distinct()
    pct = F.col("rmse_delta_pct")
    offenders = deltas.join(t, "model_name").where(~F.isnan(pct) & (pct > F.col("max_segment_rmse_regression_pct")))
    counts = offenders.groupBy("model_name", "model_version").agg(F.count(F.lit(1)).alias("n_segment_regressions"))
    first = top_k_per_group(
        offenders, ["model_name", "model_version"], [F.col("ord")], MAX_LISTED_SEGMENTS
    )
    label = fill(T.SEGMENT_REASON_ITEM, column=F.col("segment_column"), value=F.col("segment_value"), pct=signed_percent(pct))
    labels = first.groupBy("model_name", "model_version").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", label.alias("label")))), lambda s: s["label"]).alias(
            "segment_regression_labels"
        )
    )
    return counts.join(labels, ["model_name", "model_version"])


def _not_nan_gt(x: Column, limit: Column) -> Column:
    # A NaN metric compares false (passes), as a Python comparison does.
    return ~F.isnan(x) & (x > limit)


def _present(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def verdict_columns() -> dict[str, Column]:
    """decision, reasons, checks_passed, checks_failed as expressions over a
    gate-input row (see ``policy_gate``)."""
    rmse = F.coalesce(F.col("rmse"), F.lit(0.0))
    mae = F.coalesce(F.col("mae"), F.lit(0.0))
    t_rmse, t_mae = F.col("max_test_rmse"), F.col("max_test_mae")
    t_reg, t_seg = F.col("max_rmse_regression_pct"), F.col("max_segment_rmse_regression_pct")

    fail_rmse = _not_nan_gt(rmse, t_rmse)
    fail_mae = _not_nan_gt(mae, t_mae)
    issues = F.filter(
        F.coalesce(F.col("evidence_errors"), F.array().cast("array<string>")),
        lambda x: x.isNotNull() & (x != ""),
    )
    has_issues = F.size(issues) > 0
    champ = F.coalesce(F.col("has_champion"), F.lit(False))
    pct = F.coalesce(F.col("rmse_delta_pct"), F.lit(0.0))
    fail_champ = champ & _not_nan_gt(pct, t_reg)
    n_seg = F.coalesce(F.col("n_segment_regressions"), F.lit(0))
    fail_seg = champ & (n_seg > 0)
    skipped = ~champ & ~has_issues
    has_drift = F.coalesce(F.col("has_drift_report"), F.lit(False))
    fail_drift = has_drift & F.coalesce(F.col("overall_drift_detected"), F.lit(False)) & F.col("drift_blocks_promotion")

    reasons = F.concat(
        _present(
            F.when(fail_rmse, fill(T.REASON_RMSE, rmse=thousands(rmse), limit=thousands(t_rmse))),
            F.when(fail_mae, fill(T.REASON_MAE, mae=thousands(mae), limit=thousands(t_mae))),
        ),
        issues,
        _present(
            F.when(fail_champ, fill(T.REASON_CHAMPION, pct=percent(pct, 1), limit=percent(t_reg, 0))),
            F.when(fail_seg, fill(T.REASON_SEGMENTS, limit=percent(t_seg, 0),
                                  segments=F.array_join(F.col("segment_regression_labels"), ", "))),
            F.when(skipped, F.lit(T.NO_CHAMPION_REASON)),
            F.when(fail_drift, fill(T.REASON_DRIFT, columns=F.array_join(F.col("drifted_columns"), ", "))),
        ),
    )
    failed = _present(
        F.when(fail_rmse, F.lit("absolute_rmse")),
        F.when(fail_mae, F.lit("absolute_mae")),
        F.when(has_issues, F.lit("promotion_evidence_unavailable")),
        F.when(fail_champ, F.lit("champion_rmse_regression")),
        F.when(fail_seg, F.lit("segment_rmse_regression")),
        F.when(fail_drift, F.lit("drift_check")),
    )
    passed = _present(
        F.when(~fail_rmse, F.lit("absolute_rmse")),
        F.when(~fail_mae, F.lit("absolute_mae")),
        F.when(champ & ~fail_champ, F.lit("champion_rmse_regression")),
        F.when(champ & ~fail_seg, F.lit("segment_rmse_regression")),
        F.when(skipped, F.lit("champion_comparison_skipped")),
        F.when(has_drift & ~fail_drift, F.lit("drift_check")),
        F.when(~has_drift, F.lit("drift_check_skipped")),
    )
    decision = (
        F.when(fail_rmse | fail_mae | has_issues | fail_champ, F.lit(DECISION_REJECT))
        .when(fail_seg | fail_drift, F.lit(DECISION_MANUAL_REVIEW))
        .otherwise(F.lit(DECISION_PROMOTE))
    )
    return {"decision": decision, "reasons": reasons, "checks_passed": passed, "checks_failed": failed}


GATE_INPUT_DEFAULTS = {
    "has_champion": "boolean",
    "rmse_delta_pct": "double",
    "evidence_errors": "array<string>",
    "has_drift_report": "boolean",
    "overall_drift_detected": "boolean",
    "drifted_columns": "array<string>",
    "n_segment_regressions": "bigint",
    "segment_regression_labels": "array<string>",
}


def policy_gate(gate_input: DataFrame, overrides: dict | None = None, per_model: DataFrame | None = None) -> DataFrame:
    """Verdict for every candidate row.

    ``gate_input`` needs ``model_name, model_version, rmse, mae``; optional
    columns (absent = null) are listed in ``GATE_INPUT_DEFAULTS``.
    Precedence REJECT > MANUAL_REVIEW > PROMOTE.
    """
    df = gate_input
    for name, dtype in GATE_INPUT_DEFAULTS.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(dtype))
    if not set(THRESHOLD_COLUMNS) <= set(df.columns):
        df = with_thresholds(df, overrides, per_model)
    v = verdict_columns()
    return df.select("*", *[e.alias(n) for n, e in v.items()])


def route_reviews(verdicts: DataFrame) -> DataFrame:
    """REJECT goes straight to execution (``auto_rejected``); every other
    verdict waits for a human (``pending_review``)."""
    return verdicts.withColumn(
        "status",
        F.when(F.col("decision") == DECISION_REJECT, F.lit(REVIEW_STATUS_AUTO_REJECTED)).otherwise(
            F.lit(REVIEW_STATUS_PENDING)
        ),
    )
