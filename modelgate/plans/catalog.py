"""Registered queries: one per operator of the inventory.

Each query takes ``(spark, sf_dir)``, reads the given tables (or what Spark
derives from them) and returns a DataFrame whose columns match the oracle
SQL of the same name in ``oracle.py``/``oracle_sql()``. Doubles are rounded
in both so that summation order cannot change a hash.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgate.plans.gate import GateJob, champion_alias
from modelgate.session import folder_state, size_shuffle_partitions
from modelgate.sources import adapters as A
from modelgate.sources.tables import Tables

_JOBS: dict[tuple, GateJob] = {}


def state_key(spark: SparkSession, sf_dir: str) -> tuple:
    """What a shared step depends on: the application, the folder and the
    state of its files."""
    return spark.sparkContext.applicationId, sf_dir, folder_state(spark, sf_dir)


def gate_job(spark: SparkSession, sf_dir: str) -> GateJob:
    key = state_key(spark, sf_dir)
    if key not in _JOBS:
        t = Tables(spark, sf_dir)
        _JOBS[key] = GateJob(
            raw=A.raw_sales_with_predictions(t),
            predictions=A.prediction_columns(),
            model_name=A.MODEL_NAME,
            alias_events=champion_alias(spark, A.MODEL_NAME, "1"),
        )
    return _JOBS[key]


def r(c: str, digits: int = 6):
    return F.round(F.col(c), digits).alias(c)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


_SIZED: set[tuple] = set()


def query(name: str):
    """Register a query. Before its first run on a data directory the
    session's shuffle partitions are sized to that directory's bytes."""

    def deco(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            key = state_key(spark, sf_dir)
            if key not in _SIZED:
                size_shuffle_partitions(spark, [sf_dir])
                _SIZED.add(key)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        return run

    return deco


# --- C: split ------------------------------------------------------------------
@query("chrono_split")
def q_chrono_split(spark, sf_dir):
    """Split label of every raw row, counted per (split, month)."""
    j = gate_job(spark, sf_dir)
    return j.split.groupBy("split", "month").agg(F.count(F.lit(1)).alias("rows"))


@query("split_summary")
def q_split_summary(spark, sf_dir):
    from modelgate.operators.splits import split_summary

    return split_summary(gate_job(spark, sf_dir).split)


# --- B: features ------------------------------------------------------------------
@query("prepare_features")
def q_prepare_features(spark, sf_dir):
    p = gate_job(spark, sf_dir).prepared_once
    return p.select(
        "sale_month", r("resale_price", 4), "town", "flat_type", "flat_model", "storey_range",
        r("floor_area_sqm", 4), r("flat_age_years"), r("remaining_lease_years"), r("storey_midpoint", 4), "split",
    )


# --- D: evaluation ----------------------------------------------------------------
@query("evaluate_grouping_sets")
def q_evaluate(spark, sf_dir):
    e = gate_job(spark, sf_dir).evaluation
    return e.select("model_name", "model_version", "segment_column", "segment", "count",
                    r("rmse", 4), r("mae", 4), r("mean_actual", 4), r("mean_prediction", 4))


@query("overall_metrics")
def q_overall(spark, sf_dir):
    from modelgate.operators.evaluate import overall_metrics

    o = overall_metrics(gate_job(spark, sf_dir).scored_once)
    return o.select("model_name", "model_version", "count", r("rmse", 4), r("mae", 4))


@query("segment_metrics")
def q_segment_metrics(spark, sf_dir):
    from modelgate.operators.evaluate import segment_metrics

    s = segment_metrics(gate_job(spark, sf_dir).scored_once, "town")
    return s.select("model_name", "model_version", "segment", "ord", "count", r("rmse", 4), r("mae", 4),
                    r("mean_actual", 4), r("mean_prediction", 4))


# --- F: comparison ----------------------------------------------------------------
@query("metric_deltas")
def q_metric_deltas(spark, sf_dir):
    p = gate_job(spark, sf_dir).pairs
    return p.select("model_name", "model_version", "champion_version", "has_champion",
                    r("rmse_delta", 4), r("rmse_delta_pct"), r("mae_delta", 4), r("mae_delta_pct"))


@query("segment_deltas")
def q_segment_deltas(spark, sf_dir):
    d = gate_job(spark, sf_dir).segment_deltas
    return d.select("model_name", "model_version", "champion_version", "segment_column", "segment_value",
                    r("candidate_rmse", 4), r("champion_rmse", 4), r("rmse_delta", 4), r("rmse_delta_pct"))


# --- E: drift -----------------------------------------------------------------------
def _drift(spark, sf_dir, kind: str | None = None):
    d = gate_job(spark, sf_dir).drift_rows
    if kind:
        d = d.where(F.col("drift_type") == kind)
    return d.select("model_name", "column", "drift_type", r("statistic", 9), "threshold", r("p_value"),
                    "is_drifted")


@query("categorical_drift")
def q_categorical_drift(spark, sf_dir):
    return _drift(spark, sf_dir, "psi")


@query("numeric_drift")
def q_numeric_drift(spark, sf_dir):
    return _drift(spark, sf_dir, "ks")


@query("drift_report")
def q_drift_report(spark, sf_dir):
    return _drift(spark, sf_dir)


# --- H: gate ----------------------------------------------------------------------
def gate_view(v: DataFrame) -> DataFrame:
    return v.select(
        "model_name", "model_version", "decision",
        F.array_join("reasons", " | ").alias("reasons"),
        F.array_join("checks_passed", ", ").alias("checks_passed"),
        F.array_join("checks_failed", ", ").alias("checks_failed"),
        r("rmse", 4), r("mae", 4), r("rmse_delta_pct"),
    )


@query("policy_gate")
def q_policy_gate(spark, sf_dir):
    return gate_view(gate_job(spark, sf_dir).verdicts)


def _load_all() -> None:
    """Import every query module so its queries and oracles register."""
    import importlib

    for mod in ("q_features", "q_registry", "q_text", "q_io"):
        try:
            importlib.import_module(f"modelgate.plans.{mod}")
        except ModuleNotFoundError as exc:
            if exc.name != f"modelgate.plans.{mod}":
                raise
