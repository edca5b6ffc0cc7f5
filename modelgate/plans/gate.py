"""End-to-end promotion gate for a fleet of model versions.

raw rows -> chronological split -> features -> scored rows per version ->
one grouping-sets evaluation -> champion from the registry -> overall and
segment comparison -> drift (train vs test) -> policy verdict per candidate.

The source joins and feature parsing run once: typed rows are written to
the shared checkpoint folder, and every observation-level step reads that
table — the month list for the split bounds, scoring (test months only, as a
pushed month-range filter), drift (train and test months) and per-split
metrics. Everything after those aggregates is model-level (versions x
segments) and small, and is written once before later steps reuse it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgate.operators import compare as C
from modelgate.operators import drift as D
from modelgate.operators import evaluate as E
from modelgate.operators import policy as P
from modelgate.operators import registry as R
from modelgate.operators.common import long_predictions
from modelgate.functions.parse import parse_month
from modelgate.operators.features import VALID, prepare_features, typed_features
from modelgate.operators.splits import split_bounds, split_label, split_predicate
from modelgate.schema import (
    CATEGORICAL_FEATURES,
    DATE_COLUMN,
    DEFAULT_SEGMENT_COLUMNS,
    NUMERIC_FEATURES,
    TARGET_COLUMN,
)


#: A task of the typed table sorts all its rows, which are wide: so many times as many
#: partitions as other steps have.
TYPED_PARTITIONS = 4


@dataclass
class GateJob:
    """Inputs of a fleet gate.

    ``raw``: raw rows (strings) with one prediction column per version;
    ``predictions``: version -> column; ``alias_events``/``runs``: registry
    state naming the current champion; ``runs`` may be None when the
    champion's metrics come from this evaluation (all versions scored on
    the same test months).
    """

    raw: DataFrame
    predictions: dict[str, str]
    model_name: str
    alias_events: DataFrame
    runs: DataFrame | None = None
    segment_columns: tuple[str, ...] = DEFAULT_SEGMENT_COLUMNS
    thresholds: dict | None = None
    with_drift: bool = True
    materialize: bool = True

    def _cut(self, df: DataFrame, name: str = "model_level") -> DataFrame:
        """Model-level results (versions x segments, columns) are tiny and
        feed many later steps: write them once to the shared checkpoint
        folder so no later plan re-inlines the source joins."""
        if not self.materialize:
            return df
        from modelgate.session import cut_lineage

        return cut_lineage(df, name=name)

    @property
    def spark(self) -> SparkSession:
        return self.raw.sparkSession

    @cached_property
    def typed(self) -> DataFrame:
        """Every raw row typed once (features, predictions, validity flag).

        This is the only pass over the source joins: it is written to the
        shared checkpoint folder, sorted by month within each file so that
        parquet row-group statistics prune month ranges, and everything
        below (split bounds, scoring, drift, split metrics) reads it.
        """
        typed = typed_features(self.raw, passthrough=list(self.predictions.values())).withColumn(
            "model_name", F.lit(self.model_name)
        )
        if not self.materialize:
            return typed
        from modelgate.session import finer_shuffles
        from modelgate.sources.io import scratch_path

        path = scratch_path(self.spark, "typed")
        with finer_shuffles(self.spark, TYPED_PARTITIONS):
            typed.sortWithinPartitions(DATE_COLUMN).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    @cached_property
    def bounds(self) -> tuple:
        """(test start, validation start) over the months of all raw rows
        (rows later dropped by the feature filter still count): from the
        typed table where the gate has written it, else from a scan that is
        pruned to the month."""
        if "typed" in self.__dict__:
            return split_bounds(self.typed, F.col(DATE_COLUMN))
        return split_bounds(self.raw.select("month"), parse_month(F.col("month")))

    @cached_property
    def split(self) -> DataFrame:
        """Raw rows with their split label (for raw-level consumers)."""
        return self.raw.withColumn("split", split_label(parse_month(F.col("month")), self.bounds))

    @cached_property
    def prepared(self) -> DataFrame:
        """Prepared rows of every split, with the ``split`` label."""
        valid = self.typed.where(F.col(VALID)).drop(VALID)
        return valid.withColumn("split", split_label(F.col(DATE_COLUMN), self.bounds))

    @property
    def prepared_once(self) -> DataFrame:
        """``prepared`` for a single reader: features straight from the source
        joins, unless the gate has written the typed table already."""
        if "typed" in self.__dict__ or not self.materialize:
            return self.prepared
        valid = prepare_features(self.raw, passthrough=list(self.predictions.values()))
        return valid.withColumn("split", split_label(F.col(DATE_COLUMN), self.bounds))

    def rows_once(self, *splits: str) -> DataFrame:
        """``rows_of`` for a single reader: straight from the source joins with the
        month range on the raw month, so that it reaches the source of the month
        and other months' rows are neither joined nor parsed; from the typed
        table where the gate has written it already."""
        if "typed" in self.__dict__ or not self.materialize:
            return self.rows_of(*splits)
        wanted = split_predicate(parse_month(F.col("month")), self.bounds, splits)
        valid = prepare_features(self.raw.where(wanted), passthrough=list(self.predictions.values()))
        return valid.withColumn("split", split_label(F.col(DATE_COLUMN), self.bounds))

    def rows_of(self, *splits: str) -> DataFrame:
        """Prepared rows of the given splits, selected by a month range that
        reaches the scan as a pushed filter."""
        return self.prepared.where(split_predicate(F.col(DATE_COLUMN), self.bounds, splits))

    @cached_property
    def scored(self) -> DataFrame:
        test = self.rows_of("test")
        return long_predictions(test, self.predictions, self.model_name, [TARGET_COLUMN, *self.segment_columns])

    @property
    def scored_once(self) -> DataFrame:
        """``scored`` for a single reader (see ``rows_once``)."""
        test = self.rows_once("test")
        return long_predictions(test, self.predictions, self.model_name, [TARGET_COLUMN, *self.segment_columns])

    @cached_property
    def evaluation(self) -> DataFrame:
        return self._cut(E.evaluate_grouping_sets(self.scored, self.segment_columns))

    @cached_property
    def overall(self) -> DataFrame:
        return E.split_evaluation(self.evaluation)[0]

    @cached_property
    def segments(self) -> DataFrame:
        return E.split_evaluation(self.evaluation)[1]

    @cached_property
    def registry_runs(self) -> DataFrame:
        if self.runs is not None:
            return self.runs
        metrics = F.create_map(F.lit("test_rmse"), F.col("rmse"), F.lit("test_mae"), F.col("mae"))
        return self.overall.select(
            "model_name", "model_version",
            F.concat_ws("-", F.lit("run"), "model_name", "model_version").alias("run_id"),
            F.lit(None).cast("timestamp").alias("registered_at"),
            F.create_map().cast("map<string,string>").alias("params"),
            metrics.alias("metrics"),
        )

    @cached_property
    def champion(self) -> DataFrame:
        return R.current_champion(self.alias_events, self.registry_runs)

    @cached_property
    def candidates(self) -> DataFrame:
        """Every evaluated version except the model's current champion."""
        champ = self.champion.select("model_name", F.col("champion_version").alias("model_version"))
        return self.overall.join(champ, ["model_name", "model_version"], "left_anti").select(
            "model_name", "model_version", "rmse", "mae"
        )

    @cached_property
    def pairs(self) -> DataFrame:
        ok = self.champion.where(F.col("lookup_error").isNull()).drop("lookup_error", "champion_run_id")
        return C.pair_with_champion(self.candidates, ok)

    @cached_property
    def segment_deltas(self) -> DataFrame:
        return self._cut(C.segment_deltas(self.segments, self.segments, self.pairs, self.segment_columns))

    @cached_property
    def drift_rows(self) -> DataFrame:
        keys = ["model_name"]
        ref = self.rows_of("train")
        cur = self.rows_of("test")
        return self._cut(D.drift_report(ref, cur, CATEGORICAL_FEATURES, NUMERIC_FEATURES, keys=keys,
                                        materialize=self.materialize))

    @cached_property
    def drift(self) -> DataFrame:
        return D.drift_summary(self.drift_rows, ["model_name"]).withColumn("has_drift_report", F.lit(True))

    @cached_property
    def gate_input(self) -> DataFrame:
        errors = self.champion.where(F.col("lookup_error").isNotNull()).select(
            "model_name", F.col("lookup_error").alias("detail")
        )
        with_errors = C.evidence_errors(self.pairs, self.segments, errors, self.segments, self.segment_columns)
        thresholds = P.with_thresholds(with_errors, self.thresholds)
        seg = P.segment_regressions(self.segment_deltas, thresholds)
        out = thresholds.join(seg, ["model_name", "model_version"], "left")
        if self.with_drift:
            out = out.join(self.drift, "model_name", "left")
        return out

    @cached_property
    def verdicts(self) -> DataFrame:
        return self._cut(P.policy_gate(self.gate_input))


    # --- reports, routing, registry inputs -------------------------------------
    @cached_property
    def routed(self) -> DataFrame:
        return P.route_reviews(self.verdicts)

    @cached_property
    def worst3(self) -> DataFrame:
        """Three largest relative segment deltas per candidate (any sign)."""
        from modelgate.operators.common import top_k_per_group

        keys = ["model_name", "model_version"]
        top = top_k_per_group(self.segment_deltas, keys, [F.col("rmse_delta_pct").desc(), F.col("ord")], 3)
        seg = F.struct("rank", "segment_column", "segment_value", "rmse_delta_pct")
        return top.groupBy(*keys).agg(F.array_sort(F.collect_list(seg)).alias("__w")).select(
            *keys,
            F.transform("__w", lambda s: F.struct(s["segment_column"].alias("segment_column"),
                                                  s["segment_value"].alias("segment_value"),
                                                  s["rmse_delta_pct"].alias("rmse_delta_pct"))).alias("segments_worst3"),
        )

    @cached_property
    def report_input(self) -> DataFrame:
        from modelgate.operators.reports import segment_summary

        keys = ["model_name", "model_version"]
        s5 = segment_summary(self.segment_deltas, 5)
        s3 = segment_summary(self.segment_deltas, 3).select(
            *keys, F.col("segment_prefix").alias("segment_prefix_top3"), F.col("segments").alias("segments_top3")
        )
        return self._cut(self.routed.join(s5, keys, "left").join(s3, keys, "left").join(self.worst3, keys, "left"))

    @cached_property
    def reports(self) -> DataFrame:
        from modelgate.operators.reports import render_report

        return render_report(self.report_input)

    @cached_property
    def split_metrics(self) -> DataFrame:
        """Validation and test rmse/mae of every version in one aggregate."""
        rows = self.rows_of("validation", "test")
        scored = long_predictions(rows, self.predictions, self.model_name, [TARGET_COLUMN, "split"])
        err = F.col(TARGET_COLUMN) - F.col("prediction")
        aggs = []
        for s in ("validation", "test"):
            on = F.col("split") == s
            aggs += [
                F.sqrt(F.avg(F.when(on, err * err))).alias(f"{s}_rmse"),
                F.avg(F.when(on, F.abs(err))).alias(f"{s}_mae"),
            ]
        return self._cut(scored.groupBy("model_name", "model_version").agg(*aggs))


def champion_alias(spark: SparkSession, model_name: str, version: str) -> DataFrame:
    """Registry state with one alias event naming ``version`` champion."""
    return spark.createDataFrame(
        [(model_name, "champion", version, None, 0)], R.ALIAS_EVENTS_DDL
    )
