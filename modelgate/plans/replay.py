"""Replay stored evidence scenarios through the deterministic path.

Scenarios are JSON records (one per file or per line) holding candidate
metrics, the champion, the comparison (metric deltas and segment deltas in
comparison order), the drift report and expectations about the report. They
are read with an explicit schema, turned into gate rows with column
expressions, gated, rendered and checked — all as DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgate.operators import policy as P
from modelgate.operators import reports as K
from modelgate.operators.common import top_k_per_group

SCENARIO_DDL = (
    "description string, model_name string, model_version string, "
    "candidate_metrics struct<rmse:double,mae:double>, "
    "champion_info struct<version:string,run_id:string,metrics:struct<rmse:double,mae:double>>, "
    "comparison struct<has_champion:boolean,metric_deltas:map<string,double>,"
    "segment_deltas:array<struct<segment_column:string,segment_value:string,candidate_rmse:double,"
    "champion_rmse:double,rmse_delta:double,rmse_delta_pct:double>>>, "
    "drift_report struct<overall_drift_detected:boolean,column_results:array<struct<column:string,"
    "drift_type:string,statistic:double,threshold:double,p_value:double,is_drifted:boolean>>>, "
    "policy_verdict struct<decision:string,reasons:array<string>,checks_passed:array<string>,checks_failed:array<string>>, "
    "expected struct<minimum_tools_called:array<string>,report_must_contain:array<string>,"
    "report_must_not_contain:array<string>,report_sections:array<string>>"
)


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """One scenario per JSON line."""
    return spark.read.schema(SCENARIO_DDL).json(path)


def scenario_deltas(scenarios: DataFrame) -> DataFrame:
    """Segment deltas as rows, ``ord`` = stored (comparison) order."""
    d = scenarios.select("model_name", "model_version",
                         F.posexplode(F.coalesce("comparison.segment_deltas", F.array())).alias("pos", "d"))
    return d.select("model_name", "model_version", "d.*", F.struct(F.col("pos")).alias("ord"))


def gate_rows(scenarios: DataFrame) -> DataFrame:
    """Gate input per scenario (champion present only with champion info)."""
    champ = F.col("comparison.has_champion") & F.col("champion_info").isNotNull()
    deltas = F.col("comparison.metric_deltas")
    drift = F.col("drift_report")
    return scenarios.select(
        "model_name", "model_version",
        F.col("candidate_metrics.rmse").alias("rmse"), F.col("candidate_metrics.mae").alias("mae"),
        champ.alias("has_champion"),
        F.when(champ, F.col("champion_info.metrics.rmse")).alias("champion_rmse"),
        F.when(champ, F.col("champion_info.metrics.mae")).alias("champion_mae"),
        F.when(champ, F.try_element_at(deltas, F.lit("rmse_delta"))).alias("rmse_delta"),
        F.when(champ, F.try_element_at(deltas, F.lit("rmse_delta_pct"))).alias("rmse_delta_pct"),
        drift.isNotNull().alias("has_drift_report"),
        drift["overall_drift_detected"].alias("overall_drift_detected"),
        drift["column_results"].alias("column_results"),
        F.transform(F.filter(F.coalesce(drift["column_results"], F.array()), lambda r: r["is_drifted"]),
                    lambda r: r["column"]).alias("drifted_columns"),
        F.col("expected").alias("expected"),
        F.col("policy_verdict").alias("stored_verdict"),
    )


def replay(scenarios: DataFrame) -> DataFrame:
    """Verdict, rendered report and report checks for every scenario."""
    keys = ["model_name", "model_version"]
    rows = P.with_thresholds(gate_rows(scenarios))
    deltas = scenario_deltas(scenarios)
    seg = P.segment_regressions(deltas, rows)
    verdicts = P.policy_gate(rows.join(seg, keys, "left"))
    s5 = K.segment_summary(deltas, 5)
    routed = P.route_reviews(verdicts).join(s5, keys, "left")
    rendered = K.render_report(routed)
    exp = F.col("expected")
    checks = K.report_checks(F.col("report"), exp["report_must_contain"], F.array().cast("array<string>"),
                             exp["report_sections"])
    return rendered.withColumn("checks", checks)


def worst3(deltas: DataFrame) -> DataFrame:
    keys = ["model_name", "model_version"]
    top = top_k_per_group(deltas, keys, [F.col("rmse_delta_pct").desc(), F.col("ord")], 3)
    return top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "segment_column", "segment_value",
                                                                        "rmse_delta_pct"))).alias("w"))
