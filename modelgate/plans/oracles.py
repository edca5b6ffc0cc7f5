"""Oracle SQL per registered query (DuckDB dialect)."""

from __future__ import annotations

from modelgate.plans.oracle import GATE_SELECT, with_ctes

ORACLES: dict[str, str] = {}


def oracle(name: str, needed: list[str], select: str) -> None:
    ORACLES[name] = with_ctes(needed, select)


oracle("chrono_split", ["split"], "SELECT split, month, count(*) AS rows FROM split GROUP BY split, month")

oracle("split_summary", ["split"], """
SELECT split, count(*) AS rows, strftime(min(strptime(month, '%Y-%m')), '%Y-%m') AS first_month,
       strftime(max(strptime(month, '%Y-%m')), '%Y-%m') AS last_month
FROM split GROUP BY split""")

oracle("prepare_features", ["prepared"], """
SELECT sale_month, round(resale_price, 4) AS resale_price, town, flat_type, flat_model, storey_range,
       round(floor_area_sqm, 4) AS floor_area_sqm, round(flat_age_years, 6) AS flat_age_years,
       round(remaining_lease_years, 6) AS remaining_lease_years, round(storey_midpoint, 4) AS storey_midpoint, split
FROM prepared""")

oracle("evaluate_grouping_sets", ["evaluation"], """
SELECT model_name, model_version, segment_column, segment, count, round(rmse, 4) AS rmse, round(mae, 4) AS mae,
       round(mean_actual, 4) AS mean_actual, round(mean_prediction, 4) AS mean_prediction
FROM evaluation""")

oracle("overall_metrics", ["overall"], """
SELECT model_name, model_version, count, round(rmse, 4) AS rmse, round(mae, 4) AS mae FROM overall""")

oracle("segment_metrics", ["evaluation"], """
SELECT model_name, model_version, segment,
       row_number() OVER (PARTITION BY model_name, model_version ORDER BY rmse, segment) AS ord,
       count, round(rmse, 4) AS rmse, round(mae, 4) AS mae,
       round(mean_actual, 4) AS mean_actual, round(mean_prediction, 4) AS mean_prediction
FROM evaluation WHERE segment_column = 'town'""")

oracle("metric_deltas", ["pairs"], """
SELECT model_name, model_version, champion_version, has_champion, round(rmse_delta, 4) AS rmse_delta,
       round(rmse_delta_pct, 6) AS rmse_delta_pct, round(mae_delta, 4) AS mae_delta,
       round(mae_delta_pct, 6) AS mae_delta_pct
FROM pairs""")

oracle("segment_deltas", ["deltas"], """
SELECT model_name, model_version, champion_version, segment_column, segment_value,
       round(candidate_rmse, 4) AS candidate_rmse, round(champion_rmse, 4) AS champion_rmse,
       round(rmse_delta, 4) AS rmse_delta, round(rmse_delta_pct, 6) AS rmse_delta_pct
FROM deltas""")

_DRIFT = """
SELECT model_name, "column", drift_type, round(statistic, 9) AS statistic, threshold,
       round(p_value, 6) AS p_value, is_drifted
FROM drift_rows"""
oracle("categorical_drift", ["drift_rows"], _DRIFT + " WHERE drift_type = 'psi'")
oracle("numeric_drift", ["drift_rows"], _DRIFT + " WHERE drift_type = 'ks'")
oracle("drift_report", ["drift_rows"], _DRIFT)

oracle("policy_gate", ["verdict"], GATE_SELECT)
