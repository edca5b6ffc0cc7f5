"""Registry, review and decision queries (G, H10, H11) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelgate.operators import registry as R
from modelgate.plans import registry_flow as RF
from modelgate.plans.catalog import gate_job, query, r, state_key
from modelgate import fixed as T
from modelgate.plans.oracle import cte, sql_fill, sql_sanitize, sql_str
from modelgate.plans.oracles import oracle
from modelgate.schema import FEATURE_COLUMNS
from modelgate.sources.adapters import MODEL_NAME, PREDICTION_FORMULAS

_FLOWS: dict = {}


def flow(spark, sf_dir) -> RF.RegistryFlow:
    key = state_key(spark, sf_dir)
    if key not in _FLOWS:
        _FLOWS[key] = RF.RegistryFlow(gate_job(spark, sf_dir))
    return _FLOWS[key]


def _iso(t) -> str:
    return t.strftime("%Y-%m-%dT%H:%M:%S") + "+00:00"


T_OPEN = _iso(RF.REVIEW_OPENED_AT)
T_DECIDE = _iso(RF.DECIDED_AT)

# --- oracle building blocks ----------------------------------------------------------
cte("scored_vt", ["prepared"], "\n  UNION ALL\n".join(
    f"  SELECT '{MODEL_NAME}' AS model_name, '{v}' AS model_version, split, resale_price, "
    f"prediction_{v} AS prediction FROM prepared WHERE split IN ('validation', 'test')"
    for v in PREDICTION_FORMULAS
))

cte("split_metrics", ["scored_vt"], """
  SELECT model_name, model_version,
    sqrt(avg(CASE WHEN split = 'validation' THEN (resale_price - prediction) * (resale_price - prediction) END)) AS validation_rmse,
    avg(CASE WHEN split = 'validation' THEN abs(resale_price - prediction) END) AS validation_mae,
    sqrt(avg(CASE WHEN split = 'test' THEN (resale_price - prediction) * (resale_price - prediction) END)) AS test_rmse,
    avg(CASE WHEN split = 'test' THEN abs(resale_price - prediction) END) AS test_mae
  FROM scored_vt GROUP BY model_name, model_version""")

cte("runs", ["split_metrics"], """
  SELECT model_name, CAST(row_number() OVER (PARTITION BY model_name ORDER BY model_version) AS VARCHAR) AS model_version,
         model_version AS candidate_id, validation_rmse, validation_mae, test_rmse, test_mae
  FROM split_metrics""")

# Final outcome of every gated version after the stand-in review batch.
cte("outcomes", ["verdict"], """
  SELECT model_name, model_version, decision, reasons_list,
    CASE WHEN decision = 'PROMOTE' THEN 'promoted' ELSE 'rejected' END AS outcome,
    CASE WHEN decision = 'REJECT' THEN 'human_confirmed_reject' ELSE 'human_review' END AS source
  FROM verdict""")


def _decision_tags(src: str, ts: str, source_expr: str, reviewer: bool) -> str:
    """Tag rows (model_name, model_version, key, value) of decisions in ``src``."""
    rows = [
        "'promotion_status', CASE WHEN outcome = 'promoted' THEN 'champion' ELSE 'rejected' END",
        f"'decision_source', {source_expr}",
        f"'decision_timestamp', '{ts}'",
        "'policy_verdict', decision",
        "'rejection_overridden', 'false'",
    ]
    parts = [f"SELECT model_name, model_version, {x.split(', ', 1)[0]} AS key, {x.split(', ', 1)[1]} AS value FROM {src}"
             for x in rows]
    parts.append(
        "SELECT model_name, model_version, 'rejection_reasons', CASE WHEN len(reasons_list) > 0 "
        f"THEN array_to_string(reasons_list, '; ') ELSE {sql_str(T.DEFAULT_REJECT_REASON)} END FROM {src} WHERE outcome = 'rejected'"
    )
    parts.append(
        f"SELECT model_name, model_version, 'policy_reasons', array_to_string(reasons_list, '; ') FROM {src} "
        "WHERE len(reasons_list) > 0"
    )
    if reviewer:
        parts.append(f"SELECT model_name, model_version, 'decision_reviewer', '{RF.REVIEWER}' FROM {src}")
    return "\n  UNION ALL ".join(parts)


cte("final_tags", ["outcomes"], f"""
  SELECT DISTINCT model_name, '{RF.BOOTSTRAP_CHAMPION}' AS model_version, 'promotion_status' AS key, 'champion' AS value FROM outcomes
  UNION ALL {_decision_tags('outcomes', T_DECIDE, 'source', True)}""")


@query("register_candidates")
def q_register(spark, sf_dir):
    runs = flow(spark, sf_dir).runs
    return runs.select("model_name", "model_version", "run_id", F.explode("metrics").alias("metric", "value")).select(
        "model_name", "model_version", "run_id", "metric", r("value", 4))


oracle("register_candidates", ["runs"], """
SELECT model_name, model_version, 'run-' || model_name || '-' || model_version AS run_id, metric, round(value, 4) AS value
FROM runs UNPIVOT (value FOR metric IN (validation_rmse, validation_mae, test_rmse, test_mae))""")


@query("current_champion")
def q_current_champion(spark, sf_dir):
    f = flow(spark, sf_dir)
    c = R.current_champion(f.alias_events, f.runs)
    return c.select("model_name", "champion_version", "champion_run_id", r("champion_rmse", 4), r("champion_mae", 4),
                    "lookup_error")


oracle("current_champion", ["outcomes", "runs"], f"""
SELECT c.model_name, c.champion_version, 'run-' || c.model_name || '-' || c.champion_version AS champion_run_id,
       round(r.test_rmse, 4) AS champion_rmse, round(r.test_mae, 4) AS champion_mae, CAST(NULL AS VARCHAR) AS lookup_error
FROM (SELECT model_name, coalesce(CAST(max(CASE WHEN outcome = 'promoted' THEN CAST(model_version AS INTEGER) END) AS VARCHAR),
                                  '{RF.BOOTSTRAP_CHAMPION}') AS champion_version
      FROM outcomes GROUP BY model_name) c
JOIN runs r ON r.model_name = c.model_name AND r.model_version = c.champion_version""")


@query("fold_tags")
def q_fold_tags(spark, sf_dir):
    return R.fold_tags(flow(spark, sf_dir).tag_events)


oracle("fold_tags", ["final_tags"], "SELECT model_name, model_version, key, value FROM final_tags")


@query("training_history")
def q_training_history(spark, sf_dir):
    f = flow(spark, sf_dir)
    h = R.training_history(f.runs, f.tag_events, 10)
    return h.select("model_name", "version", "run_id", r("test_rmse", 4), r("test_mae", 4), "promotion_status",
                    "policy_verdict", "decision_source", "rejection_reasons", "rank")


oracle("training_history", ["runs", "final_tags"], """
SELECT r.model_name, r.model_version AS version, 'run-' || r.model_name || '-' || r.model_version AS run_id,
  round(r.test_rmse, 4) AS test_rmse, round(r.test_mae, 4) AS test_mae,
  max(CASE WHEN t.key = 'promotion_status' THEN t.value END) AS promotion_status,
  max(CASE WHEN t.key = 'policy_verdict' THEN t.value END) AS policy_verdict,
  max(CASE WHEN t.key = 'decision_source' THEN t.value END) AS decision_source,
  max(CASE WHEN t.key = 'rejection_reasons' THEN t.value END) AS rejection_reasons,
  row_number() OVER (PARTITION BY r.model_name ORDER BY CAST(r.model_version AS BIGINT) DESC) AS rank
FROM runs r LEFT JOIN final_tags t ON t.model_name = r.model_name AND t.model_version = r.model_version
GROUP BY r.model_name, r.model_version, r.test_rmse, r.test_mae
QUALIFY rank <= 10""")


def _events_view(df):
    return df.select(F.col("model_name"), "model_version", "key", "value", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("apply_decisions")
def q_apply_decisions(spark, sf_dir):
    ev = flow(spark, sf_dir).decision_events
    alias = ev["alias_events"].select("model_name", "model_version", F.concat(F.lit("alias:"), "alias").alias("key"),
                                      F.col("model_version").alias("value"), "ts")
    return _events_view(ev["tag_events"]).unionByName(_events_view(alias))


_T1 = RF.REVIEW_OPENED_AT.strftime("%Y-%m-%d %H:%M:%S")
_T2 = RF.DECIDED_AT.strftime("%Y-%m-%d %H:%M:%S")
cte("auto_outcomes", ["outcomes"], """
  SELECT model_name, model_version, decision, reasons_list, 'rejected' AS outcome FROM outcomes WHERE decision = 'REJECT'""")
cte("decision_events", ["outcomes", "auto_outcomes"], f"""
  SELECT *, '{_T1}' AS ts FROM ({_decision_tags('auto_outcomes', T_OPEN, "'policy_auto_reject'", False)})
  UNION ALL
  SELECT *, '{_T2}' AS ts FROM ({_decision_tags('outcomes', T_DECIDE, 'source', True)})
  UNION ALL
  SELECT model_name, model_version, 'rejection_reasons', NULL, '{_T2}' FROM outcomes WHERE outcome = 'promoted'
  UNION ALL
  SELECT model_name, model_version, 'alias:champion', model_version, '{_T2}' FROM outcomes WHERE outcome = 'promoted'""")

oracle("apply_decisions", ["decision_events"], "SELECT * FROM decision_events")


@query("decision_audit")
def q_decision_audit(spark, sf_dir):
    return _events_view(R.decision_audit(flow(spark, sf_dir).decisions))


oracle("decision_audit", ["decision_events"], """
SELECT * FROM decision_events WHERE key IN ('decision_source', 'decision_timestamp', 'policy_verdict',
  'rejection_overridden', 'policy_reasons', 'decision_reviewer')""")


@query("open_reviews")
def q_open_reviews(spark, sf_dir):
    rv = flow(spark, sf_dir).reviews
    return rv.select("review_id", "model_name", "model_version", "decision", "status", "outcome", "human_decision",
                     "action_required", F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss").alias("completed_at"))


_RID = (f"'{RF.REVIEW_OPENED_AT.strftime('%Y%m%dT%H%M%SZ')}-' || {sql_sanitize('model_name', True)} || '-v' || "
        f"{sql_sanitize('model_version', True)} || '-{RF.THREAD_ID}'")
cte("reviews", ["verdict"], f"""
  SELECT {_RID} AS review_id, model_name, model_version, decision,
    CASE WHEN decision = 'REJECT' THEN 'auto_rejected' ELSE 'pending_review' END AS status,
    CASE WHEN decision = 'REJECT' THEN 'rejected' ELSE 'pending_review' END AS outcome,
    CASE WHEN decision = 'REJECT' THEN 'auto_reject' ELSE '' END AS human_decision,
    CASE WHEN decision = 'REJECT' THEN {sql_str(T.AUTO_REJECT_ACTION)} ELSE {sql_str(T.PENDING_ACTION)} END AS action_required,
    CASE WHEN decision = 'REJECT' THEN '{_T1}' END AS completed_at
  FROM verdict""")
oracle("open_reviews", ["reviews"], "SELECT * FROM reviews")


@query("route_reviews")
def q_route_reviews(spark, sf_dir):
    return gate_job(spark, sf_dir).routed.select("model_name", "model_version", "decision", "status")


oracle("route_reviews", ["reviews"], "SELECT model_name, model_version, decision, status FROM reviews")


@query("resume_reviews")
def q_resume_reviews(spark, sf_dir):
    res = flow(spark, sf_dir).resumed
    done = res["registry"].select(
        "review_id", F.date_format("decided_at", "yyyy-MM-dd HH:mm:ss").alias("decided_at"), "human_decision", "outcome",
        "decision_source", F.col("rejection_overridden").cast("string").alias("rejection_overridden"),
        F.lit(None).cast("string").alias("error"))
    errors = res["errors"].select(
        "review_id", F.date_format("decided_at", "yyyy-MM-dd HH:mm:ss").alias("decided_at"),
        F.lower(F.trim("decision_text")).alias("human_decision"), F.lit(None).cast("string").alias("outcome"),
        F.lit(None).cast("string").alias("decision_source"), F.lit(None).cast("string").alias("rejection_overridden"),
        "error")
    return done.unionByName(errors)


_T1 = RF.EARLY_DECISION_AT.strftime("%Y-%m-%d %H:%M:%S")
_T3 = RF.LATE_DECISION_AT.strftime("%Y-%m-%d %H:%M:%S")
oracle("resume_reviews", ["reviews"], f"""
SELECT review_id, '{_T2}' AS decided_at,
  CASE WHEN status = 'pending_review' AND decision = 'PROMOTE' THEN 'approve' ELSE 'reject' END AS human_decision,
  CASE WHEN status = 'pending_review' AND decision = 'PROMOTE' THEN 'promoted' ELSE 'rejected' END AS outcome,
  CASE WHEN status = 'pending_review' THEN 'human_review' ELSE 'human_confirmed_reject' END AS decision_source,
  'false' AS rejection_overridden, CAST(NULL AS VARCHAR) AS error
FROM reviews
UNION ALL
SELECT review_id, '{_T3}', 'approve', NULL, NULL, NULL, {sql_fill(T.REVIEW_COMPLETED, review_id='review_id')}
FROM reviews
UNION ALL
SELECT review_id, '{_T1}', 'maybe', NULL, NULL, NULL, {sql_str(T.BAD_DECISION_ERROR)} FROM reviews
UNION ALL
SELECT 'unknown-' || review_id, '{_T3}', 'approve', NULL, NULL, NULL,
  {sql_fill(T.REVIEW_NOT_FOUND, review_id="('unknown-' || review_id)")} FROM reviews""")


@query("input_example")
def q_input_example(spark, sf_dir):
    test = gate_job(spark, sf_dir).rows_of("test")
    return R.input_example(test, 5)


oracle("input_example", ["prepared"], f"""
SELECT {', '.join(FEATURE_COLUMNS)} FROM prepared WHERE split = 'test'
ORDER BY sale_month, {', '.join(FEATURE_COLUMNS)} LIMIT 5""")
