"""Source/sink queries (A1-A11) and training/scoring queries (L1-L6).

Writes go to a fresh folder under the shared checkpoint folder; every query
reads back what it wrote, so the round trip itself is what is checked.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from modelgate.plans.catalog import gate_job, query, r, state_key
from modelgate.plans.oracles import oracle
from modelgate.schema import RAW_COLUMNS
from modelgate.sources import io as IO
from modelgate.sources.tables import Tables


@query("scan_raw")
def q_scan_raw(spark, sf_dir):
    """Raw rows written as delimited files, read back with the raw reader
    (every file of the folder, all strings, missing-value tokens -> null)."""
    raw = gate_job(spark, sf_dir).raw.select(*RAW_COLUMNS)
    path = IO.scratch_path(spark, "raw_csv")
    IO.write_raw_csv(raw, path)
    return IO.read_raw(spark, path)


_NA = "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', " \
      "'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"
oracle("scan_raw", ["raw"], "SELECT " + ", ".join(
    f"CASE WHEN {c} IN {_NA} THEN NULL ELSE {c} END AS {c}" for c in RAW_COLUMNS) + " FROM raw")


@query("read_folder")
def q_read_folder(spark, sf_dir):
    """Raw rows in folders within folders, a folder a year; every file is read."""
    raw = gate_job(spark, sf_dir).raw.select(*RAW_COLUMNS)
    path = IO.scratch_path(spark, "raw_folders")
    raw.withColumn("year", F.substring("month", 1, 4)).write.partitionBy("year").option("header", "true").csv(path)
    back = IO.read_raw(spark, path)
    return back.groupBy("month").agg(F.count(F.lit(1)).alias("rows"), F.count("floor_area_sqm").alias("areas"))


oracle("read_folder", ["raw"], f"""
SELECT month, count(*) AS rows, count(*) FILTER (WHERE floor_area_sqm NOT IN {_NA}) AS areas FROM raw GROUP BY month""")


@query("snapshot_manifest")
def q_snapshot_manifest(spark, sf_dir):
    raw = gate_job(spark, sf_dir).raw.select(*RAW_COLUMNS)
    base = IO.scratch_path(spark, "snapshots")
    row = IO.materialize_snapshot(spark, raw, base, "sales", "tables:lineitem,orders,part,customer,nation")
    return row.select("name", "record_count", "source")


oracle("snapshot_manifest", ["raw"], """
SELECT 'sales' AS name, count(*) AS record_count, 'tables:lineitem,orders,part,customer,nation' AS source FROM raw""")


@query("split_roundtrip")
def q_split_roundtrip(spark, sf_dir):
    j = gate_job(spark, sf_dir)
    path = IO.scratch_path(spark, "splits")
    paths = IO.persist_splits(j.split.select(*RAW_COLUMNS, "split"), None, path)
    back = IO.read_split(spark, paths["rows"])
    counts = back.groupBy("split").agg(F.count(F.lit(1)).alias("rows_read"))
    summary = spark.read.schema("split string, rows bigint, first_month string, last_month string").json(paths["summary"])
    return summary.join(counts, "split")


oracle("split_roundtrip", ["split"], """
SELECT split, count(*) AS rows, strftime(min(strptime(month, '%Y-%m')), '%Y-%m') AS first_month,
       strftime(max(strptime(month, '%Y-%m')), '%Y-%m') AS last_month, count(*) AS rows_read
FROM split GROUP BY split""")


@query("rows_to_json")
def q_rows_to_json(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    return IO.rows_to_json(ev, keep=["event_id"])


oracle("rows_to_json", [], """
SELECT event_id, CAST(to_json({'event_id': event_id, 'ts': strftime(ts, '%Y-%m-%dT%H:%M:%S')
  || CASE WHEN microsecond(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END, 'user_id': user_id,
  'event_type': event_type, 'value': CASE WHEN isnan(value) OR isinf(value) THEN NULL ELSE value END, 'props': props}) AS VARCHAR) AS record
FROM events""")


@query("json_to_rows")
def q_json_to_rows(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    return IO.json_to_rows(ev, "props", "k bigint", keep=["event_id"])


oracle("json_to_rows", [], "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")


def _handoff_paths(spark, sf_dir):
    j = gate_job(spark, sf_dir)
    champion = j.champion.select("model_name", "champion_run_id")
    run = F.concat_ws("-", F.lit("run"), "model_name", "model_version").alias("run_id")
    routed = j.routed.join(champion, "model_name", "left").select("*", run)
    return IO.write_handoff(routed, j.segment_deltas, IO.scratch_path(spark, "handoff"), j.segments,
                            created_at=F.lit("2024-01-01 00:00:00").cast("timestamp"), execution_id="gate")


def _handoff(spark, sf_dir):
    return IO.read_handoff(spark, _handoff_paths(spark, sf_dir)["packets"])


def _drift_text(rows):
    """A packet's drift rows in one text: column, kind, statistic, flag."""
    return F.array_join(F.transform(rows, lambda d: F.concat_ws(
        ":", d["column"], d["drift_type"], F.format_string("%.6f", d["statistic"]), d["is_drifted"].cast("string"))), " ")


_DRIFT_TEXT = """(SELECT string_agg("column" || ':' || drift_type || ':' || printf('%.6f', statistic) || ':' || CAST(is_drifted AS VARCHAR), ' ' ORDER BY ord)
   FROM drift_rows r WHERE r.model_name = v.model_name)"""
_STATUS = "CASE WHEN v.decision = 'REJECT' THEN 'auto_rejected' ELSE 'pending_review' END"
_RUN = "'run-' || v.model_name || '-' || v."
_REASONS, _PASSED, _FAILED = (f"array_to_string(v.{c}_list, ' | ')" for c in ("reasons", "passed", "failed"))


@query("handoff_packet")
def q_handoff_packet(spark, sf_dir):
    h = _handoff(spark, sf_dir)
    return h.select(
        "model_name", "model_version", "status", "source", "execution_id",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.col("registration.run_id").alias("run_id"),
        F.col("champion_info.run_id").alias("champion_run_id"), F.col("champion_info.model_version").alias("champion_version"),
        F.col("policy_verdict.decision").alias("decision"),
        F.array_join("policy_verdict.reasons", " | ").alias("reasons"),
        F.array_join("policy_verdict.checks_passed", " | ").alias("checks_passed"),
        F.array_join("policy_verdict.checks_failed", " | ").alias("checks_failed"),
        F.round("candidate_metrics.rmse", 4).alias("rmse"), F.col("comparison.has_champion").alias("has_champion"),
        F.round(F.col("comparison.metric_deltas")["rmse_delta_pct"], 6).alias("rmse_delta_pct"),
        F.col("drift_report.overall_drift_detected").alias("drift_detected"),
        _drift_text(F.col("drift_report.column_results")).alias("drift_rows"),
    )


oracle("handoff_packet", ["verdict", "drift_flag"], f"""
SELECT v.model_name, v.model_version, {_STATUS} AS status, 'policy_gate' AS source, 'gate' AS execution_id,
  '2024-01-01 00:00:00' AS created_at, {_RUN}model_version AS run_id, {_RUN}champion_version AS champion_run_id, v.champion_version,
  v.decision, {_REASONS} AS reasons, {_PASSED} AS checks_passed, {_FAILED} AS checks_failed,
  round(v.rmse, 4) AS rmse, v.has_champion, round(v.rmse_delta_pct, 6) AS rmse_delta_pct, d.any_drift AS drift_detected,
  {_DRIFT_TEXT} AS drift_rows
FROM verdict v LEFT JOIN drift_flag d ON d.model_name = v.model_name""")


@query("handoff_segments")
def q_handoff_segments(spark, sf_dir):
    """The candidates' segment metrics that travel with the packets."""
    paths = _handoff_paths(spark, sf_dir)
    s = spark.read.schema(IO.SEGMENT_TABLE_DDL).json(paths["segment_metrics"])
    return s.select("model_name", "model_version", "segment_column", "segment", "count", r("rmse", 4), r("mae", 4))


oracle("handoff_segments", ["verdict", "evaluation"], """
SELECT e.model_name, e.model_version, e.segment_column, e.segment, e.count, round(e.rmse, 4) AS rmse, round(e.mae, 4) AS mae
FROM evaluation e JOIN verdict v USING (model_name, model_version) WHERE e.segment_column IS NOT NULL""")


@query("handoff_read")
def q_handoff_read(spark, sf_dir):
    """Typed rows of the written packets and, in the same folder, of one that
    lacks the newer fields, one without a verdict and one broken line for
    each of them."""
    path = _handoff_paths(spark, sf_dir)["packets"]
    packets = spark.read.text(path)
    without = lambda *names: F.to_json(F.map_filter(F.from_json("value", "map<string,string>"), lambda k, _: ~k.isin(*names)))
    old = packets.select(F.regexp_replace("value", r'"(created_at|source|execution_id)":"[^"]*",', "").alias("value"))
    no_verdict = packets.select(without("policy_verdict", "comparison", "candidate_metrics", "drift_report", "registration", "champion_info").alias("value"))
    broken = packets.select(F.expr("substr(value, 1, 40)").alias("value"))
    for extra in (old, no_verdict, broken):
        extra.write.mode("append").text(path)
    h = IO.read_handoff_checked(spark, path)
    return h.groupBy("model_name", "model_version", "evidence_error", "source", F.col("policy_verdict.decision").alias("decision")).agg(
        F.count(F.lit(1)).alias("packets"))


oracle("handoff_read", ["verdict"], """
SELECT model_name, model_version, CAST(NULL AS VARCHAR) AS evidence_error, source, decision, 1 AS packets
FROM verdict, (VALUES ('policy_gate'), (NULL)) AS s(source)
UNION ALL SELECT model_name, model_version, 'The hand-off packet holds no policy verdict.', 'policy_gate', NULL, 1 FROM verdict
UNION ALL SELECT NULL, NULL, 'The hand-off packet is no readable JSON.', NULL, NULL, count(*) FROM verdict""")


@query("flatten_struct")
def q_flatten_struct(spark, sf_dir):
    """Dotted columns of the packets; lists and maps as texts."""
    from pyspark.sql import types as T

    flat = IO.flatten_struct(_handoff(spark, sf_dir).drop("created_at"))
    kinds = {f.name: f.dataType for f in flat.schema.fields}

    def shown(c):
        col, kind = F.col(f"`{c}`"), kinds[c]
        if isinstance(kind, T.MapType):
            pairs = F.array_sort(F.map_entries(col))
            return F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"], F.format_string("%.4f", e["value"]))), " ").alias(c)
        if c == "drift_report.column_results":
            return _drift_text(col).alias(c)
        if isinstance(kind, T.ArrayType):
            return F.array_join(col, " | ").alias(c)
        return (F.round(col, 4) if isinstance(kind, T.DoubleType) else col).alias(c)

    return flat.select(*[shown(c) for c in flat.columns])


oracle("flatten_struct", ["verdict", "drift_flag"], f"""
SELECT v.model_name, v.model_version, {_STATUS} AS status, 'policy_gate' AS source, 'gate' AS execution_id,
  v.model_name AS "registration.model_name", v.model_version AS "registration.model_version", {_RUN}model_version AS "registration.run_id",
  v.has_champion AS "champion_info.has_champion", v.champion_version AS "champion_info.model_version",
  {_RUN}champion_version AS "champion_info.run_id", round(v.champion_rmse, 4) AS "champion_info.metrics.rmse",
  round(v.champion_mae, 4) AS "champion_info.metrics.mae",
  round(v.rmse, 4) AS "candidate_metrics.rmse", round(v.mae, 4) AS "candidate_metrics.mae",
  v.has_champion AS "comparison.has_champion", v.champion_version AS "comparison.champion_version",
  round(v.champion_rmse, 4) AS "comparison.champion_metrics.rmse", round(v.champion_mae, 4) AS "comparison.champion_metrics.mae",
  CASE WHEN v.has_champion THEN printf('mae_delta=%.4f mae_delta_pct=%.4f rmse_delta=%.4f rmse_delta_pct=%.4f', v.mae_delta, v.mae_delta_pct,
    v.rmse_delta, v.rmse_delta_pct) ELSE '' END AS "comparison.metric_deltas",
  d.any_drift AS "drift_report.overall_drift_detected", {_DRIFT_TEXT} AS "drift_report.column_results",
  v.decision AS "policy_verdict.decision", {_REASONS} AS "policy_verdict.reasons", {_PASSED} AS "policy_verdict.checks_passed",
  {_FAILED} AS "policy_verdict.checks_failed"
FROM verdict v LEFT JOIN drift_flag d ON d.model_name = v.model_name""")


@query("evaluation_tables")
def q_evaluation_tables(spark, sf_dir):
    """Evaluation tables written by size and read back: the required segment
    tables, and beside each segment the version's overall error."""
    j = gate_job(spark, sf_dir)
    paths = IO.persist_evaluation(j.scored, j.overall, j.segments, IO.scratch_path(spark, "evaluation"))
    segments = IO.load_segments(spark, paths["segments"], j.segment_columns, required=True)
    overall = spark.read.parquet(paths["overall"]).select("model_name", "model_version", F.col("rmse").alias("overall_rmse"))
    rows = spark.read.parquet(paths["scored"]).groupBy("model_name", "model_version").agg(F.count(F.lit(1)).alias("scored_rows"))
    both = segments.join(overall, ["model_name", "model_version"]).join(rows, ["model_name", "model_version"])
    return both.select("model_name", "model_version", "segment_column", "segment", "count", r("rmse", 4), r("mae", 4),
                       r("overall_rmse", 4), "scored_rows")


oracle("evaluation_tables", ["evaluation", "scored"], """
SELECT s.model_name, s.model_version, s.segment_column, s.segment, s.count, round(s.rmse, 4) AS rmse, round(s.mae, 4) AS mae,
  round(o.rmse, 4) AS overall_rmse, n.scored_rows
FROM evaluation s JOIN evaluation o ON o.model_name = s.model_name AND o.model_version = s.model_version AND o.segment_column IS NULL
JOIN (SELECT model_name, model_version, count(*) AS scored_rows FROM scored GROUP BY ALL) n
  ON n.model_name = s.model_name AND n.model_version = s.model_version
WHERE s.segment_column IS NOT NULL""")


# --- L: training and scoring ----------------------------------------------------------
# A forest's numbers are beyond SQL: pytest holds a small one against a plain
# Python booster.
_MODELS: dict = {}


def trained_model(spark, sf_dir):
    """Forest fitted on the train split with the default settings; one fit
    serves both queries of a session, as it does in a release."""
    from modelgate.operators.train import fit

    key = state_key(spark, sf_dir)
    if key not in _MODELS:
        _MODELS[key] = fit(gate_job(spark, sf_dir).rows_of("train"), random_seed=7)
    return _MODELS[key]


@query("train_gbt")
def q_train_gbt(spark, sf_dir):
    """Fit on train, evaluate validation and test overall and per segment in
    one grouping-sets pass (keys: split); ``spread`` is the error of the
    mean, which a model should beat."""
    from modelgate.operators.evaluate import evaluate_grouping_sets
    from modelgate.operators.train import score

    model = trained_model(spark, sf_dir)
    prepared = gate_job(spark, sf_dir).rows_of("validation", "test")
    scored = score(model, prepared, keep=["split", "resale_price", "town", "flat_type"])
    ev = evaluate_grouping_sets(scored, ("town", "flat_type"), keys=["split"])
    spread = prepared.groupBy("split").agg(F.stddev_pop("resale_price").alias("spread"))
    beats = F.when(F.col("segment_column").isNull(), F.col("rmse") < F.col("spread"))
    return ev.join(spread, "split").select(
        "split", "segment_column", "segment", "count", r("rmse", 4), r("mae", 4), r("mean_actual", 4),
        r("mean_prediction", 4), r("spread", 4), beats.alias("beats_mean"),
    )


@query("score")
def q_score(spark, sf_dir):
    """Batch scoring of every prepared row by the trained forest, saved and
    loaded again: rows, errors and spread of the predictions in each split."""
    from modelgate.operators.train import load, save, score

    path = IO.scratch_path(spark, "model")
    save(trained_model(spark, sf_dir), path)
    model = load(path)
    s = score(model, gate_job(spark, sf_dir).prepared, keep=["split", "resale_price"])
    err = F.col("resale_price") - F.col("prediction")
    return s.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count("prediction").alias("scored"),
        F.round(F.min("prediction"), 4).alias("min_prediction"), F.round(F.avg("prediction"), 4).alias("mean_prediction"),
        F.round(F.max("prediction"), 4).alias("max_prediction"),
        F.round(F.sqrt(F.avg(err * err)), 4).alias("rmse"), F.round(F.avg(F.abs(err)), 4).alias("mae"),
    )
