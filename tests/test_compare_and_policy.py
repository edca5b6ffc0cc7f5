import pytest
from pyspark.sql import functions as F

from modelgate.operators.compare import evidence_errors, pair_with_champion, segment_deltas
from modelgate.operators.policy import policy_gate, route_reviews, segment_regressions, with_thresholds

CAND = "model_name string, model_version string, rmse double, mae double"
CHAMP = "model_name string, champion_version string, champion_rmse double, champion_mae double"


def test_metric_deltas_regression_and_improvement(spark):
    c = spark.createDataFrame([("m", "2", 160000.0, 130000.0), ("n", "2", 140000.0, 110000.0)], CAND)
    h = spark.createDataFrame([("m", "1", 150000.0, 120000.0), ("n", "1", 150000.0, 120000.0)], CHAMP)
    got = {r["model_name"]: r for r in pair_with_champion(c, h).collect()}
    assert got["m"]["rmse_delta"] == 10000.0 and got["m"]["mae_delta"] == 10000.0
    assert got["m"]["rmse_delta_pct"] == pytest.approx(10000 / 150000)
    assert got["n"]["rmse_delta"] < 0 and got["n"]["mae_delta"] < 0


def test_no_champion(spark):
    c = spark.createDataFrame([("m", "1", 150000.0, 120000.0)], CAND)
    h = spark.createDataFrame([], CHAMP)
    r = pair_with_champion(c, h).first()
    assert r["has_champion"] is False and r["rmse_delta"] is None


def test_segment_deltas_inner_join_and_order(spark):
    seg = "model_name string, model_version string, segment_column string, segment string, rmse double"
    cand = spark.createDataFrame([("m", "2", "town", "AMK", 140000.0), ("m", "2", "town", "BEDOK", 160000.0),
                                  ("m", "2", "town", "ONLY_CAND", 1.0), ("m", "2", "town", "ZERO", 5.0)], seg)
    champ = spark.createDataFrame([("m", "1", "town", "AMK", 130000.0), ("m", "1", "town", "BEDOK", 150000.0),
                                   ("m", "1", "town", "ZERO", 0.0)], seg)
    pairs = spark.createDataFrame([("m", "2", "1")], "model_name string, model_version string, champion_version string")
    d = {r["segment_value"]: r for r in segment_deltas(cand, champ, pairs).collect()}
    assert set(d) == {"AMK", "BEDOK"}
    assert d["AMK"]["rmse_delta"] == 10000.0
    assert d["AMK"]["rmse_delta_pct"] == pytest.approx(10000 / 130000)


def test_evidence_error_when_champion_but_no_candidate_segments(spark):
    c = spark.createDataFrame([("m", "2", 1.0, 1.0)], CAND)
    h = spark.createDataFrame([("m", "1", 1.0, 1.0)], CHAMP)
    pairs = pair_with_champion(c, h)
    segs = spark.createDataFrame([], "model_name string, model_version string")
    r = evidence_errors(pairs, segs).first()
    assert r["evidence_errors"] == [
        "Promotion blocked because candidate segment metrics are unavailable for champion comparison."
    ]


SEGS = "model_name string, model_version string, segment_column string, segment string, rmse double"


def test_champion_without_segment_rows_is_an_evidence_error(spark):
    c = spark.createDataFrame([("m", "2", 1.0, 1.0)], CAND)
    h = spark.createDataFrame([("m", "1", 1.0, 1.0)], CHAMP)
    pairs = pair_with_champion(c, h)
    segs = spark.createDataFrame([("m", "2", "town", "A", 1.0), ("m", "1", "town", "A", 1.0)], SEGS)
    [error] = evidence_errors(pairs, segs, champion_segments=segs).first()["evidence_errors"]
    assert error.endswith("Champion run '1' is missing required segment metric artifacts for: flat_type.")


def test_nan_champion_segment_is_skipped_and_last_duplicate_wins(spark):
    c = spark.createDataFrame([("m", "2", 1.0, 1.0)], CAND)
    h = spark.createDataFrame([("m", "1", float("nan"), 2.0)], CHAMP)
    pairs = pair_with_champion(c, h)
    assert pairs.first()["rmse_delta_pct"] == 0.0
    segs = spark.createDataFrame(
        [("m", "2", "town", "A", 3.0, 1), ("m", "2", "town", "B", 3.0, 2), ("m", "1", "town", "A", 1.0, 1),
         ("m", "1", "town", "A", 2.0, 2), ("m", "1", "town", "B", float("nan"), 3)], SEGS + ", ord int")
    rows = segment_deltas(segs, segs, pairs).collect()
    assert [(r["segment_value"], r["rmse_delta_pct"]) for r in rows] == [("A", 0.5)]


GATE = ("model_name string, model_version string, rmse double, mae double, has_champion boolean, "
        "rmse_delta_pct double, evidence_errors array<string>, has_drift_report boolean, "
        "overall_drift_detected boolean, drifted_columns array<string>")


def gate(spark, rows, deltas=None):
    df = with_thresholds(spark.createDataFrame(rows, GATE))
    if deltas is not None:
        d = spark.createDataFrame(deltas, "model_name string, model_version string, segment_column string, "
                                          "segment_value string, rmse_delta_pct double, pos int")
        d = d.withColumn("ord", F.struct("pos"))
        df = df.join(segment_regressions(d, df), ["model_name", "model_version"], "left")
    return {r["model_version"]: r for r in policy_gate(df).collect()}


def test_gate_table(spark):
    rows = [
        ("m", "1", 150000.0, 120000.0, False, None, None, False, None, None),
        ("m", "2", 250000.0, 120000.0, False, None, None, False, None, None),
        ("m", "3", 150000.0, 180000.0, False, None, None, False, None, None),
        ("m", "4", 170000.0, 120000.0, True, 20000 / 150000, None, False, None, None),
        ("m", "5", 153000.0, 120000.0, True, 0.02, None, False, None, None),
        ("m", "6", 155000.0, 120000.0, True, 0.033, None, False, None, None),
        ("m", "7", 150000.0, 120000.0, False, None, None, True, True, ["town"]),
        ("m", "8", 150000.0, 120000.0, False, None, None, True, False, []),
        ("m", "9", 250000.0, 120000.0, True, 0.6667, None, True, True, ["town"]),
        ("m", "10", 150000.0, 120000.0, False, None, ["Champion lookup failed"], False, None, None),
    ]
    deltas = [("m", "6", "town", "PUNGGOL", 0.286, 0), ("m", "9", "town", "PUNGGOL", 0.429, 0)]
    v = gate(spark, rows, deltas)
    expect = {
        "1": ("PROMOTE", []), "2": ("REJECT", ["absolute_rmse"]), "3": ("REJECT", ["absolute_mae"]),
        "4": ("REJECT", ["champion_rmse_regression"]), "5": ("PROMOTE", []),
        "6": ("MANUAL_REVIEW", ["segment_rmse_regression"]), "7": ("MANUAL_REVIEW", ["drift_check"]),
        "8": ("PROMOTE", []), "9": ("REJECT", ["absolute_rmse", "champion_rmse_regression", "segment_rmse_regression", "drift_check"]),
        "10": ("REJECT", ["promotion_evidence_unavailable"]),
    }
    for k, (decision, failed) in expect.items():
        assert (v[k]["decision"], v[k]["checks_failed"]) == (decision, failed), k
    assert v["1"]["checks_passed"] == ["absolute_rmse", "absolute_mae", "champion_comparison_skipped", "drift_check_skipped"]
    assert v["1"]["reasons"] == ["No existing champion — only absolute thresholds applied"]
    assert v["2"]["reasons"][0] == "Test RMSE 250,000 exceeds maximum threshold 200,000"
    assert v["4"]["reasons"] == ["Candidate RMSE is 13.3% worse than champion (threshold: 10%)"]
    assert v["6"]["reasons"] == ["Segment RMSE regressions exceed 20%: town=PUNGGOL (+28.6%)"]
    assert v["7"]["reasons"][-1] == "Data drift detected in: town"
    assert "champion_comparison_skipped" not in v["10"]["checks_passed"]
    assert v["10"]["reasons"] == ["Champion lookup failed"]
    routed = {r["model_version"]: r["status"] for r in route_reviews(policy_gate(with_thresholds(
        spark.createDataFrame(rows, GATE)))).collect()}
    assert routed["2"] == "auto_rejected" and routed["1"] == "pending_review"


def test_nan_metric_passes_threshold_like_python(spark):
    v = gate(spark, [("m", "1", float("nan"), 1.0, False, None, None, False, None, None)])
    assert "absolute_rmse" in v["1"]["checks_passed"]


def test_segment_reason_lists_first_five_in_comparison_order(spark):
    deltas = [("m", "1", "town", f"T{i}", 0.21 + i / 100, 10 - i) for i in range(7)]
    v = gate(spark, [("m", "1", 1.0, 1.0, True, 0.0, None, False, None, None)], deltas)
    reason = v["1"]["reasons"][0]
    assert reason.startswith("Segment RMSE regressions exceed 20%: town=T6 (+27.0%), town=T5")
    assert reason.count("town=") == 5


def test_gate_monotone_in_rmse(spark):
    rows = [("m", str(i), float(x), 1.0, False, None, None, False, None, None)
            for i, x in enumerate([100000, 199999, 200000, 200001, 300000])]
    v = gate(spark, rows)
    decisions = [v[str(i)]["decision"] for i in range(5)]
    assert decisions == ["PROMOTE", "PROMOTE", "PROMOTE", "REJECT", "REJECT"]


def test_threshold_precedence_table_then_override_then_default(spark):
    df = spark.createDataFrame([("a", "1", 250000.0, 1.0), ("b", "1", 250000.0, 1.0)], CAND)
    table = spark.createDataFrame([("a", 300000.0)], "model_name string, max_test_rmse double")
    out = {r["model_name"]: r for r in with_thresholds(df, {"max_test_mae": 5.0}, table).collect()}
    assert out["a"]["max_test_rmse"] == 300000.0 and out["b"]["max_test_rmse"] == 200000.0
    assert out["a"]["max_test_mae"] == 5.0 and out["b"]["drift_blocks_promotion"] is True
    v = {r["model_name"]: r["decision"] for r in policy_gate(with_thresholds(df, None, table)).collect()}
    assert v == {"a": "PROMOTE", "b": "REJECT"}
