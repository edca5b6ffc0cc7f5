import json
import os

import pytest
from pyspark.sql import functions as F

from modelgate.operators import reports as K
from modelgate.plans.replay import read_scenarios, replay
from tests.conftest import FIXTURES


@pytest.fixture(scope="module")
def replayed(spark):
    sc = read_scenarios(spark, os.path.join(FIXTURES, "scenarios.jsonl"))
    return {r["description"]: r for r in replay(sc).join(sc.select("model_version", "description"), "model_version").collect()}


def test_golden_decisions_reasons_and_failed_checks(replayed):
    for name, r in replayed.items():
        stored = r["stored_verdict"]
        assert r["decision"] == stored["decision"], name
        assert r["reasons"] == stored["reasons"], name
        assert r["checks_failed"] == stored["checks_failed"], name


def test_golden_checks_passed_from_gate_code(replayed):
    assert replayed["reject_high_rmse"]["checks_passed"] == ["absolute_mae", "segment_rmse_regression", "drift_check_skipped"]
    assert replayed["promote_with_champion"]["checks_passed"] == replayed["promote_with_champion"]["stored_verdict"]["checks_passed"]


def test_golden_reports_contain_expected_text(replayed):
    for name, r in replayed.items():
        assert r["checks"]["passed"], (name, r["checks"])


def test_template_report_layout(replayed):
    seg = replayed["manual_review_segment_regression"]["report"]
    assert seg.startswith("# Model Promotion Report — Version 6\n\n## Summary\nPolicy verdict: **MANUAL_REVIEW**.")
    assert "## Worst Segment Regressions\n- town=YISHUN: +30.0%\n- town=ANG MO KIO: +3.6%" in seg
    assert "- Worst segment regressions: town=YISHUN (+30.0%); town=ANG MO KIO (+3.6%)" in seg
    assert seg.endswith("*(This is a template-based report. Set OPENAI_API_KEY for AI-generated analysis.)*")
    drift = replayed["manual_review_drift"]["report"]
    assert "Drift detected in 2 feature(s):\n- town: PSI=0.3500\n- floor_area_sqm: KS=0.1200 (p=0.0010)" in drift
    first = replayed["promote_no_champion"]["report"]
    assert "## Champion Comparison\nFirst model candidate — no incumbent baseline is available." in first
    assert "- Drift status: no drift report provided." in first
    improve = replayed["promote_with_champion"]["report"]
    assert "## Best Segment Improvements\n- town=ANG MO KIO: -6.7%\n- flat_type=4 ROOM: -5.3%\n- town=BEDOK: -4.5%" in improve
    assert "Worst Segment Regressions" not in improve


def test_improvement_labelling_single_segment(spark):
    d = spark.createDataFrame([("m", "1", "town", "A", -0.08)],
                              "model_name string, model_version string, segment_column string, segment_value string, rmse_delta_pct double")
    d = d.withColumn("ord", F.struct(F.lit(0).alias("p")))
    r = K.segment_summary(d, 5).first()
    assert r["segment_heading"] == "Best Segment Improvements"


REPORT = """Intro line
## Summary
The candidate is fine.
## Evidence
- RMSE 150,000
- MAE 120,000
Risk Flags:
- none
## Market Context
Prices stable.
## Recommendation
Approve
after review.
Sources
- http://a
"""


def test_parse_report_sections(spark):
    df = spark.createDataFrame([(REPORT,), ("just text\nmore",), ("",)], "t string")
    out = [r["p"] for r in K.parse_reports(df, "t", "p").collect()]
    p = out[0]
    assert p["summary"] == "The candidate is fine."
    assert p["evidence"] == ["RMSE 150,000", "MAE 120,000"]
    assert p["risk_flags"] == ["none"]
    assert p["market_context"] == "Prices stable."
    assert p["recommendation"] == "Approve after review."
    assert p["citations"] == ["http://a"]
    assert out[1]["summary"] == "just text more"
    assert out[2]["summary"] == ""


def test_coerce_prefers_json_payload(spark):
    payload = {"summary": " S ", "evidence": ["a", " ", "b"], "risk_flags": "one", "recommendation": "R"}
    texts = [("```json\n" + json.dumps(payload) + "\n```",), (json.dumps({"summary": "", "evidence": []}) + "",)]
    out = [r["s"] for r in K.coerce_reports(spark.createDataFrame(texts, "t string"), "t", "s").collect()]
    assert out[0]["summary"] == "S" and out[0]["evidence"] == ["a", "b"] and out[0]["risk_flags"] == ["one"]
    assert out[1]["summary"] == '{"summary": "", "evidence": []}'


def test_enrich_appends_unique_lines_and_baseline_wording(spark):
    rows = [("m", "1", 150000.0, 120000.0, False, ["absolute_rmse"], [], ["No existing champion — only absolute thresholds applied"],
             "PROMOTE")]
    df = spark.createDataFrame(rows, "model_name string, model_version string, rmse double, mae double, has_champion boolean, "
                                     "checks_passed array<string>, checks_failed array<string>, reasons array<string>, decision string")
    df = df.withColumn("report", F.lit("## Summary\nChampion check done.\n## Evidence\n- candidate test rmse: 150,000"))
    out = K.enrich_reports(K.coerce_reports(df, "report", "s"), "s", "e").first()["e"]
    assert out["summary"] == "Baseline check done."
    assert out["evidence"][0] == "candidate test rmse: 150,000"
    assert "Candidate test RMSE: 150,000" not in out["evidence"]
    assert "Candidate test MAE: 120,000" in out["evidence"]
    assert "Baseline comparison: first candidate; no incumbent baseline available." in out["evidence"]
    assert out["risk_flags"] == ["No existing baseline — only absolute thresholds applied"]
    md = df.sparkSession.createDataFrame([(1,)], "x int").select(K.render_markdown(F.struct(
        F.lit("").alias("summary"), F.array().cast("array<string>").alias("evidence"),
        F.array().cast("array<string>").alias("risk_flags"), F.lit("").alias("market_context"),
        F.lit("").alias("recommendation"), F.array().cast("array<string>").alias("citations")))).first()[0]
    assert md.startswith("## Summary\nNo summary provided.\n\n## Evidence\n- No evidence items captured.")


@pytest.mark.parametrize(
    "text,expected,error",
    [
        ('{"completeness": 4, "accuracy": 5, "actionability": "3", "safety": 5.0}', (4, 5, 3, 5), None),
        ("completeness=4 accuracy=5 actionability=3 safety=5", (4, 5, 3, 5), None),
        ("completeness: 4\naccuracy: 5\nactionability: 3\nsafety: 2\nsafety: 5", (4, 5, 3, 5), None),
        ("completeness: 4, accuracy: 5, actionability: 3", None, "Judge feedback missing required key 'safety'"),
        ('{"completeness": true, "accuracy": 5, "actionability": 3, "safety": 5}', None,
         "Judge score for 'completeness' must be an integer, got bool"),
        ("nothing here", None, "Judge feedback value must be a dict or JSON object string, got str"),
    ],
)
def test_judge_scores(spark, text, expected, error):
    r = spark.createDataFrame([(text,)], "t string").select(K.judge_scores(F.col("t")).alias("s")).first()["s"]
    if expected:
        assert (r["completeness"], r["accuracy"], r["actionability"], r["safety"]) == expected
        assert r["average"] == pytest.approx(sum(expected) / 4)
        assert r["error"] is None
    else:
        assert r["error"] == error


def test_final_message_and_trace(spark):
    msgs = spark.createDataFrame(
        [
            (1, 0, "human", "brief", None, None, None),
            (1, 1, "ai", "", [("c1", "query_candidate_metrics")], None, None),
            (1, 2, "tool", '["{\\"rmse\\": 1}"]', None, "c1", None),
            (1, 3, "ai", "  Final report  ", None, None, None),
        ],
        "conv_id int, pos int, type string, content string, tool_calls array<struct<id:string,name:string>>, "
        "tool_call_id string, name string",
    )
    final = K.final_message(msgs, F.lit("brief")).first()
    assert final["final_text"] == "Final report"
    ev = K.trace_events(msgs).orderBy("message_index").collect()
    assert [(e["event"], e["tool_name"]) for e in ev] == [("tool_call", "query_candidate_metrics"),
                                                          ("tool_result", "query_candidate_metrics")]
    st = K.trace_stats(K.trace_events(msgs)).first()
    assert (st["tool_call_count"], st["tool_result_count"], st["unique_tools_used"]) == (1, 1, ["query_candidate_metrics"])


def test_message_text_parts(spark):
    df = spark.createDataFrame([('["a", {"type": "text", "text": "b"}, {"type": "image"}]',), ("  plain ",)], "c string")
    assert [r[0] for r in df.select(K.message_text(F.col("c"))).collect()] == ["ab", "plain"]


@pytest.mark.parametrize(
    "text,error",
    [
        ('["completeness: 4", "accuracy: 4", "actionability: 4", "safety: 4"]',
         "Judge feedback value must be a dict or JSON object string, got list"),
        ("5", "Judge feedback value must be a dict or JSON object string, got int"),
        ("true", "Judge feedback value must be a dict or JSON object string, got bool"),
        ('{"completeness": 4.5, "accuracy": 5, "actionability": 3, "safety": 5}',
         "Judge score for 'completeness' must be an integer, got float"),
        ('{"completeness": null, "accuracy": 5, "actionability": 3, "safety": 5}',
         "Judge score for 'completeness' must be an integer, got NoneType"),
        ('{"completeness": "four", "accuracy": 5, "actionability": 3, "safety": 5}',
         "Judge score for 'completeness' must be an integer, got str"),
    ],
)
def test_judge_non_object_json_is_an_error(spark, text, error):
    r = spark.createDataFrame([(text,)], "t string").select(K.judge_scores(F.col("t")).alias("s")).first()["s"]
    assert r["error"] == error


def test_parse_report_crlf_and_heading_variants(spark):
    text = "Preface\r\n### EVIDENCE\r\n- a\r\n  - b  \r\nRisk flags :\r\n- r\r\n## Summary:\r\nnot a heading line\r\nRecommendation\r\nGo"
    p = K.parse_reports(spark.createDataFrame([(text,)], "t string"), "t", "p").first()["p"]
    assert p["evidence"] == ["a", "b"]
    # '## Summary:' is neither '#'-heading nor ':'-heading once both marks are kept, so it stays content
    assert p["risk_flags"] == ["r", "## Summary:", "not a heading line"]
    assert p["recommendation"] == "Go"
    assert p["summary"] == "Preface"


def test_json_with_anything_after_it_is_no_json(spark):
    texts = ['{"a": 1} tail', '{"a": 1}{"b": 2}', '{"a": 1}, {"b": 2}', '{"a": 1}]', ' {"a": 1} ', '```json\n{"a": 1}\n```']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["m"] for r in df.select("i", K.extract_json(F.col("t")).alias("m")).collect()}
    assert [got[i] for i in range(4)] == [None] * 4
    assert got[4] == {"a": "1"} and got[5] == {"a": "1"}


def test_judge_answer_with_text_after_json_scans_names(spark):
    text = '{"completeness": 1, "accuracy": 2, "actionability": 3, "safety": 4} and safety: 5'
    row = spark.createDataFrame([(text,)], "t string").select(K.judge_scores(F.col("t")).alias("s")).first()["s"]
    assert row["average"] is None and row["error"]


def test_headings_beside_other_line_ends_and_spaces(spark):
    text = "Summary\x0cfirst\x0b## Evidence\u00a0\n- one\x1c Recommendation: \u2003\ndo it"
    row = K.parse_reports(spark.createDataFrame([(text,)], "t string"), "t").first()["parsed"]
    assert row["summary"] == "first"
    assert row["evidence"] == ["one"]
    assert row["recommendation"] == "do it"
