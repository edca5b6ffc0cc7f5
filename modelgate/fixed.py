"""Fixed values.

Values that must equal the behaviour being rebuilt for results to agree
(the one exception is marked where it appears):
feature lists, gate and drift defaults, booster defaults, check names and
their wording, and every sentence of reasons, reports, evidence lines, judge
messages and review records. Text is written as templates in natural order;
``{name}`` marks where a value goes (see ``functions.text.fill``).
"""

# --- features ---------------------------------------------------------------
CATEGORICAL_FEATURES = ["town", "flat_type", "flat_model", "storey_range"]
NUMERIC_FEATURES = ["floor_area_sqm", "flat_age_years", "remaining_lease_years", "storey_midpoint"]
TARGET_COLUMN = "resale_price"
DATE_COLUMN = "sale_month"
RAW_COLUMNS = [
    "month", "town", "flat_type", "flat_model", "storey_range", "floor_area_sqm",
    "lease_commence_date", "remaining_lease", "resale_price",
]
DEFAULT_SEGMENT_COLUMNS = ("town", "flat_type")
DEFAULT_VALIDATION_MONTHS = 12
DEFAULT_TEST_MONTHS = 12
DEFAULT_LEASE_YEARS = 99.0
# Values a delimited-file reader treats as missing.
CSV_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- gate and drift defaults ---------------------------------------------------
DEFAULT_THRESHOLDS = {
    "max_test_rmse": 200_000.0,
    "max_test_mae": 170_000.0,
    "max_rmse_regression_pct": 0.10,
    "max_segment_rmse_regression_pct": 0.20,
    "drift_blocks_promotion": True,
}
DEFAULT_PSI_THRESHOLD = 0.2
DEFAULT_KS_ALPHA = 0.05
PSI_EPSILON = 1e-4
DEFAULT_HISTORY_DEPTH = 10

# --- booster defaults ------------------------------------------------------------
DEFAULT_HYPERPARAMETERS = {
    "n_estimators": 400,
    "max_depth": 6,
    "learning_rate": 0.05,
    "subsample": 0.8,
    "colsample_bytree": 0.8,
    "reg_lambda": 1.0,
    "min_child_weight": 1.0,
    "objective": "reg:squarederror",
    "random_state": 7,
}

# --- decisions, checks, statuses ---------------------------------------------------
DECISION_PROMOTE = "PROMOTE"
DECISION_REJECT = "REJECT"
DECISION_MANUAL_REVIEW = "MANUAL_REVIEW"
CHECK_LABELS = {
    "absolute_rmse": "absolute RMSE threshold",
    "absolute_mae": "absolute MAE threshold",
    "champion_rmse_regression": "champion RMSE comparison",
    "champion_comparison_skipped": "incumbent baseline comparison skipped for first candidate",
    "segment_rmse_regression": "segment RMSE regression threshold",
    "drift_check": "drift check",
    "drift_check_skipped": "drift check skipped",
    "promotion_evidence_unavailable": "promotion evidence availability",
}
REVIEW_STATUS_PENDING = "pending_review"
REVIEW_STATUS_AUTO_REJECTED = "auto_rejected"
REVIEW_STATUS_COMPLETED = "completed"

# --- gate reasons ----------------------------------------------------------------------
REASON_RMSE = "Test RMSE {rmse} exceeds maximum threshold {limit}"
REASON_MAE = "Test MAE {mae} exceeds maximum threshold {limit}"
REASON_CHAMPION = "Candidate RMSE is {pct} worse than champion (threshold: {limit})"
REASON_SEGMENTS = "Segment RMSE regressions exceed {limit}: {segments}"
SEGMENT_REASON_ITEM = "{column}={value} ({pct})"
NO_CHAMPION_REASON = "No existing champion — only absolute thresholds applied"
REASON_DRIFT = "Data drift detected in: {columns}"
MISSING_SEGMENTS_ERROR = "Promotion blocked because candidate segment metrics are unavailable for champion comparison."
CHAMPION_LOOKUP_ERROR = "Promotion blocked because champion evidence could not be loaded from MLflow: {detail}"
CHAMPION_RUN_ERROR = "MLflow could not load the backing run for champion model '{model}' version {version}."
CHAMPION_SEGMENTS_ERROR = "Champion run '{run}' is missing required segment metric artifacts for: {columns}."

# --- template report ------------------------------------------------------------------------
H_SUMMARY = "## Summary"
H_CANDIDATE = "## Candidate Metrics"
H_CHAMPION = "## Champion Comparison"
H_SEGMENTS = "## {heading}"
H_DRIFT = "## Drift Detection"
H_EVIDENCE = "## Evidence"
H_RISKS = "## Risk Flags"
H_REASONS = "## Policy Reasons"
H_RECOMMENDATION = "## Recommendation"
H_MARKET = "## Market Context"
H_SOURCES = "## Sources"
REPORT_TITLE = "# Model Promotion Report — Version {version}"
REPORT_SUMMARY = (
    "Policy verdict: **{decision}**. This report is an assessment for the human reviewer; "
    "the final promotion decision remains human-controlled."
)
REPORT_CANDIDATE_RMSE = "- Test RMSE: {rmse}"
REPORT_CANDIDATE_MAE = "- Test MAE: {mae}"
REPORT_CHAMPION_RMSE = "- Champion RMSE: {rmse}"
REPORT_CHAMPION_MAE = "- Champion MAE: {mae}"
REPORT_RMSE_DELTA = "- RMSE delta: {delta} ({pct})"
REPORT_SEGMENT_LINE = "- {column}={value}: {pct}"
FIRST_CANDIDATE_LINE = "First model candidate — no incumbent baseline is available."
REPORT_DRIFT_COUNT = "Drift detected in {count} feature(s):"
REPORT_DRIFT_LINE = "- {column}: {kind}={statistic}"
REPORT_DRIFT_P = " (p={p})"
REPORT_NO_DRIFT = "No significant drift detected."
WORST_HEADING, WORST_PREFIX = "Worst Segment Regressions", "Worst segment regressions"
BEST_HEADING, BEST_PREFIX = "Best Segment Improvements", "Best segment improvements"
RECOMMENDATION = "Policy engine recommends: **{decision}**. {advice}"
RECOMMENDATION_ADVICE = {
    "REJECT": (
        "A human reviewer should confirm the rejection, inspect the failed "
        "checks, verify data quality and split integrity, and require "
        "retraining or feature changes before reconsidering promotion."
    ),
    "MANUAL_REVIEW": (
        "A human reviewer should inspect the flagged drift or segment "
        "regressions, validate whether the degradation is operationally "
        "acceptable, and document the final decision."
    ),
    "PROMOTE": (
        "A human reviewer should confirm the passed checks, spot-check "
        "segment behaviour, and then approve or hold promotion."
    ),
}
TEMPLATE_FOOTER = "*(This is a template-based report. Set OPENAI_API_KEY for AI-generated analysis.)*"
NO_POLICY_RISKS = "No policy risk flags were identified."

# --- evidence lines (template report and back-fill; bullets added there) -------------------
EVIDENCE_CANDIDATE_RMSE = "Candidate test RMSE: {rmse}"
EVIDENCE_CANDIDATE_MAE = "Candidate test MAE: {mae}"
EVIDENCE_CHAMPION_RMSE = "Champion test RMSE: {rmse}"
EVIDENCE_CHAMPION_MAE = "Champion test MAE: {mae}"
EVIDENCE_RMSE_DELTA = "RMSE delta vs champion: {delta} ({pct})"
EVIDENCE_SEGMENTS = "{prefix}: {segments}"
EVIDENCE_SEGMENT_ITEM = "{column}={value} ({pct})"
NO_CHAMPION_EVIDENCE = "Baseline comparison: first candidate; no incumbent baseline available."
NO_SEGMENT_REGRESSIONS = "Segment comparison: no segment regressions reported."
NO_DRIFT_REPORT = "Drift status: no drift report provided."
NO_DRIFT_FOUND = "Drift status: no significant drift detected."
DRIFT_FOUND = "Drift status: detected in {columns}."
CHECKS_PASSED = "Checks passed: {checks}"
CHECKS_FAILED = "Checks failed: {checks}"
NO_MAJOR_RISKS = "No major risk flags identified."

# --- structured report sections and markdown rendering ------------------------------------------
REPORT_SECTIONS = ["summary", "evidence", "risk_flags", "market_context", "recommendation", "citations"]
# Heading text (lower-cased) recognised when parsing a report into sections.
SECTION_ALIASES = {
    "summary": "summary",
    "evidence": "evidence",
    "risk flags": "risk_flags",
    "market context": "market_context",
    "recommendation": "recommendation",
    "sources": "citations",
    "citations": "citations",
}
MARKDOWN_DEFAULTS = {
    "summary": "No summary provided.",
    "evidence": "No evidence items captured.",
    "risk_flags": "No major risk flags identified.",
    "market_context": "No external market context provided.",
    "recommendation": "Use this report as input to the final human decision.",
}
NO_CHAMPION_LOOKUP = "No champion model exists yet. This is the first candidate."
NO_DRIFT_LOOKUP = "Drift detection was not run."

# --- judge ---------------------------------------------------------------------------------------------
JUDGE_SCORE_KEYS = ["completeness", "accuracy", "actionability", "safety"]
JUDGE_SCORE_PATTERN = r"\b(completeness|accuracy|actionability|safety)\s*[:=]\s*(\d+)\b"
JUDGE_MISSING_KEY = "Judge feedback missing required key '{key}'"
JUDGE_NOT_INTEGER = "Judge score for '{key}' must be an integer, got {kind}"
JUDGE_NOT_OBJECT = "Judge feedback value must be a dict or JSON object string, got {kind}"
JUDGE_CONTEXT_TITLE = "## Scenario Context\n"
JUDGE_CONTEXT_CANDIDATE = "**Candidate Metrics**: RMSE={rmse}, MAE={mae}"
JUDGE_CONTEXT_CHAMPION = "**Champion Metrics**: RMSE={rmse}, MAE={mae}"
JUDGE_CONTEXT_NO_CHAMPION = "**Champion**: No champion exists"
JUDGE_CONTEXT_VERDICT = "**Policy Verdict**: {decision}"
JUDGE_CONTEXT_REASONS = "**Reasons**: {reasons}"
JUDGE_CONTEXT_PASSED = "**Checks Passed**: {checks}"
JUDGE_CONTEXT_FAILED = "**Checks Failed**: {checks}"
JUDGE_CONTEXT_DRIFT = "**Drift Detected**: {flag}"
JUDGE_CONTEXT_DRIFTED = "**Drifted Columns**: {columns}"
JUDGE_CONTEXT_WORST = "**Worst Segments**:"
JUDGE_CONTEXT_SEGMENT = "  - {column}={value}: {pct}"
NOT_A_NUMBER = "N/A"

# --- review records and decisions -----------------------------------------------------------------
AUTO_REJECT_ACTION = (
    "Policy already rejected this candidate. Optionally confirm or override with "
    "resume_promotion_review(review_id, 'approve'|'reject')."
)
PENDING_ACTION = "Resume this review with approve or reject."
DEFAULT_REJECT_REASON = "Rejected by human reviewer"
BAD_DECISION_ERROR = "Decision must be either 'approve' or 'reject'."
# Own wording (no counterpart to match): a decision for an unknown review.
REVIEW_NOT_FOUND = "Review '{review_id}' was not found."
REVIEW_COMPLETED = "Review '{review_id}' is already completed."
