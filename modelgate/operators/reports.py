"""Evidence reports as data: rendering, parsing and checking, row-parallel.

A report is one row. Rendering builds an array of lines with column
expressions and joins it; parsing splits a text into lines and folds them
with higher-order functions *inside the row* (``aggregate``/``transform``),
so a corpus of reports is processed with no shuffle at all and never more
than one text per task-row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelgate import fixed as T
from modelgate.functions.text import (
    baseline_wording,
    fill,
    fixed,
    humanize_checks,
    signed_percent,
    signed_thousands,
    strip_text,
    thousands,
)
from modelgate.operators.common import top_k_per_group
from modelgate.schema import JUDGE_SCORE_KEYS, SECTION_ALIASES

STRING_ARRAY = "array<string>"
# Line breaks as Python's str.splitlines() sees them.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
SEGMENT_STRUCT = "struct<segment_column:string,segment_value:string,rmse_delta_pct:double>"


def _arr(*items: Column) -> Column:
    return F.array(*items).cast(STRING_ARRAY)


def _when_arr(cond: Column, items: Column) -> Column:
    return F.when(cond, items).otherwise(F.array().cast(STRING_ARRAY))


def _empty() -> Column:
    return F.array().cast(STRING_ARRAY)


# ---------------------------------------------------------------------------
# Segment summaries (I3): worst regressions, else best improvements
# ---------------------------------------------------------------------------
def segment_summary(deltas: DataFrame, limit: int = 5) -> DataFrame:
    """Per candidate: ``segment_heading``, ``segment_prefix`` and the top
    ``limit`` segments — largest regressions (pct > 0) by pct desc, or if
    none regress, the best improvements by pct asc; ties keep comparison
    order. Exact top-k without gathering a model's segments in one task."""
    keys = ["model_name", "model_version"]
    # NaN is not greater than anything here, though Spark orders it last
    worse = (F.col("rmse_delta_pct") > 0) & ~F.isnan("rmse_delta_pct")
    flags = deltas.groupBy(*keys).agg(F.max(worse).alias("any_regress"))
    d = deltas.join(flags, keys).where(~F.col("any_regress") | worse)
    sort_key = F.when(F.col("any_regress"), -F.col("rmse_delta_pct")).otherwise(F.col("rmse_delta_pct"))
    top = top_k_per_group(d.withColumn("__k", sort_key), keys, [F.col("__k"), F.col("ord")], limit)
    seg = F.struct(
        F.col("rank"),
        F.col("segment_column").alias("segment_column"),
        F.col("segment_value").alias("segment_value"),
        F.col("rmse_delta_pct").alias("rmse_delta_pct"),
    )
    out = top.groupBy(*keys).agg(F.first("any_regress").alias("any_regress"), F.array_sort(F.collect_list(seg)).alias("__s"))
    return out.select(
        *keys,
        F.when(F.col("any_regress"), F.lit(T.WORST_HEADING)).otherwise(F.lit(T.BEST_HEADING)).alias("segment_heading"),
        F.when(F.col("any_regress"), F.lit(T.WORST_PREFIX)).otherwise(F.lit(T.BEST_PREFIX)).alias("segment_prefix"),
        F.transform("__s", lambda s: F.struct(s["segment_column"].alias("segment_column"),
                                              s["segment_value"].alias("segment_value"),
                                              s["rmse_delta_pct"].alias("rmse_delta_pct"))).alias("segments"),
    )


def _seg_inline(segments: Column) -> Column:
    """'col=value (+x.x%); ...'"""
    return F.array_join(
        F.transform(segments, lambda s: fill(T.EVIDENCE_SEGMENT_ITEM, column=s["segment_column"], value=s["segment_value"],
                                             pct=signed_percent(s["rmse_delta_pct"]))),
        "; ",
    )


# ---------------------------------------------------------------------------
# K1: deterministic template report
# ---------------------------------------------------------------------------
REPORT_INPUT_DEFAULTS = {
    "champion_rmse": "double",
    "champion_mae": "double",
    "rmse_delta": "double",
    "rmse_delta_pct": "double",
    "has_champion": "boolean",
    "has_drift_report": "boolean",
    "column_results": "array<struct<column:string,drift_type:string,statistic:double,threshold:double,p_value:double,is_drifted:boolean>>",
    "segment_heading": "string",
    "segment_prefix": "string",
    "segments": f"array<{SEGMENT_STRUCT}>",
    "fallback_note": "string",
}


def with_report_defaults(df: DataFrame) -> DataFrame:
    for name, dtype in REPORT_INPUT_DEFAULTS.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(dtype))
    return df


def _bullet(text: Column) -> Column:
    return F.concat(F.lit("- "), text)


def _drift_lines(results: Column) -> tuple[Column, Column]:
    """(report block lines, evidence line) for a non-null drift report."""
    drifted = F.filter(results, lambda r: r["is_drifted"])
    stat = F.transform(
        drifted,
        lambda r: F.concat(
            fill(T.REPORT_DRIFT_LINE, column=r["column"], kind=F.upper(r["drift_type"]), statistic=fixed(r["statistic"], 4)),
            F.when(r["p_value"].isNotNull(), fill(T.REPORT_DRIFT_P, p=fixed(r["p_value"], 4))).otherwise(F.lit("")),
        ),
    )
    names = F.array_join(F.transform(drifted, lambda r: r["column"]), ", ")
    has = F.size(drifted) > 0
    block = F.concat(
        _arr(F.lit(T.H_DRIFT)),
        F.when(has, F.concat(_arr(fill(T.REPORT_DRIFT_COUNT, count=F.size(drifted).cast("string"))), stat))
        .otherwise(_arr(F.lit(T.REPORT_NO_DRIFT))),
        _arr(F.lit("")),
    )
    evidence = _bullet(F.when(has, fill(T.DRIFT_FOUND, columns=names)).otherwise(F.lit(T.NO_DRIFT_FOUND)))
    return block, evidence


def _recommendation(decision: Column) -> Column:
    advice = (
        F.when(decision == T.DECISION_REJECT, F.lit(T.RECOMMENDATION_ADVICE["REJECT"]))
        .when(decision == T.DECISION_MANUAL_REVIEW, F.lit(T.RECOMMENDATION_ADVICE["MANUAL_REVIEW"]))
        .otherwise(F.lit(T.RECOMMENDATION_ADVICE["PROMOTE"]))
    )
    return fill(T.RECOMMENDATION, decision=decision, advice=advice)


def report_lines(model_version: Column | None = None) -> Column:
    """Array of template-report lines for a report-input row (see
    ``render_report``)."""
    v = F.col("model_version") if model_version is None else model_version
    champ = F.coalesce(F.col("has_champion"), F.lit(False))
    rmse = thousands(F.coalesce(F.col("rmse"), F.lit(0.0)))
    mae = thousands(F.coalesce(F.col("mae"), F.lit(0.0)))
    c_rmse = thousands(F.coalesce(F.col("champion_rmse"), F.lit(0.0)))
    c_mae = thousands(F.coalesce(F.col("champion_mae"), F.lit(0.0)))
    delta = signed_thousands(F.coalesce(F.col("rmse_delta"), F.lit(0.0)))
    delta_pct = signed_percent(F.coalesce(F.col("rmse_delta_pct"), F.lit(0.0)))
    segs = F.coalesce(F.col("segments"), F.array().cast(f"array<{SEGMENT_STRUCT}>"))
    has_segs = F.size(segs) > 0
    seg_block = F.concat(
        _arr(fill(T.H_SEGMENTS, heading=F.col("segment_heading"))),
        F.transform(segs, lambda s: fill(T.REPORT_SEGMENT_LINE, column=s["segment_column"], value=s["segment_value"],
                                         pct=signed_percent(s["rmse_delta_pct"]))),
        _arr(F.lit("")),
    )
    champion_block = F.when(
        champ,
        F.concat(
            _arr(F.lit(T.H_CHAMPION),
                 fill(T.REPORT_CHAMPION_RMSE, rmse=c_rmse),
                 fill(T.REPORT_CHAMPION_MAE, mae=c_mae),
                 fill(T.REPORT_RMSE_DELTA, delta=delta, pct=delta_pct),
                 F.lit("")),
            _when_arr(has_segs, seg_block),
        ),
    ).otherwise(_arr(F.lit(T.H_CHAMPION), F.lit(T.FIRST_CANDIDATE_LINE), F.lit("")))
    has_drift = F.coalesce(F.col("has_drift_report"), F.lit(False))
    drift_block, drift_evidence = _drift_lines(F.coalesce(F.col("column_results"), F.array().cast(REPORT_INPUT_DEFAULTS["column_results"])))
    evidence = F.concat(
        _arr(_bullet(fill(T.EVIDENCE_CANDIDATE_RMSE, rmse=rmse)), _bullet(fill(T.EVIDENCE_CANDIDATE_MAE, mae=mae))),
        F.when(
            champ,
            F.concat(
                _arr(_bullet(fill(T.EVIDENCE_CHAMPION_RMSE, rmse=c_rmse)),
                     _bullet(fill(T.EVIDENCE_CHAMPION_MAE, mae=c_mae)),
                     _bullet(fill(T.EVIDENCE_RMSE_DELTA, delta=delta, pct=delta_pct))),
                F.when(has_segs, _arr(_bullet(fill(T.EVIDENCE_SEGMENTS, prefix=F.col("segment_prefix"), segments=_seg_inline(segs)))))
                .otherwise(_arr(_bullet(F.lit(T.NO_SEGMENT_REGRESSIONS)))),
            ),
        ).otherwise(_arr(_bullet(F.lit(T.NO_CHAMPION_EVIDENCE)))),
        F.when(has_drift, _arr(drift_evidence)).otherwise(_arr(_bullet(F.lit(T.NO_DRIFT_REPORT)))),
        _when_arr(F.size("checks_passed") > 0, _arr(_bullet(fill(T.CHECKS_PASSED, checks=humanize_checks(F.col("checks_passed")))))),
    )
    reasons = F.coalesce(F.col("reasons"), _empty())
    risk = F.concat(
        _when_arr(F.size("checks_failed") > 0, _arr(_bullet(fill(T.CHECKS_FAILED, checks=humanize_checks(F.col("checks_failed")))))),
        F.transform(reasons, _bullet),
    )
    risk = F.when(F.size(risk) > 0, risk).otherwise(_arr(_bullet(F.lit(T.NO_POLICY_RISKS))))
    decision = F.col("decision")
    note = F.col("fallback_note")
    return F.concat(
        _arr(fill(T.REPORT_TITLE, version=v), F.lit(""), F.lit(T.H_SUMMARY),
             fill(T.REPORT_SUMMARY, decision=decision), F.lit(""),
             F.lit(T.H_CANDIDATE), fill(T.REPORT_CANDIDATE_RMSE, rmse=rmse),
             fill(T.REPORT_CANDIDATE_MAE, mae=mae), F.lit("")),
        champion_block,
        _when_arr(has_drift, drift_block),
        _arr(F.lit(T.H_EVIDENCE)), evidence, _arr(F.lit(""), F.lit(T.H_RISKS)), risk, _arr(F.lit("")),
        _arr(F.lit(T.H_REASONS)), F.transform(reasons, _bullet),
        _arr(F.lit(""), F.lit(T.H_RECOMMENDATION), _recommendation(decision)),
        F.when(note.isNotNull() & (note != ""), _arr(F.lit(""), F.concat(F.lit("*"), note, F.lit("*"))))
        .otherwise(_arr(F.lit(""), F.lit(T.TEMPLATE_FOOTER))),
    )


def render_report(report_input: DataFrame) -> DataFrame:
    """Add ``report`` (markdown text) to every verdict row."""
    df = with_report_defaults(report_input)
    return df.withColumn("report", F.array_join(report_lines(), "\n"))


# ---------------------------------------------------------------------------
# K2-K4: structured reports from text
# ---------------------------------------------------------------------------
def _aliases() -> Column:
    return F.create_map(*[F.lit(x) for kv in SECTION_ALIASES.items() for x in kv])
_SECTIONS = ["summary", "evidence", "risk_flags", "market_context", "recommendation", "citations"]


def split_lines(text: Column) -> Column:
    """``str.splitlines()``: no trailing empty element after a final break."""
    parts = F.split(text, LINE_BREAK)
    return F.when(text == "", _empty()).otherwise(
        F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    )


def _stripped_nonempty(lines: Column) -> Column:
    return F.filter(F.transform(lines, strip_text), lambda x: x != "")


def _list_items(lines: Column) -> Column:
    return F.transform(
        _stripped_nonempty(lines),
        lambda x: F.when(x.startswith("- "), strip_text(F.substring(x, 3, 1 << 30))).otherwise(x),
    )


def section_of(line: Column) -> Column:
    """The section that a line is the heading of, else null. A heading is a
    whole line that, stripped, is an alias; or '#'s then an alias; or an alias
    then ':' (in any case)."""
    t = strip_text(line)
    name = F.when(t.startswith("#"), strip_text(F.regexp_replace(t, "^#+", ""))).when(
        t.endswith(":"), strip_text(F.substring(t, F.lit(1), F.length(t) - 1))
    ).otherwise(t)
    return F.try_element_at(_aliases(), F.lower(name))


def parse_reports(df: DataFrame, text_col: str, out_col: str = "parsed") -> DataFrame:
    """Markdown report -> struct(summary, evidence[], risk_flags[],
    market_context, recommendation, citations[]) for every row.

    The text is cut into lines once, each line is looked up among the headings,
    and the lines between two headings go to the first one's section. Lines
    before the first heading become the summary when no summary section
    exists. Staged columns keep each step to one evaluation per row; no
    shuffle.
    """
    t = F.col(text_col)
    staged = df.withColumn("__lines", split_lines(t))
    staged = staged.withColumn("__names", F.transform("__lines", section_of))
    places = F.filter(
        F.transform("__names", lambda n, i: F.when(n.isNotNull(), i + 1)), lambda i: i.isNotNull()
    )
    staged = staged.withColumn("__heads", places)

    def until_next(start: Column, k) -> Column:
        """Lines from ``start`` (from 1) to the heading of number ``k`` (from 0)."""
        end = F.coalesce(F.get("__heads", k), F.size("__lines") + 1)
        return F.slice("__lines", start, end - start)

    pairs = F.transform(
        "__heads", lambda h, k: F.struct(F.element_at("__names", h).alias("n"), until_next(h + 1, k + 1).alias("b"))
    )
    staged = staged.withColumn("__pairs", pairs)

    def lines_of(section: str) -> Column:
        return F.flatten(F.transform(F.filter("__pairs", lambda p: p["n"] == section), lambda p: p["b"]))

    intro = F.coalesce(until_next(F.lit(1), F.lit(0)), _empty())
    staged = staged.select(
        "*",
        *[lines_of(sec).alias(f"__l_{sec}") for sec in _SECTIONS],
        intro.alias("__l_intro"),
    )
    summary_lines = F.when(F.size(_stripped_nonempty(F.col("__l_summary"))) > 0, _stripped_nonempty(F.col("__l_summary"))).otherwise(
        _stripped_nonempty(F.col("__l_intro"))
    )
    summary = strip_text(F.array_join(summary_lines, " "))
    parsed = F.struct(
        F.when(summary != "", summary).otherwise(strip_text(t)).alias("summary"),
        _list_items(F.col("__l_evidence")).alias("evidence"),
        _list_items(F.col("__l_risk_flags")).alias("risk_flags"),
        F.array_join(_stripped_nonempty(F.col("__l_market_context")), "\n").alias("market_context"),
        strip_text(F.array_join(_stripped_nonempty(F.col("__l_recommendation")), " ")).alias("recommendation"),
        _list_items(F.col("__l_citations")).alias("citations"),
    )
    helper = ["__lines", "__names", "__heads", "__pairs", "__l_intro", *[f"__l_{sec}" for sec in _SECTIONS]]
    return staged.withColumn(out_col, parsed).drop(*helper)


_JSON_OPTS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "true"}


def parse_whole(text: Column, schema: str, opening: str = "{", closing: str = "}") -> Column:
    """A text that is one JSON value from its first to its last character,
    else null. ``from_json`` alone would stop after the first value; as the only
    element of a list, a value with anything after it does not parse."""
    t = strip_text(text)
    listed = F.from_json(F.concat(F.lit("["), t, F.lit("]")), f"array<{schema}>", _JSON_OPTS)
    alone = t.startswith(opening) & t.endswith(closing) & (F.size(listed) == 1)
    return F.when(alone, F.try_element_at(listed, F.lit(1)))


def json_candidates(text: Column, brace_span: bool = False) -> list[Column]:
    """Texts to try as a JSON object: the stripped text; the inside of a
    ```json fence (or of a bare ``` fence); optionally first '{' to last '}'."""
    s = strip_text(text)
    start = F.instr(s, "```json")
    # position of the last ``` (1-based), 0 when absent
    last = F.when(F.instr(s, "```") > 0, F.length(s) - F.instr(F.reverse(s), "```") - 1)
    fenced = F.when(
        (start > 0) & (last > start),
        strip_text(F.substring(s, start + 7, last - start - 7)),
    ).when(
        (start == 0) & s.startswith("```") & s.endswith("```") & (F.length(s) >= 6),
        strip_text(F.substring(s, F.lit(4), F.length(s) - 6)),
    )
    items = [s, fenced]
    if brace_span:
        first = F.instr(s, "{")
        lastb = F.length(s) - F.instr(F.reverse(s), "}") + 1
        items.append(F.when((first > 0) & (F.instr(s, "}") > 0) & (lastb > first), strip_text(F.substring(s, first, lastb - first + 1))))
    return items


def extract_json(text: Column, brace_span: bool = False) -> Column:
    """First candidate that parses as a JSON object, as map<string,string>
    (nested values keep their JSON text); null when none does. A candidate is
    looked for and parsed only if those before it fail."""
    return F.coalesce(*[parse_whole(c, "map<string,string>") for c in json_candidates(text, brace_span)])


def _text_list(raw: Column) -> Column:
    """A JSON value that is a list of items or one string -> trimmed non-empty items."""
    as_list = F.from_json(raw, STRING_ARRAY, _JSON_OPTS)
    return F.when(raw.isNull(), _empty()).when(
        as_list.isNotNull() & strip_text(raw).startswith("["), _stripped_nonempty(as_list)
    ).otherwise(F.when(strip_text(raw) != "", _arr(strip_text(raw))).otherwise(_empty()))


def report_from_json(payload: Column) -> Column:
    def text(k):
        return strip_text(F.coalesce(F.try_element_at(payload, F.lit(k)), F.lit("")))

    return F.struct(
        text("summary").alias("summary"),
        _text_list(F.try_element_at(payload, F.lit("evidence"))).alias("evidence"),
        _text_list(F.try_element_at(payload, F.lit("risk_flags"))).alias("risk_flags"),
        text("market_context").alias("market_context"),
        text("recommendation").alias("recommendation"),
        _text_list(F.try_element_at(payload, F.lit("citations"))).alias("citations"),
    )


def coerce_reports(df: DataFrame, text_col: str, out_col: str = "structured") -> DataFrame:
    """JSON payload when it carries any content, else markdown sections."""
    staged = df.withColumn("__payload", extract_json(F.col(text_col)))
    staged = staged.withColumn("__from_json", report_from_json(F.col("__payload")))
    staged = parse_reports(staged, text_col, "__parsed")
    j = F.col("__from_json")
    useful = F.col("__payload").isNotNull() & (
        (j["summary"] != "") | (F.size(j["evidence"]) > 0) | (F.size(j["risk_flags"]) > 0) | (j["recommendation"] != "")
    )
    return staged.withColumn(out_col, F.when(useful, j).otherwise(F.col("__parsed"))).drop("__payload", "__from_json", "__parsed")


# ---------------------------------------------------------------------------
# K5: enrich, K6: render structured report
# ---------------------------------------------------------------------------
def append_unique(lines: Column, new: Column) -> Column:
    """Append each of ``new`` unless blank or already present ignoring case
    and outer whitespace."""
    def norm(x):
        return F.lower(strip_text(x))

    return F.aggregate(
        new,
        lines,
        lambda acc, line: F.when(
            (norm(line) == "") | F.exists(acc, lambda e: norm(e) == norm(line)), acc
        ).otherwise(F.array_append(acc, line)),
    )


def enrich_reports(df: DataFrame, report_col: str, out_col: str = "enriched") -> DataFrame:
    """Back-fill the deterministic evidence of each row's verdict into its
    structured report (unique lines only); 'champion' wording becomes
    'baseline' for first candidates. Rows need the verdict columns and
    ``segments_top3``/``segment_prefix_top3`` (see the gate plan)."""
    df = with_report_defaults(df)
    for name, dtype in (("segments_top3", f"array<{SEGMENT_STRUCT}>"), ("segment_prefix_top3", "string")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(dtype))
    champ = F.coalesce(F.col("has_champion"), F.lit(False))
    rmse = F.coalesce(F.col("rmse"), F.lit(0.0))
    mae = F.coalesce(F.col("mae"), F.lit(0.0))
    delta_abs = signed_thousands(F.coalesce(F.col("rmse_delta"), F.lit(0.0)))
    delta_pct = signed_percent(F.coalesce(F.col("rmse_delta_pct"), F.lit(0.0)))
    segs = F.coalesce(F.col("segments_top3"), F.array().cast(f"array<{SEGMENT_STRUCT}>"))
    drifted = F.filter(F.coalesce(F.col("column_results"), F.array().cast(REPORT_INPUT_DEFAULTS["column_results"])),
                       lambda r: r["is_drifted"])
    new_evidence = F.concat(
        _arr(fill(T.EVIDENCE_CANDIDATE_RMSE, rmse=thousands(rmse)), fill(T.EVIDENCE_CANDIDATE_MAE, mae=thousands(mae))),
        F.when(
            champ,
            F.concat(
                _arr(fill(T.EVIDENCE_CHAMPION_RMSE, rmse=thousands(F.coalesce(F.col("champion_rmse"), F.lit(0.0)))),
                     fill(T.EVIDENCE_CHAMPION_MAE, mae=thousands(F.coalesce(F.col("champion_mae"), F.lit(0.0)))),
                     fill(T.EVIDENCE_RMSE_DELTA, delta=delta_abs, pct=delta_pct)),
                _when_arr(F.size(segs) > 0, _arr(fill(T.EVIDENCE_SEGMENTS, prefix=F.col("segment_prefix_top3"),
                                                      segments=_seg_inline(segs)))),
            ),
        ).otherwise(_arr(F.lit(T.NO_CHAMPION_EVIDENCE))),
        F.when(~F.coalesce(F.col("has_drift_report"), F.lit(False)), _arr(F.lit(T.NO_DRIFT_REPORT)))
        .when(F.size(drifted) > 0, _arr(fill(T.DRIFT_FOUND, columns=F.array_join(F.transform(drifted, lambda r: r["column"]), ", "))))
        .otherwise(_arr(F.lit(T.NO_DRIFT_FOUND))),
        _when_arr(F.size("checks_passed") > 0, _arr(fill(T.CHECKS_PASSED, checks=humanize_checks(F.col("checks_passed"))))),
    )
    new_risks = F.concat(
        _when_arr(F.size("checks_failed") > 0, _arr(fill(T.CHECKS_FAILED, checks=humanize_checks(F.col("checks_failed"))))),
        F.coalesce(F.col("reasons"), _empty()),
    )
    rep = F.col(report_col)
    staged = df.withColumn("__evidence", append_unique(rep["evidence"], new_evidence)).withColumn(
        "__risks", append_unique(rep["risk_flags"], new_risks)
    )
    risks = F.when(F.size("__risks") > 0, F.col("__risks")).otherwise(_arr(F.lit(T.NO_MAJOR_RISKS)))

    def wording(x):
        return F.when(champ, x).otherwise(baseline_wording(x))

    out = F.struct(
        wording(rep["summary"]).alias("summary"),
        F.transform("__evidence", wording).alias("evidence"),
        F.transform(risks, wording).alias("risk_flags"),
        wording(rep["market_context"]).alias("market_context"),
        wording(rep["recommendation"]).alias("recommendation"),
        rep["citations"].alias("citations"),
    )
    return staged.withColumn(out_col, out).drop("__evidence", "__risks")


def render_markdown(report: Column) -> Column:
    """Structured report -> markdown with defaults for empty parts."""
    def or_default(x, d):
        return F.when(F.coalesce(x, F.lit("")) != "", x).otherwise(F.lit(d))

    def items(arr, d):
        a = F.coalesce(arr, _empty())
        a = F.when(F.size(a) > 0, a).otherwise(_arr(F.lit(d)))
        return F.transform(a, lambda x: F.concat(F.lit("- "), x))

    cites = F.coalesce(report["citations"], _empty())
    lines = F.concat(
        _arr(F.lit(T.H_SUMMARY), or_default(report["summary"], T.MARKDOWN_DEFAULTS["summary"]), F.lit(""), F.lit(T.H_EVIDENCE)),
        items(report["evidence"], T.MARKDOWN_DEFAULTS["evidence"]),
        _arr(F.lit(""), F.lit(T.H_RISKS)),
        items(report["risk_flags"], T.MARKDOWN_DEFAULTS["risk_flags"]),
        _arr(F.lit(""), F.lit(T.H_MARKET), or_default(report["market_context"], T.MARKDOWN_DEFAULTS["market_context"]),
             F.lit(""), F.lit(T.H_RECOMMENDATION),
             or_default(report["recommendation"], T.MARKDOWN_DEFAULTS["recommendation"])),
        _when_arr(F.size(cites) > 0, F.concat(_arr(F.lit(""), F.lit(T.H_SOURCES)), F.transform(cites, lambda x: F.concat(F.lit("- "), x)))),
    )
    return F.array_join(lines, "\n")


# ---------------------------------------------------------------------------
# K7: judge scores, K8: judge context, D7: judge average
# ---------------------------------------------------------------------------
SCORE_PATTERN = T.JUDGE_SCORE_PATTERN


def _json_kind(text: Column) -> Column:
    """Python type name of a whole-text JSON value ('dict', 'list', 'int',
    'float', 'bool', 'NoneType', 'str'), or null when the text is not JSON."""
    t = strip_text(text)
    as_map = parse_whole(text, "map<string,string>")
    as_list = parse_whole(text, "array<string>", "[", "]")
    return (
        F.when(as_map.isNotNull(), F.lit("dict"))
        .when(as_list.isNotNull(), F.lit("list"))
        .when(t.rlike(r"^-?(0|[1-9]\d*)$"), F.lit("int"))
        .when(t.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$") | t.isin("NaN", "Infinity", "-Infinity"), F.lit("float"))
        .when(t.isin("true", "false"), F.lit("bool"))
        .when(t == "null", F.lit("NoneType"))
        .when(t.rlike(r'^"([^"\\]|\\.)*"$'), F.lit("str"))
    )


def _judge_inputs(text: Column) -> dict[str, Column]:
    """Parses of a judge answer every score needs: JSON kind, JSON as a map
    and as numbers, and the ``name: n`` matches."""
    keys = JUDGE_SCORE_KEYS
    return {
        "kind": _json_kind(text),
        "map": parse_whole(text, "map<string,string>"),
        "num": parse_whole(text, "struct<" + ", ".join(f"{k}: double" for k in keys) + ">"),
        "names": F.regexp_extract_all(text, F.lit(SCORE_PATTERN), 1),
        "values": F.regexp_extract_all(text, F.lit(SCORE_PATTERN), 2),
    }


def _judge_fields(kind: Column, as_map: Column, as_num: Column, names: Column, values: Column) -> dict[str, Column]:
    """Per score: value (int) and error text; plus the whole-answer error."""
    from modelgate.functions.parse import ascii_digits

    pairs = F.arrays_zip(names.alias("n"), values.alias("v"))
    is_json = kind == "dict"
    any_match = F.size(names) > 0

    def last_match(k):
        return F.try_element_at(F.filter(pairs, lambda p: p["n"] == k), F.lit(-1))["v"]

    out = {}
    for k in JUDGE_SCORE_KEYS:
        raw = F.try_element_at(as_map, F.lit(k))
        num = as_num[k]
        digits = ascii_digits(strip_text(raw))
        from_json_ok = F.when(num.isNotNull(), F.when(num == F.floor(num), num.cast("bigint")))
        from_json_ok = F.coalesce(from_json_ok, F.when(num.isNull() & digits.rlike(r"^\d+$"), digits.cast("bigint")))
        value = F.when(is_json, from_json_ok).otherwise(last_match(k).cast("bigint"))
        present = F.when(is_json, F.map_contains_key(as_map, F.lit(k))).otherwise(last_match(k).isNotNull())
        raw_text = strip_text(raw)
        value_kind = (
            F.when(raw.isNull(), F.lit("NoneType"))
            .when(num.isNotNull(), F.lit("float"))
            .when(F.lower(raw).isin("true", "false"), F.lit("bool"))
            .when(raw_text.startswith("{"), F.lit("dict"))
            .when(raw_text.startswith("["), F.lit("list"))
            .otherwise(F.lit("str"))
        )
        out[f"value_{k}"] = value.cast("int")
        out[f"error_{k}"] = (
            F.when(~present, fill(T.JUDGE_MISSING_KEY, key=F.lit(k)))
            .when(value.isNull(), fill(T.JUDGE_NOT_INTEGER, key=F.lit(k), kind=value_kind))
        )
    out["error_shape"] = (
        F.when(kind.isNotNull() & (kind != "dict"), fill(T.JUDGE_NOT_OBJECT, kind=kind))
        .when(kind.isNull() & ~any_match, fill(T.JUDGE_NOT_OBJECT, kind=F.lit("str")))
    )
    return out


def _judge_error(get) -> Column:
    return F.coalesce(get("error_shape"), *[get(f"error_{k}") for k in JUDGE_SCORE_KEYS])


def _judge_struct(get, error: Column | None = None) -> Column:
    """struct(scores..., average, error) from staged field columns."""
    keys = JUDGE_SCORE_KEYS
    error = _judge_error(get) if error is None else error
    average = (get("value_completeness") + get("value_accuracy") + get("value_actionability") + get("value_safety")) / 4.0
    return F.struct(
        *[F.when(error.isNull(), get(f"value_{k}")).alias(k) for k in keys],
        F.when(error.isNull(), average).alias("average"),
        error.alias("error"),
    )


def judge_scores(text: Column) -> Column:
    """struct(completeness, accuracy, actionability, safety (ints), average,
    error). A JSON object (numbers, integral floats or digit strings) is read
    directly; any other JSON value is an error naming its type; text that is
    not JSON is scanned for ``name: n`` / ``name=n`` (last one wins). All
    four scores are required. For many rows use ``score_judgements``, which
    evaluates each parse once per row."""
    i = _judge_inputs(text)
    fields = _judge_fields(i["kind"], i["map"], i["num"], i["names"], i["values"])
    return _judge_struct(lambda name: fields[name])


def score_judgements(df: DataFrame, text_col: str, out_col: str = "scores") -> DataFrame:
    """``judge_scores`` for every row, staged: the JSON and pattern parses are
    columns computed once, then the per-score fields, then the struct."""
    def stage(frame: DataFrame, cols: dict[str, Column]) -> DataFrame:
        # A one-row Generate between stages: the optimizer cannot fold the
        # staged parses back into their consumers (which would evaluate
        # them once per reference).
        row = F.struct(*[F.col(f"`{c}`") for c in frame.columns], *[v.alias(k) for k, v in cols.items()])
        return frame.select(F.inline(F.array(row)))

    inputs = {f"__ji_{k}": v for k, v in _judge_inputs(F.col(text_col)).items()}
    staged = stage(df, inputs)
    fields = _judge_fields(*[F.col(f"__ji_{k}") for k in ("kind", "map", "num", "names", "values")])
    fields = {f"__jf_{k}": v for k, v in fields.items()}
    staged = stage(staged, fields).drop(*inputs)
    staged = stage(staged, {"__jerr": _judge_error(lambda name: F.col(f"__jf_{name}"))})
    out = staged.withColumn(out_col, _judge_struct(lambda name: F.col(f"__jf_{name}"), F.col("__jerr")))
    return out.drop(*fields, "__jerr")


def judge_average(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Fleet average of judge scores per key (rows with errors excluded)."""
    ok = scores.where(F.col("error").isNull())
    return ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("scored"),
        *[F.avg(k).alias(f"avg_{k}") for k in JUDGE_SCORE_KEYS],
        F.avg("average").alias("avg_average"),
    )


def judge_context(df: DataFrame) -> DataFrame:
    """Judge context text per verdict row (needs ``segments_worst3``)."""
    df = with_report_defaults(df)
    champ = F.coalesce(F.col("has_champion"), F.lit(False))
    has_drift = F.coalesce(F.col("has_drift_report"), F.lit(False))
    drifted = F.filter(F.coalesce(F.col("column_results"), F.array().cast(REPORT_INPUT_DEFAULTS["column_results"])),
                       lambda r: r["is_drifted"])
    worst = F.coalesce(F.col("segments_worst3"), F.array().cast(f"array<{SEGMENT_STRUCT}>"))
    def metric(c):
        return F.coalesce(thousands(F.col(c)), F.lit(T.NOT_A_NUMBER))

    lines = F.concat(
        _arr(F.lit(T.JUDGE_CONTEXT_TITLE), fill(T.JUDGE_CONTEXT_CANDIDATE, rmse=metric("rmse"), mae=metric("mae"))),
        F.when(champ, _arr(fill(T.JUDGE_CONTEXT_CHAMPION, rmse=metric("champion_rmse"), mae=metric("champion_mae"))))
        .otherwise(_arr(F.lit(T.JUDGE_CONTEXT_NO_CHAMPION))),
        _arr(fill(T.JUDGE_CONTEXT_VERDICT, decision=F.col("decision"))),
        _when_arr(F.size("reasons") > 0, _arr(fill(T.JUDGE_CONTEXT_REASONS, reasons=F.array_join("reasons", "; ")))),
        _arr(fill(T.JUDGE_CONTEXT_PASSED, checks=F.array_join("checks_passed", ", ")),
             fill(T.JUDGE_CONTEXT_FAILED, checks=F.array_join("checks_failed", ", "))),
        _when_arr(has_drift, F.concat(
            _arr(fill(T.JUDGE_CONTEXT_DRIFT, flag=F.when(F.coalesce(F.col("overall_drift_detected"), F.lit(False)), F.lit("True"))
                      .otherwise(F.lit("False")))),
            _when_arr(F.size(drifted) > 0, _arr(fill(T.JUDGE_CONTEXT_DRIFTED,
                                                     columns=F.array_join(F.transform(drifted, lambda r: r["column"]), ", ")))),
        )),
        _when_arr(F.size(worst) > 0, F.concat(
            _arr(F.lit(T.JUDGE_CONTEXT_WORST)),
            F.transform(worst, lambda s: fill(T.JUDGE_CONTEXT_SEGMENT, column=s["segment_column"], value=s["segment_value"],
                                              pct=signed_percent(s["rmse_delta_pct"]))),
        )),
    )
    return df.withColumn("judge_context", F.array_join(lines, "\n"))


# ---------------------------------------------------------------------------
# K9/K10/K14/F7/D8: agent message logs
# ---------------------------------------------------------------------------
def message_text(content: Column) -> Column:
    """Message content (plain text, or a JSON list of strings and
    {type: text} parts) -> one trimmed string."""
    parts = F.from_json(content, "array<string>", _JSON_OPTS)
    as_parts = F.transform(
        parts,
        lambda p: F.when(
            strip_text(p).startswith("{"),
            F.when(F.get_json_object(p, "$.type") == "text", F.coalesce(F.get_json_object(p, "$.text"), F.lit(""))).otherwise(F.lit("")),
        ).otherwise(p),
    )
    return F.when(parts.isNotNull() & strip_text(content).startswith("["), strip_text(F.array_join(as_parts, ""))).otherwise(
        strip_text(F.coalesce(content, F.lit("")))
    )


def trace_events(messages: DataFrame) -> DataFrame:
    """Tool-call and tool-result events of every conversation.

    ``messages``: ``conv_id, pos, type, content, tool_calls
    array<struct<id,name[,args]>>, tool_call_id, name``; ``args`` may be of any
    type and becomes JSON text (a string stays as it is). Results without a
    name take the tool name of the latest earlier call with the same id, an
    as-of look-up: calls and results of a (conversation, call id) run in one
    stream, in which the last named call is carried forward. So an id that is
    used a hundred thousand times costs as many rows, not their square.
    Results without an id have no name to look up and stay out of the stream.
    """
    element = messages.schema["tool_calls"].dataType.elementType
    args = F.lit(None).cast("string")
    if "args" in element.fieldNames():
        kind = element["args"].dataType
        args = F.col("call.args") if kind.simpleString() == "string" else F.to_json("call.args")
    blank = lambda c: F.when(c != "", c)  # noqa: E731 - an empty id or name is none
    none = F.lit(None).cast("string")
    calls = messages.select("conv_id", "pos", F.posexplode("tool_calls").alias("k", "call")).select(
        F.lit("tool_call").alias("event"), "conv_id", F.col("pos").alias("message_index"), "k",
        blank(F.col("call.id").cast("string")).alias("tool_call_id"), blank(F.col("call.name").cast("string")).alias("tool_name"),
        args.alias("tool_args"), none.alias("content"),
    )
    results = messages.where(F.col("type") == "tool").select(
        F.lit("tool_result").alias("event"), "conv_id", F.col("pos").alias("message_index"), F.lit(1 << 20).alias("k"),
        blank(F.col("tool_call_id").cast("string")).alias("tool_call_id"), F.col("name").cast("string").alias("tool_name"),
        none.alias("tool_args"), message_text(F.col("content")).alias("content"),
    )
    events = calls.unionByName(results)
    looked_up = events.where(F.col("tool_call_id").isNotNull())
    # a message's calls (k below the results') come before its result
    so_far = Window.partitionBy("conv_id", "tool_call_id").orderBy("message_index", "k").rowsBetween(Window.unboundedPreceding, 0)
    called = F.last(F.when(F.col("event") == "tool_call", F.col("tool_name")), ignorenulls=True).over(so_far)
    named = looked_up.withColumn("tool_name", F.when(F.col("event") == "tool_call", F.col("tool_name")).otherwise(F.coalesce("tool_name", called)))
    return named.unionByName(events.where(F.col("tool_call_id").isNull()))


def trace_stats(events: DataFrame, keys: list[str] = ("conv_id",)) -> DataFrame:
    """Per conversation: tool calls, tool results, sorted distinct tool names
    (bounded by the tool vocabulary)."""
    return events.groupBy(*keys).agg(
        F.count_if(F.col("event") == "tool_call").alias("tool_call_count"),
        F.count_if(F.col("event") == "tool_result").alias("tool_result_count"),
        F.array_sort(F.collect_set("tool_name")).alias("unique_tools_used"),
    )


def final_message(messages: DataFrame, brief: Column) -> DataFrame:
    """Last message per conversation that is not a tool message, makes no
    tool call, and whose text is non-empty and differs from the brief."""
    text = message_text(F.col("content"))
    ok = (
        (F.coalesce(F.col("type"), F.lit("")) != "tool")
        & (F.coalesce(F.size("tool_calls"), F.lit(0)) <= 0)
        & (text != "")
        & (text != F.coalesce(brief, F.lit("")))
    )
    return messages.where(ok).groupBy("conv_id").agg(F.max_by(text, F.col("pos")).alias("final_text"))


def report_checks(report: Column, must: Column, must_not: Column, sections: Column) -> Column:
    """struct(passed, missing[], forbidden[], missing_sections[])."""
    missing = F.filter(F.coalesce(must, _empty()), lambda m: ~report.contains(m))
    forbidden = F.filter(F.coalesce(must_not, _empty()), lambda m: report.contains(m))
    lower = F.lower(report)
    missing_sections = F.filter(F.coalesce(sections, _empty()), lambda s: ~lower.contains(F.lower(s)))
    passed = (F.size(missing) == 0) & (F.size(forbidden) == 0) & (F.size(missing_sections) == 0)
    return F.struct(passed.alias("passed"), missing.alias("missing"), forbidden.alias("forbidden"),
                    missing_sections.alias("missing_sections"))
