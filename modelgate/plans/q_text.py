"""Report, ranking, set, judge and message-log queries with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelgate.functions import text as X
from modelgate.operators import ranking as RK
from modelgate.operators import reports as K
from modelgate.operators import sets as S
from modelgate.operators import registry as R
from modelgate.plans.catalog import gate_job, query, r
from modelgate import fixed as T
from modelgate.plans.oracle import cte, signed_pct, signed_thousands, sql_fill, sql_humanize, sql_strip, thousands
from modelgate.plans.oracles import oracle
from modelgate.schema import SECTION_ALIASES
from modelgate.sources.tables import Tables


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


E = "[]::VARCHAR[]"

# --- oracle: segment summaries, drift blocks, template report --------------------------
cte("seg_flags", ["deltas"], """
  SELECT model_name, model_version, bool_or(rmse_delta_pct > 0) AS any_regress FROM deltas GROUP BY ALL""")


def _seg_top(n: int) -> str:
    return f"""
  SELECT model_name, model_version, bool_or(any_regress) AS any_regress,
    list({sql_fill(T.REPORT_SEGMENT_LINE, column='segment_column', value='segment_value', pct=signed_pct('rmse_delta_pct'))} ORDER BY rk) AS lines,
    string_agg({sql_fill(T.EVIDENCE_SEGMENT_ITEM, column='segment_column', value='segment_value', pct=signed_pct('rmse_delta_pct'))}, '; ' ORDER BY rk) AS inline
  FROM (SELECT d.*, f.any_regress,
          row_number() OVER (PARTITION BY d.model_name, d.model_version
            ORDER BY CASE WHEN f.any_regress THEN -d.rmse_delta_pct ELSE d.rmse_delta_pct END, pos, candidate_rmse, segment_value) AS rk
        FROM deltas d JOIN seg_flags f USING (model_name, model_version)
        WHERE NOT f.any_regress OR d.rmse_delta_pct > 0)
  WHERE rk <= {n} GROUP BY model_name, model_version"""


cte("seg_top5", ["deltas", "seg_flags"], _seg_top(5))
cte("seg_top3", ["deltas", "seg_flags"], _seg_top(3))

cte("drift_block", ["drift_rows"], f"""
  SELECT model_name, count(*) FILTER (WHERE is_drifted) AS n_drifted,
    coalesce(list({sql_fill(T.REPORT_DRIFT_LINE, column='"column"', kind='upper(drift_type)', statistic="printf('%.4f', statistic)")}
       || CASE WHEN p_value IS NOT NULL THEN {sql_fill(T.REPORT_DRIFT_P, p="printf('%.4f', p_value)")} ELSE '' END ORDER BY ord)
       FILTER (WHERE is_drifted), []::VARCHAR[]) AS lines,
    string_agg("column", ', ' ORDER BY ord) FILTER (WHERE is_drifted) AS names,
    bool_or(is_drifted) AS any_drift
  FROM drift_rows GROUP BY model_name""")

_DELTA_ABS = signed_thousands('coalesce(rmse_delta, 0.0)')
_DELTA_PCT = signed_pct('coalesce(rmse_delta_pct, 0.0)')


def _b(x: str) -> str:
    return f"'- ' || {x}"


_HEADING = "CASE WHEN {a} THEN " + q(T.WORST_HEADING) + " ELSE " + q(T.BEST_HEADING) + " END"
_PREFIX = "CASE WHEN {a} THEN " + q(T.WORST_PREFIX) + " ELSE " + q(T.BEST_PREFIX) + " END"
_ADVICE = ("CASE v.decision WHEN 'REJECT' THEN " + q(T.RECOMMENDATION_ADVICE["REJECT"]) + " WHEN 'MANUAL_REVIEW' THEN "
           + q(T.RECOMMENDATION_ADVICE["MANUAL_REVIEW"]) + " ELSE " + q(T.RECOMMENDATION_ADVICE["PROMOTE"]) + " END")
_REPORT_LINES = f"""
  [{sql_fill(T.REPORT_TITLE, version='v.model_version')}, '', {q(T.H_SUMMARY)},
   {sql_fill(T.REPORT_SUMMARY, decision='v.decision')}, '', {q(T.H_CANDIDATE)},
   {sql_fill(T.REPORT_CANDIDATE_RMSE, rmse=thousands('v.rmse'))}, {sql_fill(T.REPORT_CANDIDATE_MAE, mae=thousands('v.mae'))}, '']
  || CASE WHEN v.has_champion THEN
       [{q(T.H_CHAMPION)}, {sql_fill(T.REPORT_CHAMPION_RMSE, rmse=thousands('v.champion_rmse'))},
        {sql_fill(T.REPORT_CHAMPION_MAE, mae=thousands('v.champion_mae'))},
        {sql_fill(T.REPORT_RMSE_DELTA, delta=_DELTA_ABS, pct=_DELTA_PCT)}, '']
       || CASE WHEN s5.lines IS NOT NULL THEN
            [{sql_fill(T.H_SEGMENTS, heading=_HEADING.format(a='s5.any_regress'))}] || s5.lines || [''] ELSE {E} END
     ELSE [{q(T.H_CHAMPION)}, {q(T.FIRST_CANDIDATE_LINE)}, ''] END
  || CASE WHEN db.model_name IS NOT NULL THEN
       [{q(T.H_DRIFT)}]
       || CASE WHEN db.n_drifted > 0 THEN [{sql_fill(T.REPORT_DRIFT_COUNT, count='db.n_drifted')}] || db.lines
               ELSE [{q(T.REPORT_NO_DRIFT)}] END
       || [''] ELSE {E} END
  || [{q(T.H_EVIDENCE)}, {_b(sql_fill(T.EVIDENCE_CANDIDATE_RMSE, rmse=thousands('v.rmse')))},
      {_b(sql_fill(T.EVIDENCE_CANDIDATE_MAE, mae=thousands('v.mae')))}]
  || CASE WHEN v.has_champion THEN
       [{_b(sql_fill(T.EVIDENCE_CHAMPION_RMSE, rmse=thousands('v.champion_rmse')))},
        {_b(sql_fill(T.EVIDENCE_CHAMPION_MAE, mae=thousands('v.champion_mae')))},
        {_b(sql_fill(T.EVIDENCE_RMSE_DELTA, delta=_DELTA_ABS, pct=_DELTA_PCT))}]
       || CASE WHEN s5.lines IS NOT NULL THEN
            [{_b(sql_fill(T.EVIDENCE_SEGMENTS, prefix=_PREFIX.format(a='s5.any_regress'), segments='s5.inline'))}]
          ELSE [{q('- ' + T.NO_SEGMENT_REGRESSIONS)}] END
     ELSE [{q('- ' + T.NO_CHAMPION_EVIDENCE)}] END
  || CASE WHEN db.model_name IS NULL THEN [{q('- ' + T.NO_DRIFT_REPORT)}]
          WHEN db.n_drifted > 0 THEN [{_b(sql_fill(T.DRIFT_FOUND, columns='db.names'))}]
          ELSE [{q('- ' + T.NO_DRIFT_FOUND)}] END
  || CASE WHEN len(v.passed_list) > 0 THEN [{_b(sql_fill(T.CHECKS_PASSED, checks=sql_humanize('v.passed_list')))}] ELSE {E} END
  || ['', {q(T.H_RISKS)}]
  || CASE WHEN len(v.failed_list) + len(v.reasons_list) = 0 THEN [{q('- ' + T.NO_POLICY_RISKS)}]
          ELSE CASE WHEN len(v.failed_list) > 0 THEN [{_b(sql_fill(T.CHECKS_FAILED, checks=sql_humanize('v.failed_list')))}] ELSE {E} END
               || list_transform(v.reasons_list, lambda x: '- ' || x) END
  || ['', {q(T.H_REASONS)}] || list_transform(v.reasons_list, lambda x: '- ' || x)
  || ['', {q(T.H_RECOMMENDATION)}, {sql_fill(T.RECOMMENDATION, decision='v.decision', advice=_ADVICE)},
      '', {q(T.TEMPLATE_FOOTER)}]"""

cte("reports", ["verdict", "seg_top5", "drift_block"], f"""
  SELECT v.model_name, v.model_version, array_to_string({_REPORT_LINES}, chr(10)) AS report
  FROM verdict v
  LEFT JOIN seg_top5 s5 USING (model_name, model_version)
  LEFT JOIN drift_block db ON db.model_name = v.model_name""")


@query("render_report")
def q_render_report(spark, sf_dir):
    return gate_job(spark, sf_dir).reports.select("model_name", "model_version", "report")


oracle("render_report", ["reports"], "SELECT model_name, model_version, report FROM reports")


@query("baseline_language")
def q_baseline_language(spark, sf_dir):
    rep = gate_job(spark, sf_dir).reports
    return rep.select("model_name", "model_version", X.baseline_wording(F.col("report")).alias("report"))


oracle("baseline_language", ["reports"], """
SELECT model_name, model_version,
  regexp_replace(regexp_replace(report, 'C(?i:hampion)', 'Baseline', 'g'), '(?i)champion', 'baseline', 'g') AS report
FROM reports""")


@query("segment_summary")
def q_segment_summary(spark, sf_dir):
    s = K.segment_summary(gate_job(spark, sf_dir).segment_deltas, 5)
    return s.select("model_name", "model_version", "segment_heading", "segment_prefix",
                    K._seg_inline(F.col("segments")).alias("segments"))


oracle("segment_summary", ["seg_top5"], """
SELECT model_name, model_version, """ + _HEADING.format(a="any_regress") + """ AS segment_heading,
  """ + _PREFIX.format(a="any_regress") + """ AS segment_prefix, inline AS segments
FROM seg_top5""")


@query("worst_segments")
def q_worst_segments(spark, sf_dir):
    w = RK.worst_segments(gate_job(spark, sf_dir).segment_deltas, "town")
    return w


oracle("worst_segments", ["deltas"], f"""
SELECT model_name, model_version, segment_column, segment_value AS segment,
  round(candidate_rmse, 2) AS candidate_rmse, round(champion_rmse, 2) AS champion_rmse,
  {signed_pct('rmse_delta_pct')} AS delta_pct,
  row_number() OVER (PARTITION BY model_name, model_version, segment_column
                     ORDER BY rmse_delta_pct DESC, pos, candidate_rmse, segment_value) AS rank
FROM deltas WHERE segment_column = 'town'""")


@query("segment_tail")
def q_segment_tail(spark, sf_dir):
    t = RK.segment_tail(gate_job(spark, sf_dir).segments, 10)
    return t.select("model_name", "model_version", "segment_column", "segment", r("rmse", 4), "rank")


oracle("segment_tail", ["evaluation"], """
SELECT model_name, model_version, segment_column, segment, round(rmse, 4) AS rmse, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY model_name, model_version, segment_column ORDER BY rmse DESC, segment) AS rank
  FROM evaluation WHERE segment_column IS NOT NULL) WHERE rank <= 10""")


# --- judge context ----------------------------------------------------------------------
@query("judge_context")
def q_judge_context(spark, sf_dir):
    j = gate_job(spark, sf_dir)
    return K.judge_context(j.report_input).select("model_name", "model_version", "judge_context")


cte("worst3", ["deltas"], f"""
  SELECT model_name, model_version,
    list({sql_fill(T.JUDGE_CONTEXT_SEGMENT, column='segment_column', value='segment_value', pct=signed_pct('rmse_delta_pct'))} ORDER BY rk) AS lines
  FROM (SELECT *, row_number() OVER (PARTITION BY model_name, model_version ORDER BY rmse_delta_pct DESC, pos, candidate_rmse, segment_value) AS rk
        FROM deltas) WHERE rk <= 3 GROUP BY ALL""")

oracle("judge_context", ["verdict", "drift_block", "worst3"], f"""
SELECT v.model_name AS model_name, v.model_version AS model_version, array_to_string(
  [{q(T.JUDGE_CONTEXT_TITLE)}, {sql_fill(T.JUDGE_CONTEXT_CANDIDATE, rmse=thousands('v.rmse'), mae=thousands('v.mae'))}]
  || CASE WHEN v.has_champion THEN [{sql_fill(T.JUDGE_CONTEXT_CHAMPION, rmse=thousands('v.champion_rmse'), mae=thousands('v.champion_mae'))}]
          ELSE [{q(T.JUDGE_CONTEXT_NO_CHAMPION)}] END
  || [{sql_fill(T.JUDGE_CONTEXT_VERDICT, decision='v.decision')}]
  || CASE WHEN len(v.reasons_list) > 0 THEN [{sql_fill(T.JUDGE_CONTEXT_REASONS, reasons="array_to_string(v.reasons_list, '; ')")}] ELSE {E} END
  || [{sql_fill(T.JUDGE_CONTEXT_PASSED, checks="array_to_string(v.passed_list, ', ')")},
      {sql_fill(T.JUDGE_CONTEXT_FAILED, checks="array_to_string(v.failed_list, ', ')")}]
  || CASE WHEN db.model_name IS NOT NULL THEN
       [{sql_fill(T.JUDGE_CONTEXT_DRIFT, flag="CASE WHEN db.any_drift THEN 'True' ELSE 'False' END")}]
       || CASE WHEN db.n_drifted > 0 THEN [{sql_fill(T.JUDGE_CONTEXT_DRIFTED, columns='db.names')}] ELSE {E} END
     ELSE {E} END
  || CASE WHEN w.lines IS NOT NULL THEN [{q(T.JUDGE_CONTEXT_WORST)}] || w.lines ELSE {E} END,
  chr(10)) AS judge_context
FROM verdict v LEFT JOIN drift_block db ON db.model_name = v.model_name
LEFT JOIN worst3 w ON w.model_name = v.model_name AND w.model_version = v.model_version""")


# --- report parsing (whole documents), coercion, checks ----------------------------------
def _alias_case(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = {q(k)} THEN {q(v)}" for k, v in SECTION_ALIASES.items()) + " END"


def sql_parse_sections(src: str, key: str, text: str) -> str:
    """Section parse of (key, text) rows in ``src`` (one output row per key)."""
    t = "trim(line)"
    k = (f"CASE WHEN {t} = '' THEN NULL ELSE coalesce({_alias_case(f'lower({t})')}, "
         f"CASE WHEN starts_with({t}, '#') THEN {_alias_case(f'lower(trim(ltrim({t}, {q(chr(35))})))')} END, "
         f"CASE WHEN ends_with({t}, ':') THEN {_alias_case(f'lower(trim(left({t}, length({t}) - 1)))')} END) END")

    def agg(section: str, sep: str, strip_bullet: bool = False) -> str:
        item = f"CASE WHEN starts_with({t}, '- ') THEN trim(substr({t}, 3)) ELSE {t} END" if strip_bullet else t
        cond = f"sec = '{section}'" if section != "intro" else "sec IS NULL"
        return f"string_agg({item}, {q(sep)} ORDER BY ord) FILTER (WHERE {cond} AND k IS NULL AND {t} <> '')"

    return f"""
  SELECT {key}, any_value(src_text) AS src_text,
    {agg('summary', ' ')} AS summary_s, {agg('intro', ' ')} AS intro_s,
    {agg('evidence', chr(10), True)} AS evidence, {agg('risk_flags', chr(10), True)} AS risk_flags,
    {agg('market_context', chr(10))} AS market_context, {agg('recommendation', ' ')} AS recommendation,
    {agg('citations', chr(10), True)} AS citations
  FROM (
    SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sec
    FROM (SELECT *, {k} AS k FROM (
      SELECT {key}, {text} AS src_text, unnest(string_split({text}, chr(10))) AS line,
             generate_subscripts(string_split({text}, chr(10)), 1) AS ord FROM {src})))
  GROUP BY {key}"""


def _parsed_view(spark_struct):
    return [
        spark_struct["summary"].alias("summary"),
        F.array_join(spark_struct["evidence"], "\n").alias("evidence"),
        F.array_join(spark_struct["risk_flags"], "\n").alias("risk_flags"),
        spark_struct["market_context"].alias("market_context"),
        spark_struct["recommendation"].alias("recommendation"),
        F.array_join(spark_struct["citations"], "\n").alias("citations"),
    ]


_PARSED_SELECT = f"""
  coalesce(nullif(trim(coalesce(summary_s, '')), ''), nullif(trim(coalesce(intro_s, '')), ''), {sql_strip('src_text')}) AS summary,
  coalesce(evidence, '') AS evidence, coalesce(risk_flags, '') AS risk_flags, coalesce(market_context, '') AS market_context,
  trim(coalesce(recommendation, '')) AS recommendation, coalesce(citations, '') AS citations"""


@query("parse_reports")
def q_parse_reports(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents
    return K.parse_reports(docs, "text", "p").select("doc_id", *_parsed_view(F.col("p")))


cte("doc_sections", [], sql_parse_sections("documents", "doc_id", "text"))
oracle("parse_reports", ["doc_sections"], f"SELECT doc_id, {_PARSED_SELECT} FROM doc_sections")


@query("coerce_reports")
def q_coerce_reports(spark, sf_dir):
    rep = gate_job(spark, sf_dir).reports
    return K.coerce_reports(rep, "report", "p").select("model_name", "model_version", *_parsed_view(F.col("p")))


cte("report_sections", ["reports"], sql_parse_sections(
    "(SELECT model_name || chr(1) || model_version AS rid, report FROM reports)", "rid", "report"))
oracle("coerce_reports", ["report_sections"], f"""
SELECT split_part(rid, chr(1), 1) AS model_name, split_part(rid, chr(1), 2) AS model_version, {_PARSED_SELECT}
FROM report_sections""")


def _enriched(spark, sf_dir):
    rep = gate_job(spark, sf_dir).reports
    return K.enrich_reports(K.coerce_reports(rep, "report", "structured"), "structured", "enriched")


@query("enrich_reports")
def q_enrich_reports(spark, sf_dir):
    e = _enriched(spark, sf_dir)
    return e.select("model_name", "model_version", *_parsed_view(F.col("enriched")))


@query("render_markdown")
def q_render_markdown(spark, sf_dir):
    e = _enriched(spark, sf_dir)
    return e.select("model_name", "model_version", K.render_markdown(F.col("enriched")).alias("markdown"))


_SECTIONS_REQUIRED = ["## Summary", "## Evidence", "## Risk Flags", "## Recommendation"]


@query("report_checks")
def q_report_checks(spark, sf_dir):
    rep = gate_job(spark, sf_dir).reports
    must = F.array(F.col("decision"), X.thousands(F.col("rmse")))
    must_not = F.array(F.lit("Traceback"), F.lit("OPENAI_API_KEY not set"))
    sections = F.array(*[F.lit(s) for s in _SECTIONS_REQUIRED])
    c = K.report_checks(F.col("report"), must, must_not, sections)
    return rep.select("model_name", "model_version", c["passed"].alias("passed"),
                      F.array_join(c["missing"], "|").alias("missing"), F.array_join(c["forbidden"], "|").alias("forbidden"),
                      F.array_join(c["missing_sections"], "|").alias("missing_sections"))


oracle("report_checks", ["reports", "verdict"], f"""
SELECT model_name, model_version,
  contains(report, decision) AND contains(report, {thousands('rmse')}) AND NOT contains(report, 'Traceback')
    AND NOT contains(report, 'OPENAI_API_KEY not set')
    AND {' AND '.join(f"contains(lower(report), lower({q(s)}))" for s in _SECTIONS_REQUIRED)} AS passed,
  array_to_string(list_filter([decision, {thousands('rmse')}], lambda m: NOT contains(report, m)), '|') AS missing,
  array_to_string(list_filter(['Traceback', 'OPENAI_API_KEY not set'], lambda m: contains(report, m)), '|') AS forbidden,
  array_to_string(list_filter([{', '.join(q(s) for s in _SECTIONS_REQUIRED)}], lambda m: NOT contains(lower(report), lower(m))), '|')
    AS missing_sections
FROM reports JOIN verdict USING (model_name, model_version)""")


@query("evidence_lookup")
def q_evidence_lookup(spark, sf_dir):
    """Evidence a reviewer or tool queries per candidate: candidate metrics,
    champion metrics (or the no-champion text), the verdict and the drift
    report (4-decimal statistics), as JSON."""
    v = gate_job(spark, sf_dir).verdicts
    cand = F.to_json(F.struct(F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae")))
    champ = F.when(F.col("has_champion"), F.to_json(F.struct(F.round("champion_rmse", 4).alias("rmse"),
                                                              F.round("champion_mae", 4).alias("mae")))).otherwise(
        F.lit(T.NO_CHAMPION_LOOKUP))
    verdict = F.to_json(F.struct("decision", "reasons", "checks_passed", "checks_failed"))
    # drift evidence: statistic and p-value at 4 decimals (half-even), p-value only when there is one
    columns = F.transform("column_results", lambda r: F.struct(
        r["column"].alias("column"), r["drift_type"].alias("type"), F.bround(r["statistic"], 4).alias("statistic"),
        r["threshold"].alias("threshold"), r["is_drifted"].alias("is_drifted"), F.bround(r["p_value"], 4).alias("p_value")))
    drift_json = F.to_json(F.struct(F.col("overall_drift_detected").alias("overall_drift_detected"), columns.alias("columns")))
    # After 4-decimal rounding the only numbers the JSON writer puts in
    # exponent form are k * 1e-4 ("4.0E-4"); write them as plain decimals.
    drift_json = F.regexp_replace(drift_json, r"(?<=:)([1-9])\.0E-4(?=[,}])", "0.000$1")
    drift = F.when(F.coalesce(F.col("has_drift_report"), F.lit(False)), drift_json)
    drift = drift.otherwise(F.lit(T.NO_DRIFT_LOOKUP))
    return v.select("model_name", "model_version", cand.alias("candidate_metrics"), champ.alias("champion_metrics"),
                    verdict.alias("policy_verdict"), drift.alias("drift_report"))


cte("drift_json", ["drift_rows"], """
  SELECT model_name, CAST(json_object('overall_drift_detected', bool_or(is_drifted), 'columns', list(
    CASE WHEN p_value IS NULL
      THEN json_object('column', "column", 'type', drift_type, 'statistic', round(statistic, 4),
                       'threshold', threshold, 'is_drifted', is_drifted)
      ELSE json_object('column', "column", 'type', drift_type, 'statistic', round(statistic, 4),
                       'threshold', threshold, 'is_drifted', is_drifted, 'p_value', round(p_value, 4)) END
    ORDER BY ord)) AS VARCHAR) AS drift_report
  FROM drift_rows GROUP BY model_name""")

oracle("evidence_lookup", ["verdict", "drift_json"], """
SELECT model_name, model_version,
  CAST(to_json({'rmse': round(rmse, 4), 'mae': round(mae, 4)}) AS VARCHAR) AS candidate_metrics,
  CASE WHEN has_champion THEN CAST(to_json({'rmse': round(champion_rmse, 4), 'mae': round(champion_mae, 4)}) AS VARCHAR)
       ELSE """ + q(T.NO_CHAMPION_LOOKUP) + """ END AS champion_metrics,
  CAST(to_json({'decision': decision, 'reasons': reasons_list, 'checks_passed': passed_list,
                'checks_failed': failed_list}) AS VARCHAR) AS policy_verdict,
  coalesce(dj.drift_report, """ + q(T.NO_DRIFT_LOOKUP) + """) AS drift_report
FROM verdict LEFT JOIN drift_json dj USING (model_name)""")


# --- judge scores (stand-in judge responses from conversation rows) -------------------------
def judge_responses(spark, sf_dir):
    """Stand-in judge answers in the four shapes a judge produces: a JSON
    object, 'name: n' lines, 'name=n' pairs missing one key, and free text."""
    c = Tables(spark, sf_dir).conversations
    n = F.length("text")
    s = [((n + k) % 5 + 1).cast("string") for k in range(4)]
    form = (F.col("conv_id") + F.col("turn")) % 4
    text = (
        F.when(form == 0, F.concat(F.lit('{"completeness": '), s[0], F.lit(', "accuracy": '), s[1],
                                   F.lit(', "actionability": '), s[2], F.lit(', "safety": '), s[3], F.lit("}")))
        .when(form == 1, F.concat(F.lit("completeness: "), s[0], F.lit("\naccuracy: "), s[1], F.lit("\nactionability: "), s[2],
                                  F.lit("\nsafety: "), s[3], F.lit("\n"), F.col("text")))
        .when(form == 2, F.concat(F.lit("completeness="), s[0], F.lit(", accuracy="), s[1], F.lit(", actionability="), s[2]))
        .otherwise(F.col("text"))
    )
    return c.select("conv_id", "turn", "role", text.alias("response"))


def _scores(spark, sf_dir):
    return K.score_judgements(judge_responses(spark, sf_dir), "response", "s").select("conv_id", "turn", "role", "s")


@query("judge_scores")
def q_judge_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select("conv_id", "turn", "s.*")


_SQL_N = "length(text)"
cte("judge_responses", [], f"""
  SELECT conv_id, turn, role, CASE (conv_id + turn) % 4
    WHEN 0 THEN '{{"completeness": ' || ({_SQL_N} % 5 + 1) || ', "accuracy": ' || (({_SQL_N} + 1) % 5 + 1)
              || ', "actionability": ' || (({_SQL_N} + 2) % 5 + 1) || ', "safety": ' || (({_SQL_N} + 3) % 5 + 1) || '}}'
    WHEN 1 THEN 'completeness: ' || ({_SQL_N} % 5 + 1) || chr(10) || 'accuracy: ' || (({_SQL_N} + 1) % 5 + 1) || chr(10)
              || 'actionability: ' || (({_SQL_N} + 2) % 5 + 1) || chr(10) || 'safety: ' || (({_SQL_N} + 3) % 5 + 1) || chr(10) || text
    WHEN 2 THEN 'completeness=' || ({_SQL_N} % 5 + 1) || ', accuracy=' || (({_SQL_N} + 1) % 5 + 1)
              || ', actionability=' || (({_SQL_N} + 2) % 5 + 1)
    ELSE text END AS response
  FROM conversations""")

_KEYS = ["completeness", "accuracy", "actionability", "safety"]
_PAT = T.JUDGE_SCORE_PATTERN


def _sql_score(k: str) -> str:
    regex_val = (f"list_filter(list_zip(regexp_extract_all(response, '{_PAT}', 1), regexp_extract_all(response, '{_PAT}', 2)), "
                 f"lambda p: p[1] = '{k}')[-1][2]")
    return f"CASE WHEN json_valid(response) AND starts_with(trim(response), '{{') THEN TRY_CAST(json_extract_string(response, '$.{k}') AS INTEGER) ELSE TRY_CAST({regex_val} AS INTEGER) END"


cte("judge_parsed", ["judge_responses"], f"""
  SELECT conv_id, turn, role, {', '.join(f'{_sql_score(k)} AS {k}' for k in _KEYS)},
    json_valid(response) AND starts_with(trim(response), '{{') AS is_json,
    len(regexp_extract_all(response, '{_PAT}', 1)) > 0 AS any_match
  FROM judge_responses""")

cte("judge_scored", ["judge_parsed"], f"""
  SELECT *, CASE WHEN NOT is_json AND NOT any_match THEN {q(T.JUDGE_NOT_OBJECT.format(kind='str'))}
    {' '.join(f"WHEN {k} IS NULL THEN {q(T.JUDGE_MISSING_KEY.format(key=k))} " for k in _KEYS)} END AS error
  FROM judge_parsed""")

oracle("judge_scores", ["judge_scored"], f"""
SELECT conv_id, turn, {', '.join(f'CASE WHEN error IS NULL THEN {k} END AS {k}' for k in _KEYS)},
  CASE WHEN error IS NULL THEN ({' + '.join(_KEYS)}) / 4.0 END AS average, error
FROM judge_scored""")


@query("judge_average")
def q_judge_average(spark, sf_dir):
    s = _scores(spark, sf_dir).select("role", "s.*")
    out = K.judge_average(s, ["role"])
    return out.select("role", "scored", *[r(c, 6) for c in out.columns if c.startswith("avg_")])


oracle("judge_average", ["judge_scored"], f"""
SELECT role, count(*) AS scored, {', '.join(f'round(avg({k}), 6) AS avg_{k}' for k in _KEYS)},
  round(avg(({' + '.join(_KEYS)}) / 4.0), 6) AS avg_average
FROM judge_scored WHERE error IS NULL GROUP BY role""")


@query("judge_metrics")
def q_judge_metrics(spark, sf_dir):
    s = _scores(spark, sf_dir)
    payload = F.to_json(F.struct(
        F.when(F.col("s.error").isNull(), F.lit("scored")).otherwise(F.lit("error")).alias("status"),
        F.struct(*[F.col(f"s.{k}").alias(k) for k in [*_KEYS, "average"]]).alias("scores"),
    ))
    p = s.select("conv_id", "turn", payload.alias("judge_evaluation"))
    return R.judge_metrics(p).select("conv_id", "turn", "metric", r("value", 6))


oracle("judge_metrics", ["judge_scored"], f"""
SELECT conv_id, turn, metric, round(value, 6) AS value FROM (
  SELECT conv_id, turn, {', '.join(f'CAST({k} AS DOUBLE) AS judge_{k}' for k in _KEYS)},
         ({' + '.join(_KEYS)}) / 4.0 AS judge_average
  FROM judge_scored WHERE error IS NULL)
UNPIVOT (value FOR metric IN ({', '.join(f'judge_{k}' for k in _KEYS)}, judge_average))""")


@query("extract_json")
def q_extract_json(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    m = K.extract_json(F.col("props"), brace_span=True)
    return ev.select("event_id", F.explode(m).alias("key", "value"))


oracle("extract_json", [], """
SELECT event_id, key, json_extract_string(props, '$."' || key || '"') AS value
FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events WHERE json_valid(props))""")


# --- message logs ------------------------------------------------------------------------------
def messages(spark, sf_dir):
    """Stand-in agent log: assistant turns 1, 5, 9, ... call one tool; user
    turns 2, 6, 10, ... are tool results naming the previous turn's call id
    (which may not exist); odd turns carry their text as a JSON list of
    parts."""
    c = Tables(spark, sf_dir).conversations
    call_id = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    tool = F.concat(F.lit("tool_"), (F.length("text") % 3).cast("string"))
    content = F.when(F.col("turn") % 2 == 1, F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))))\
        .otherwise(F.col("text"))
    is_tool = (F.col("role") == "user") & (F.col("turn") % 4 == 2)
    calls = (F.col("role") == "assistant") & (F.col("turn") % 4 == 1)
    return c.select(
        "conv_id", F.col("turn").alias("pos"),
        F.when(F.col("role") == "assistant", F.lit("ai")).when(is_tool, F.lit("tool"))
        .when(F.col("role") == "user", F.lit("human")).otherwise(F.col("role")).alias("type"),
        content.alias("content"),
        F.when(calls, F.array(F.struct(call_id.alias("id"), tool.alias("name"), F.struct(
            F.col("turn").cast("long").alias("turn"), F.length("text").cast("long").alias("length")).alias("args")))).alias("tool_calls"),
        F.when(is_tool, F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))).alias("tool_call_id"),
        F.lit(None).cast("string").alias("name"),
    )


cte("msgs", [], """
  SELECT conv_id, turn AS pos, role, text,
    CASE WHEN role = 'assistant' THEN 'ai' WHEN role = 'user' AND turn % 4 = 2 THEN 'tool' WHEN role = 'user' THEN 'human' ELSE role END AS type,
    CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) END AS call_id,
    CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN 'tool_' || CAST(length(text) % 3 AS VARCHAR) END AS call_name,
    CASE WHEN role = 'user' AND turn % 4 = 2 THEN CAST(conv_id AS VARCHAR) || '-' || CAST(turn - 1 AS VARCHAR) END AS result_of
  FROM conversations""")


@query("message_text")
def q_message_text(spark, sf_dir):
    m = messages(spark, sf_dir)
    return m.select("conv_id", "pos", K.message_text(F.col("content")).alias("text"))


oracle("message_text", ["msgs"], f"SELECT conv_id, pos, {sql_strip('text')} AS text FROM msgs")


@query("final_message")
def q_final_message(spark, sf_dir):
    m = messages(spark, sf_dir).where(F.col("type") != "tool")
    brief = Tables(spark, sf_dir).conversations.where(F.col("turn") == 0).select(
        "conv_id", X.strip_text(F.col("text")).alias("brief"))
    return K.final_message(m.join(brief, "conv_id", "left"), F.col("brief"))


oracle("final_message", ["msgs"], f"""
SELECT m.conv_id, arg_max({sql_strip('m.text')}, m.pos) AS final_text
FROM msgs m LEFT JOIN (SELECT conv_id, {sql_strip('text')} AS brief FROM conversations WHERE turn = 0) b USING (conv_id)
WHERE m.type <> 'tool' AND m.call_id IS NULL AND {sql_strip('m.text')} <> '' AND {sql_strip('m.text')} <> coalesce(b.brief, '')
GROUP BY m.conv_id""")


@query("trace_events")
def q_trace_events(spark, sf_dir):
    ev = K.trace_events(messages(spark, sf_dir))
    return ev.select("event", "conv_id", "message_index", "tool_call_id", "tool_name", "tool_args", "content")


cte("trace", ["msgs"], """
  SELECT 'tool_call' AS event, conv_id, pos AS message_index, call_id AS tool_call_id, call_name AS tool_name,
    printf('{"turn":%d,"length":%d}', pos, length(text)) AS tool_args, CAST(NULL AS VARCHAR) AS content
  FROM msgs WHERE call_id IS NOT NULL
  UNION ALL
  SELECT 'tool_result', r.conv_id, r.pos, r.result_of, c.call_name, NULL, regexp_replace(coalesce(r.text, ''), '^\\s+|\\s+$', '', 'g')
  FROM msgs r LEFT JOIN msgs c ON c.conv_id = r.conv_id AND c.call_id = r.result_of AND c.pos <= r.pos
  WHERE r.type = 'tool'""")
oracle("trace_events", ["trace"], "SELECT * FROM trace")


@query("trace_stats")
def q_trace_stats(spark, sf_dir):
    ev = K.trace_events(messages(spark, sf_dir))
    st = K.trace_stats(ev)
    return st.select("conv_id", "tool_call_count", "tool_result_count",
                     F.array_join("unique_tools_used", ",").alias("unique_tools_used"))


oracle("trace_stats", ["trace"], """
SELECT conv_id, count(*) FILTER (WHERE event = 'tool_call') AS tool_call_count,
  count(*) FILTER (WHERE event = 'tool_result') AS tool_result_count,
  coalesce(array_to_string(list_sort(list_distinct(list(tool_name) FILTER (WHERE tool_name IS NOT NULL))), ','), '') AS unique_tools_used
FROM trace GROUP BY conv_id""")


# --- sets ----------------------------------------------------------------------------------------
def _lang(url):
    return F.regexp_extract(url, r"^[a-z]+://[^/]+/([a-z]{2})/", 1)


@query("dedupe_urls")
def q_dedupe_urls(spark, sf_dir):
    p = Tables(spark, sf_dir).pages
    return S.dedupe_urls(p.select(_lang(F.col("url")).alias("lang"), "page_id", "url"), ["lang"], "page_id")


oracle("dedupe_urls", [], r"""
SELECT lang, url, min(page_id) AS first_seen FROM (
  SELECT regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})/', 1) AS lang, page_id, trim(url) AS url FROM pages)
WHERE url <> '' GROUP BY lang, url""")


@query("unique_lines")
def q_unique_lines(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    lines = d.select("doc_id", F.posexplode(K.split_lines(F.col("text"))).alias("ord", "line")).withColumn(
        "ord", F.col("ord").cast("long"))
    return S.unique_lines(lines, ["doc_id"], "ord")


oracle("unique_lines", [], """
SELECT doc_id, arg_min(line, ord) AS line, min(ord) AS ord FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord
  FROM documents)
WHERE trim(line) <> '' GROUP BY doc_id, lower(trim(line))""")


def _search_results(spark, sf_dir):
    """Pages as search results: the language is the query, the scheme the provider."""
    p = Tables(spark, sf_dir).pages
    provider = F.regexp_extract("url", "^([a-z]+)://", 1)
    return p.select(
        _lang(F.col("url")).alias("lang"), provider.alias("provider"),
        F.when(provider == "http", 0).otherwise(1).alias("provider_order"), "page_id",
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), "url",
    )


@query("merge_sources")
def q_merge_sources(spark, sf_dir):
    """Every page in its place in the merged list of its language; the first
    result of each url has a place in the list of sources."""
    merged = S.merge_results(_search_results(spark, sf_dir), ["lang"], "provider_order", "page_id")
    sources = S.merged_sources(merged, ["lang"]).select("lang", F.col("first_seen").alias("place"), "source_place")
    return merged.join(sources, ["lang", "place"], "left").select("lang", "place", "provider", "page_id", "title", "url", "source_place")


_RESULTS = r"""(
  SELECT regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})/', 1) AS lang, regexp_extract(url, '^([a-z]+)://', 1) AS provider,
         page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, url, trim(url) AS clean FROM pages)"""
oracle("merge_sources", [], f"""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN provider = 'http' THEN 0 ELSE 1 END, page_id) AS place
           FROM {_RESULTS}),
f AS (SELECT lang, min(place) AS place FROM m WHERE clean <> '' GROUP BY lang, clean),
s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY place) AS source_place FROM f)
SELECT m.lang, m.place, m.provider, m.page_id, m.title, m.url, s.source_place
FROM m LEFT JOIN s ON s.lang = m.lang AND s.place = m.place""")


def _payloads(spark, sf_dir):
    """A provider's answer to a query: its first title, the results that have none
    as its error, the host of its first result as its model."""
    untitled = F.count_if(F.col("title") == "")
    host = F.min_by(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), "page_id")
    return _search_results(spark, sf_dir).groupBy("lang", "provider", "provider_order").agg(
        F.min_by("title", "page_id").alias("summary"),
        F.when(untitled > 0, F.format_string("%d results without a title", untitled)).alias("error"),
        host.alias("model"),
    )


@query("merge_payloads")
def q_merge_payloads(spark, sf_dir):
    m = S.merge_payloads(_payloads(spark, sf_dir), ["lang"], "provider_order")
    return m.select("lang", "n_providers", "provider", F.array_join("providers_used", ",").alias("providers_used"), "summary",
                    F.array_join("errors", " | ").alias("errors"), F.array_join("models", ",").alias("models"))


oracle("merge_payloads", [], f"""
SELECT lang, count(*) AS n_providers, CASE WHEN count(*) = 1 THEN any_value(provider) ELSE 'both' END AS provider,
  string_agg(provider, ',' ORDER BY provider_order) AS providers_used,
  CASE WHEN count(*) = 1 THEN any_value(summary)
       ELSE coalesce(string_agg(CASE WHEN summary <> '' THEN provider || ': ' || summary END, chr(10) || chr(10) ORDER BY provider_order), '') END AS summary,
  coalesce(string_agg(CASE WHEN untitled > 0 THEN provider || ': ' || untitled || ' results without a title' END, ' | ' ORDER BY provider_order), '') AS errors,
  coalesce(string_agg(CASE WHEN model <> '' THEN model END, ',' ORDER BY provider_order), '') AS models
FROM (
  SELECT lang, provider, CASE WHEN provider = 'http' THEN 0 ELSE 1 END AS provider_order, trim(arg_min(title, page_id)) AS summary,
         count(*) FILTER (WHERE title = '') AS untitled, arg_min(regexp_extract(url, '^[a-z]+://([^/]+)', 1), page_id) AS model
  FROM {_RESULTS} GROUP BY lang, provider)
GROUP BY lang""")


# --- oracles for the back-fill (K5) and markdown rendering (K6) ------------------------------
def _unique_append(existing: str, new: str) -> str:
    return (f"{existing} || list_filter({new}, lambda x: trim(x) <> '' AND NOT list_contains("
            f"list_transform({existing}, lambda e: lower(trim(e))), lower(trim(x))))")


def _lines(col: str) -> str:
    return f"list_filter(string_split(coalesce({col}, ''), chr(10)), lambda x: x <> '')"


_NEW_EVIDENCE = f"""
  [{sql_fill(T.EVIDENCE_CANDIDATE_RMSE, rmse=thousands('v.rmse'))}, {sql_fill(T.EVIDENCE_CANDIDATE_MAE, mae=thousands('v.mae'))}]
  || CASE WHEN v.has_champion THEN
       [{sql_fill(T.EVIDENCE_CHAMPION_RMSE, rmse=thousands('v.champion_rmse'))},
        {sql_fill(T.EVIDENCE_CHAMPION_MAE, mae=thousands('v.champion_mae'))},
        {sql_fill(T.EVIDENCE_RMSE_DELTA, delta=_DELTA_ABS, pct=_DELTA_PCT)}]
       || CASE WHEN s3.inline IS NOT NULL THEN
            [{sql_fill(T.EVIDENCE_SEGMENTS, prefix=_PREFIX.format(a='s3.any_regress'), segments='s3.inline')}]
          ELSE {E} END
     ELSE [{q(T.NO_CHAMPION_EVIDENCE)}] END
  || CASE WHEN db.model_name IS NULL THEN [{q(T.NO_DRIFT_REPORT)}]
          WHEN db.n_drifted > 0 THEN [{sql_fill(T.DRIFT_FOUND, columns='db.names')}]
          ELSE [{q(T.NO_DRIFT_FOUND)}] END
  || CASE WHEN len(v.passed_list) > 0 THEN [{sql_fill(T.CHECKS_PASSED, checks=sql_humanize('v.passed_list'))}] ELSE {E} END"""
_NEW_RISKS = f"""
  CASE WHEN len(v.failed_list) > 0 THEN [{sql_fill(T.CHECKS_FAILED, checks=sql_humanize('v.failed_list'))}] ELSE {E} END || v.reasons_list"""

cte("enriched", ["report_sections", "verdict", "seg_top3", "drift_block"], f"""
  SELECT v.model_name, v.model_version, v.has_champion,
    coalesce(nullif(trim(coalesce(rs.summary_s, '')), ''), nullif(trim(coalesce(rs.intro_s, '')), ''), {sql_strip('rs.src_text')}) AS summary,
    {_unique_append(_lines('rs.evidence'), _NEW_EVIDENCE)} AS evidence_list,
    {_unique_append(_lines('rs.risk_flags'), _NEW_RISKS)} AS risk_list,
    coalesce(rs.market_context, '') AS market_context, trim(coalesce(rs.recommendation, '')) AS recommendation,
    {_lines('rs.citations')} AS citation_list
  FROM verdict v
  JOIN report_sections rs ON rs.rid = v.model_name || chr(1) || v.model_version
  LEFT JOIN seg_top3 s3 ON s3.model_name = v.model_name AND s3.model_version = v.model_version
  LEFT JOIN drift_block db ON db.model_name = v.model_name""")


def _wording(x: str) -> str:
    return (f"CASE WHEN has_champion THEN {x} ELSE regexp_replace(regexp_replace({x}, 'C(?i:hampion)', 'Baseline', 'g'), "
            f"'(?i)champion', 'baseline', 'g') END")


cte("enriched_final", ["enriched"], f"""
  SELECT model_name, model_version, {_wording('summary')} AS summary,
    list_transform(evidence_list, lambda x: {_wording('x')}) AS evidence_list,
    list_transform(CASE WHEN len(risk_list) > 0 THEN risk_list ELSE [{q(T.NO_MAJOR_RISKS)}] END,
                   lambda x: {_wording('x')}) AS risk_list,
    {_wording('market_context')} AS market_context, {_wording('recommendation')} AS recommendation, citation_list
  FROM enriched""")

oracle("enrich_reports", ["enriched_final"], """
SELECT model_name, model_version, summary, array_to_string(evidence_list, chr(10)) AS evidence,
  array_to_string(risk_list, chr(10)) AS risk_flags, market_context, recommendation,
  array_to_string(citation_list, chr(10)) AS citations
FROM enriched_final""")

oracle("render_markdown", ["enriched_final"], f"""
SELECT model_name, model_version, array_to_string(
  [{q(T.H_SUMMARY)}, CASE WHEN summary <> '' THEN summary ELSE {q(T.MARKDOWN_DEFAULTS['summary'])} END, '', {q(T.H_EVIDENCE)}]
  || list_transform(CASE WHEN len(evidence_list) > 0 THEN evidence_list ELSE [{q(T.MARKDOWN_DEFAULTS['evidence'])}] END, lambda x: '- ' || x)
  || ['', {q(T.H_RISKS)}]
  || list_transform(CASE WHEN len(risk_list) > 0 THEN risk_list ELSE [{q(T.MARKDOWN_DEFAULTS['risk_flags'])}] END, lambda x: '- ' || x)
  || ['', {q(T.H_MARKET)}, CASE WHEN market_context <> '' THEN market_context ELSE {q(T.MARKDOWN_DEFAULTS['market_context'])} END,
      '', {q(T.H_RECOMMENDATION)},
      CASE WHEN recommendation <> '' THEN recommendation ELSE {q(T.MARKDOWN_DEFAULTS['recommendation'])} END]
  || CASE WHEN len(citation_list) > 0 THEN ['', {q(T.H_SOURCES)}] || list_transform(citation_list, lambda x: '- ' || x) ELSE {E} END,
  chr(10)) AS markdown
FROM enriched_final""")
