"""DuckDB oracle SQL for the registered queries.

Each oracle is an independent, set-based re-statement of a query's meaning
over the same parquet tables. Shared steps are named CTEs with declared
dependencies; ``with_ctes`` emits only what a query needs, in order.
"""

from __future__ import annotations

from modelgate.schema import (
    CATEGORICAL_FEATURES,
    DEFAULT_KS_ALPHA,
    DEFAULT_PSI_THRESHOLD,
    NUMERIC_FEATURES,
    PSI_EPSILON,
)
from modelgate import fixed as T
from modelgate.sources.adapters import MODEL_NAME, PREDICTION_FORMULAS

CHAMPION_VERSION = "1"
SEGMENT_COLUMNS = ["town", "flat_type"]

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], sql: str) -> None:
    CTES[name] = (deps, sql)


def with_ctes(needed: list[str], select: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in needed:
        visit(n)
    if not order:
        return select
    body = ",\n".join(f"{n} AS (\n{CTES[n][1]}\n)" for n in order)
    return f"WITH {body}\n{select}"


# --- fixed-text templates in SQL ---------------------------------------------
def sql_str(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_fill(template: str, **exprs: str) -> str:
    """SQL concatenation of a fixed-text template with ``{name}`` slots."""
    import re

    parts, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            parts.append(sql_str(template[pos:m.start()]))
        parts.append(f"({exprs[m.group(1)]})")
        pos = m.end()
    if pos < len(template):
        parts.append(sql_str(template[pos:]))
    return " || ".join(parts)


# --- formatting helpers (Python format-spec equivalents) -------------------
def thousands(x: str) -> str:
    return f"printf('%,.0f', {x})"


def signed_thousands(x: str) -> str:
    return f"printf('%+,.0f', {x})"


def pct(x: str, digits: int = 1) -> str:
    return f"printf('%.{digits}f%%', ({x}) * 100)"


def signed_pct(x: str, digits: int = 1) -> str:
    return f"printf('%+.{digits}f%%', ({x}) * 100)"


# --- stand-in source ---------------------------------------------------------
_preds = ",\n".join(f"    {f} AS prediction_{v}" for v, f in PREDICTION_FORMULAS.items())

cte("src", [], r"""
  SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, l.l_extendedprice, o.o_orderdate,
         p.p_type, p.p_size, p.p_retailprice, c.c_nationkey, c.c_mktsegment, n.n_name
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey""")

cte("raw", ["src"], r"""
  SELECT strftime(o_orderdate, '%Y-%m') AS month, n_name AS town, c_mktsegment AS flat_type,
    p_type AS flat_model,
    CASE WHEN l_orderkey % 97 = 0 THEN ''
         ELSE lpad(CAST(p_size AS VARCHAR), 2, '0') || ' TO ' || lpad(CAST(p_size + 2 AS VARCHAR), 2, '0') END AS storey_range,
    CASE WHEN l_orderkey % 89 = 0 THEN 'n/a' ELSE CAST(l_quantity AS VARCHAR) END AS floor_area_sqm,
    CAST(year(o_orderdate) - p_size AS VARCHAR) AS lease_commence_date,
    CASE l_orderkey % 5
      WHEN 0 THEN CAST(99 - p_size AS VARCHAR) || ' years ' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || ' months'
      WHEN 1 THEN CAST(99 - p_size AS VARCHAR) || ' years'
      WHEN 2 THEN CAST(l_linenumber AS VARCHAR) || ' months'
      WHEN 3 THEN CAST(99 - p_size AS VARCHAR) || '.5' END AS remaining_lease,
    CAST(l_extendedprice AS VARCHAR) AS resale_price,
""" + _preds + "\n  FROM src")

# --- split -------------------------------------------------------------------
cte("months", ["raw"], """
  SELECT m, row_number() OVER (ORDER BY m DESC) AS k
  FROM (SELECT DISTINCT date_trunc('month', strptime(month, '%Y-%m')) AS m FROM raw)""")

cte("split", ["raw", "months"], """
  SELECT raw.*, CASE WHEN k <= 12 THEN 'test' WHEN k <= 24 THEN 'validation' ELSE 'train' END AS split
  FROM raw JOIN months ON date_trunc('month', strptime(raw.month, '%Y-%m')) = months.m""")

# --- features ----------------------------------------------------------------
cte("typed", ["split"], r"""
  SELECT *,
    CAST(strptime(month, '%Y-%m') AS DATE) AS sale_month_v,
    TRY_CAST(resale_price AS DOUBLE) AS resale_price_v,
    TRY_CAST(floor_area_sqm AS DOUBLE) AS floor_area_sqm_v,
    (year(strptime(month, '%Y-%m')) + (month(strptime(month, '%Y-%m')) - 1) / 12.0)
      - TRY_CAST(lease_commence_date AS DOUBLE) AS flat_age_years_v,
    CASE WHEN lower(trim(remaining_lease)) IS NULL OR lower(trim(remaining_lease)) = '' THEN NULL
         WHEN regexp_extract(lower(trim(remaining_lease)), '(\d+)\s+year', 1) <> ''
           OR regexp_extract(lower(trim(remaining_lease)), '(\d+)\s+month', 1) <> ''
         THEN coalesce(TRY_CAST(NULLIF(regexp_extract(lower(trim(remaining_lease)), '(\d+)\s+year', 1), '') AS DOUBLE), 0.0)
            + coalesce(TRY_CAST(NULLIF(regexp_extract(lower(trim(remaining_lease)), '(\d+)\s+month', 1), '') AS DOUBLE), 0.0) / 12.0
         ELSE TRY_CAST(lower(trim(remaining_lease)) AS DOUBLE) END AS lease_parsed_v,
    CASE WHEN len(regexp_extract_all(upper(trim(storey_range)), '(\d+)', 1)) >= 2
           THEN (CAST(regexp_extract_all(upper(trim(storey_range)), '(\d+)', 1)[1] AS DOUBLE)
               + CAST(regexp_extract_all(upper(trim(storey_range)), '(\d+)', 1)[2] AS DOUBLE)) / 2.0
         WHEN len(regexp_extract_all(upper(trim(storey_range)), '(\d+)', 1)) = 1
           THEN CAST(regexp_extract_all(upper(trim(storey_range)), '(\d+)', 1)[1] AS DOUBLE)
    END AS storey_midpoint_v
  FROM split""")

_pred_cols = ", ".join(f"prediction_{v}" for v in PREDICTION_FORMULAS)
cte("prepared", ["typed"], f"""
  SELECT sale_month_v AS sale_month, resale_price_v AS resale_price, town, flat_type, flat_model, storey_range,
         floor_area_sqm_v AS floor_area_sqm, flat_age_years_v AS flat_age_years,
         coalesce(lease_parsed_v, 99.0 - flat_age_years_v) AS remaining_lease_years,
         storey_midpoint_v AS storey_midpoint, split, {_pred_cols}
  FROM typed
  WHERE resale_price_v IS NOT NULL AND town IS NOT NULL AND flat_type IS NOT NULL
    AND flat_model IS NOT NULL AND storey_range IS NOT NULL AND floor_area_sqm_v IS NOT NULL
    AND flat_age_years_v IS NOT NULL AND coalesce(lease_parsed_v, 99.0 - flat_age_years_v) IS NOT NULL
    AND storey_midpoint_v IS NOT NULL""")

# --- scoring and evaluation ----------------------------------------------------
cte("scored", ["prepared"], "\n  UNION ALL\n".join(
    f"  SELECT '{MODEL_NAME}' AS model_name, '{v}' AS model_version, resale_price, town, flat_type, "
    f"prediction_{v} AS prediction FROM prepared WHERE split = 'test'"
    for v in PREDICTION_FORMULAS
))

_metrics = """count(*) AS count,
    sqrt(avg((resale_price - prediction) * (resale_price - prediction))) AS rmse,
    avg(abs(resale_price - prediction)) AS mae, avg(resale_price) AS mean_actual,
    avg(prediction) AS mean_prediction"""

cte("evaluation", ["scored"], f"""
  SELECT model_name, model_version, CAST(NULL AS VARCHAR) AS segment_column, CAST(NULL AS VARCHAR) AS segment,
    {_metrics}
  FROM scored GROUP BY model_name, model_version
  UNION ALL
""" + "\n  UNION ALL\n".join(
    f"""  SELECT model_name, model_version, '{c}' AS segment_column, CAST({c} AS VARCHAR) AS segment, {_metrics}
  FROM scored WHERE {c} IS NOT NULL GROUP BY model_name, model_version, {c}"""
    for c in SEGMENT_COLUMNS
))

# --- comparison --------------------------------------------------------------
cte("overall", ["evaluation"], "  SELECT * FROM evaluation WHERE segment_column IS NULL")

cte("pairs", ["overall"], f"""
  SELECT c.model_name, c.model_version, c.rmse, c.mae,
    h.model_version AS champion_version, h.rmse AS champion_rmse, h.mae AS champion_mae,
    h.model_version IS NOT NULL AS has_champion,
    c.rmse - h.rmse AS rmse_delta,
    CASE WHEN h.rmse > 0 THEN (c.rmse - h.rmse) / h.rmse ELSE 0.0 END AS rmse_delta_pct,
    c.mae - h.mae AS mae_delta,
    CASE WHEN h.mae > 0 THEN (c.mae - h.mae) / h.mae ELSE 0.0 END AS mae_delta_pct
  FROM (SELECT * FROM overall WHERE model_version <> '{CHAMPION_VERSION}') c
  LEFT JOIN (SELECT * FROM overall WHERE model_version = '{CHAMPION_VERSION}') h USING (model_name)""")

cte("deltas", ["pairs", "evaluation"], f"""
  SELECT p.model_name, p.model_version, p.champion_version, cs.segment_column, cs.segment AS segment_value,
    cs.rmse AS candidate_rmse, hs.rmse AS champion_rmse, cs.rmse - hs.rmse AS rmse_delta,
    (cs.rmse - hs.rmse) / hs.rmse AS rmse_delta_pct,
    CASE cs.segment_column {' '.join(f"WHEN '{c}' THEN {i + 1}" for i, c in enumerate(SEGMENT_COLUMNS))} END AS pos
  FROM pairs p
  JOIN evaluation cs ON cs.model_name = p.model_name AND cs.model_version = p.model_version
    AND cs.segment_column IS NOT NULL AND cs.segment IS NOT NULL AND cs.rmse IS NOT NULL
  JOIN evaluation hs ON hs.model_name = p.model_name AND hs.model_version = p.champion_version
    AND hs.segment_column = cs.segment_column AND hs.segment = cs.segment AND hs.rmse IS NOT NULL
  WHERE hs.rmse > 0""")

cte("seg_regressions", ["deltas"], f"""
  SELECT model_name, model_version, count(*) AS n_seg,
    string_agg(CASE WHEN rn <= 5 THEN {sql_fill(T.SEGMENT_REASON_ITEM, column='segment_column', value='segment_value', pct=signed_pct('rmse_delta_pct'))} END,
               ', ' ORDER BY rn) AS labels
  FROM (SELECT *, row_number() OVER (PARTITION BY model_name, model_version
                                     ORDER BY pos, candidate_rmse, segment_value) AS rn
        FROM deltas WHERE rmse_delta_pct > 0.2)
  GROUP BY model_name, model_version""")

# --- drift: train vs test of the prepared rows ----------------------------------
cte("drift_cat_long", ["prepared"], "\n  UNION ALL\n".join(
    f"  SELECT '{MODEL_NAME}' AS model_name, '{c}' AS column_name, {i} AS ord, CAST({c} AS VARCHAR) AS v, "
    f"split = 'train' AS is_ref FROM prepared WHERE split IN ('train', 'test')"
    for i, c in enumerate(CATEGORICAL_FEATURES)
))

cte("psi", ["drift_cat_long"], f"""
  SELECT model_name, column_name, ord, coalesce(sum((cp - rp) * ln(cp / rp)), 0.0) AS statistic
  FROM (
    SELECT model_name, column_name, ord,
      greatest(r / sum(r) OVER (PARTITION BY model_name, column_name), {PSI_EPSILON}) AS rp,
      greatest(c / sum(c) OVER (PARTITION BY model_name, column_name), {PSI_EPSILON}) AS cp
    FROM (SELECT model_name, column_name, ord, v, count(*) FILTER (WHERE is_ref) AS r,
                 count(*) FILTER (WHERE NOT is_ref) AS c
          FROM drift_cat_long WHERE v IS NOT NULL GROUP BY ALL))
  GROUP BY model_name, column_name, ord""")

cte("drift_num_long", ["prepared"], "\n  UNION ALL\n".join(
    f"  SELECT '{MODEL_NAME}' AS model_name, '{c}' AS column_name, {len(CATEGORICAL_FEATURES) + i} AS ord, "
    f"CAST({c} AS DOUBLE) AS v, split = 'train' AS is_ref FROM prepared "
    f"WHERE split IN ('train', 'test') AND {c} IS NOT NULL AND NOT isnan({c})"
    for i, c in enumerate(NUMERIC_FEATURES)
))


def ks_pvalue_sql(d: str, n: str, m: str) -> str:
    """KS p-value from the theta-function form of the Kolmogorov
    distribution, P(K <= z) = sqrt(2 pi) / z * sum exp(-((2k - 1) pi / z)^2 / 8),
    where the library sums the alternating form."""
    e = f"(CAST({n} AS DOUBLE) * ({m}) / (({n}) + ({m})))"
    x = f"(({d}) * sqrt({e}))"
    z = f"({x} + 1.0 / (6.0 * sqrt({e})) + ({x} - 1.0) / (4.0 * {e}))"
    series = f"list_sum(list_transform(range(1, 201), lambda k: exp(-(2 * k - 1) * (2 * k - 1) * pi() * pi() / (8.0 * {z} * {z}))))"
    return (f"CASE WHEN {z} < 0.2 OR ({d}) <= 0 THEN 1.0 ELSE "
            f"least(greatest(1.0 - sqrt(2.0 * pi()) / {z} * {series}, 0.0), 1.0) END")


cte("ks", ["drift_num_long"], """
  SELECT model_name, column_name, ord, max(abs(cr / nr - cc / nc)) AS statistic,
         CAST(max(nr) AS BIGINT) AS n_reference, CAST(max(nc) AS BIGINT) AS n_current
  FROM (
    SELECT model_name, column_name, ord,
      sum(r) OVER w AS cr, sum(c) OVER w AS cc,
      sum(r) OVER (PARTITION BY model_name, column_name) AS nr,
      sum(c) OVER (PARTITION BY model_name, column_name) AS nc
    FROM (SELECT model_name, column_name, ord, v, count(*) FILTER (WHERE is_ref) AS r,
                 count(*) FILTER (WHERE NOT is_ref) AS c FROM drift_num_long GROUP BY ALL)
    WINDOW w AS (PARTITION BY model_name, column_name ORDER BY v))
  WHERE nr > 0 AND nc > 0
  GROUP BY model_name, column_name, ord""")

cte("ks_p", ["ks"], f"""
  SELECT *, {ks_pvalue_sql('statistic', 'n_reference', 'n_current')} AS p_value FROM ks""")

cte("drift_rows", ["psi", "ks_p"], f"""
  SELECT model_name, column_name AS "column", 'psi' AS drift_type, statistic, CAST({DEFAULT_PSI_THRESHOLD} AS DOUBLE) AS threshold,
         CAST(NULL AS DOUBLE) AS p_value, statistic > {DEFAULT_PSI_THRESHOLD} AS is_drifted, ord FROM psi
  UNION ALL
  SELECT model_name, column_name, 'ks', statistic, CAST({DEFAULT_KS_ALPHA} AS DOUBLE),
         p_value, p_value < {DEFAULT_KS_ALPHA}, ord FROM ks_p""")

cte("drift_flag", ["drift_rows"], """
  SELECT model_name, bool_or(is_drifted) AS any_drift,
         string_agg(CASE WHEN is_drifted THEN "column" END, ', ' ORDER BY ord) AS drifted
  FROM drift_rows GROUP BY model_name""")

# --- gate --------------------------------------------------------------------
cte("gate", ["pairs", "seg_regressions", "drift_flag"], f"""
  SELECT p.*, s.n_seg, s.labels, d.any_drift, d.drifted,
    p.rmse > 200000.0 AS f_rmse, p.mae > 170000.0 AS f_mae,
    p.has_champion AND p.rmse_delta_pct > 0.1 AS f_champ,
    p.has_champion AND coalesce(s.n_seg, 0) > 0 AS f_seg,
    coalesce(d.any_drift, false) AS f_drift,
    d.model_name IS NOT NULL AS has_drift
  FROM pairs p
  LEFT JOIN seg_regressions s USING (model_name, model_version)
  LEFT JOIN drift_flag d USING (model_name)""")


def _list(items: list[str]) -> str:
    return "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"


cte("verdict", ["gate"], f"""
  SELECT *,
    CASE WHEN f_rmse OR f_mae OR f_champ THEN 'REJECT'
         WHEN f_seg OR f_drift THEN 'MANUAL_REVIEW' ELSE 'PROMOTE' END AS decision,
    {_list([
        f"CASE WHEN f_rmse THEN {sql_fill(T.REASON_RMSE, rmse=thousands('rmse'), limit=thousands('200000.0'))} END",
        f"CASE WHEN f_mae THEN {sql_fill(T.REASON_MAE, mae=thousands('mae'), limit=thousands('170000.0'))} END",
        f"CASE WHEN f_champ THEN {sql_fill(T.REASON_CHAMPION, pct=pct('rmse_delta_pct'), limit=pct('0.1', 0))} END",
        f"CASE WHEN f_seg THEN {sql_fill(T.REASON_SEGMENTS, limit=pct('0.2', 0), segments='labels')} END",
        f"CASE WHEN NOT has_champion THEN {sql_str(T.NO_CHAMPION_REASON)} END",
        f"CASE WHEN f_drift THEN {sql_fill(T.REASON_DRIFT, columns='drifted')} END",
    ])} AS reasons_list,
    {_list([
        "CASE WHEN NOT f_rmse THEN 'absolute_rmse' END",
        "CASE WHEN NOT f_mae THEN 'absolute_mae' END",
        "CASE WHEN has_champion AND NOT f_champ THEN 'champion_rmse_regression' END",
        "CASE WHEN has_champion AND NOT f_seg THEN 'segment_rmse_regression' END",
        "CASE WHEN NOT has_champion THEN 'champion_comparison_skipped' END",
        "CASE WHEN has_drift AND NOT f_drift THEN 'drift_check' END",
        "CASE WHEN NOT has_drift THEN 'drift_check_skipped' END",
    ])} AS passed_list,
    {_list([
        "CASE WHEN f_rmse THEN 'absolute_rmse' END",
        "CASE WHEN f_mae THEN 'absolute_mae' END",
        "CASE WHEN f_champ THEN 'champion_rmse_regression' END",
        "CASE WHEN f_seg THEN 'segment_rmse_regression' END",
        "CASE WHEN f_drift THEN 'drift_check' END",
    ])} AS failed_list
  FROM gate""")

GATE_SELECT = """
SELECT model_name, model_version, decision,
  array_to_string(reasons_list, ' | ') AS reasons,
  array_to_string(passed_list, ', ') AS checks_passed,
  array_to_string(failed_list, ', ') AS checks_failed,
  round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(rmse_delta_pct, 6) AS rmse_delta_pct
FROM verdict"""


# --- reusable scalar fragments -------------------------------------------------
def sql_lease(col: str) -> str:
    t = f"lower(trim({col}))"
    y = rf"regexp_extract({t}, '(\d+)\s+year', 1)"
    m = rf"regexp_extract({t}, '(\d+)\s+month', 1)"
    return (
        f"CASE WHEN {t} IS NULL OR {t} = '' THEN NULL "
        f"WHEN {y} <> '' OR {m} <> '' THEN coalesce(TRY_CAST(NULLIF({y}, '') AS DOUBLE), 0.0) "
        f"+ coalesce(TRY_CAST(NULLIF({m}, '') AS DOUBLE), 0.0) / 12.0 "
        f"ELSE TRY_CAST({t} AS DOUBLE) END"
    )


def sql_storey(col: str) -> str:
    b = rf"regexp_extract_all(upper(trim({col})), '(\d+)', 1)"
    return (
        f"CASE WHEN len({b}) >= 2 THEN (CAST({b}[1] AS DOUBLE) + CAST({b}[2] AS DOUBLE)) / 2.0 "
        f"WHEN len({b}) = 1 THEN CAST({b}[1] AS DOUBLE) END"
    )


def sql_age(month: str, lease_start: str) -> str:
    return (
        f"(year(strptime({month}, '%Y-%m')) + (month(strptime({month}, '%Y-%m')) - 1) / 12.0) "
        f"- TRY_CAST({lease_start} AS DOUBLE)"
    )


def sql_sanitize(col: str, lower: bool) -> str:
    if lower:
        c = rf"regexp_replace(regexp_replace(lower({col}), '[^\p{{L}}\p{{N}}]', '-', 'g'), '^-+|-+$', '', 'g')"
    else:
        c = (rf"regexp_replace(regexp_replace(regexp_replace({col}, '^\s+|\s+$', '', 'g'), '[^\p{{L}}\p{{N}}_-]', '-', 'g'), "
             rf"'^[-_]+|[-_]+$', '', 'g')")
    return f"coalesce(NULLIF({c}, ''), 'review')"


def sql_strip(col: str) -> str:
    return rf"regexp_replace({col}, '^\s+|\s+$', '', 'g')"


CHECK_LABEL_SQL = (
    "CASE x " + " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in T.CHECK_LABELS.items())
    + " ELSE replace(x, '_', ' ') END"
)


def sql_humanize(list_expr: str) -> str:
    return f"array_to_string(list_transform({list_expr}, lambda x: {CHECK_LABEL_SQL}), ', ')"
