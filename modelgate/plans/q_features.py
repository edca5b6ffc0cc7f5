"""Queries for scalar parsing/formatting functions, drift statistics and
comparison wrappers, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelgate.functions import parse as P
from modelgate.functions import text as X
from modelgate.operators import features as FE
from modelgate.plans.catalog import gate_job, query, r
from modelgate.plans.oracle import (
    signed_pct,
    signed_thousands,
    sql_age,
    sql_humanize,
    sql_lease,
    sql_sanitize,
    sql_storey,
    sql_strip,
    thousands,
    pct,
)
from modelgate.plans.oracles import oracle
from modelgate.sources.tables import Tables


def _count(df, *cols):
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("rows"))


# --- B2-B8 on every raw row ----------------------------------------------------
@query("feat_month")
def q_feat_month(spark, sf_dir):
    raw = gate_job(spark, sf_dir).raw
    return _count(raw.select("month", P.parse_month(F.col("month")).alias("sale_month")), "month", "sale_month")


oracle("feat_month", ["raw"], """
SELECT month, CAST(strptime(month, '%Y-%m') AS DATE) AS sale_month, count(*) AS rows FROM raw GROUP BY ALL""")


@query("feat_numeric")
def q_feat_numeric(spark, sf_dir):
    raw = gate_job(spark, sf_dir).raw
    return _count(raw.select("floor_area_sqm", P.to_number(F.col("floor_area_sqm")).alias("value")), "floor_area_sqm", "value")


oracle("feat_numeric", ["raw"], """
SELECT floor_area_sqm, TRY_CAST(floor_area_sqm AS DOUBLE) AS value, count(*) AS rows FROM raw GROUP BY ALL""")


@query("feat_lease")
def q_feat_lease(spark, sf_dir):
    raw = gate_job(spark, sf_dir).raw
    return _count(raw.select("remaining_lease", F.round(P.lease_years(F.col("remaining_lease")), 9).alias("years")),
                  "remaining_lease", "years")


oracle("feat_lease", ["raw"], f"""
SELECT remaining_lease, round({sql_lease('remaining_lease')}, 9) AS years, count(*) AS rows FROM raw GROUP BY ALL""")


@query("feat_storey")
def q_feat_storey(spark, sf_dir):
    raw = gate_job(spark, sf_dir).raw
    return _count(raw.select("storey_range", P.storey_midpoint(F.col("storey_range")).alias("midpoint")), "storey_range", "midpoint")


oracle("feat_storey", ["raw"], f"""
SELECT storey_range, {sql_storey('storey_range')} AS midpoint, count(*) AS rows FROM raw GROUP BY ALL""")


@query("feat_age")
def q_feat_age(spark, sf_dir):
    raw = gate_job(spark, sf_dir).raw
    e = FE.feature_columns(raw)
    return _count(raw.select("month", "lease_commence_date", F.round(e["flat_age_years"], 6).alias("flat_age_years")),
                  "month", "lease_commence_date", "flat_age_years")


oracle("feat_age", ["raw"], f"""
SELECT month, lease_commence_date, round({sql_age('month', 'lease_commence_date')}, 6) AS flat_age_years,
       count(*) AS rows FROM raw GROUP BY ALL""")


@query("feat_lease_fill")
def q_feat_lease_fill(spark, sf_dir):
    raw = gate_job(spark, sf_dir).raw
    e = FE.feature_columns(raw)
    return _count(
        raw.select(F.col("remaining_lease").isNull().alias("lease_missing"),
                   F.round(e["remaining_lease_years"], 6).alias("remaining_lease_years")),
        "lease_missing", "remaining_lease_years",
    )


oracle("feat_lease_fill", ["raw"], f"""
SELECT remaining_lease IS NULL AS lease_missing,
       round(coalesce({sql_lease('remaining_lease')}, 99.0 - ({sql_age('month', 'lease_commence_date')})), 6) AS remaining_lease_years,
       count(*) AS rows FROM raw GROUP BY ALL""")


@query("feat_dropna")
def q_feat_dropna(spark, sf_dir):
    j = gate_job(spark, sf_dir)
    before = _count(j.split, "split").withColumnRenamed("rows", "rows_in")
    after = _count(j.prepared, "split").withColumnRenamed("rows", "rows_kept")
    return before.join(after, "split", "left").select("split", "rows_in", F.coalesce("rows_kept", F.lit(0)).alias("rows_kept"))


oracle("feat_dropna", ["split", "prepared"], """
SELECT s.split, s.rows_in, coalesce(p.rows_kept, 0) AS rows_kept
FROM (SELECT split, count(*) AS rows_in FROM split GROUP BY split) s
LEFT JOIN (SELECT split, count(*) AS rows_kept FROM prepared GROUP BY split) p USING (split)""")


# --- B13-B20 --------------------------------------------------------------------
@query("sanitize_token")
def q_sanitize(spark, sf_dir):
    pages = Tables(spark, sf_dir).pages
    return pages.select("page_id", X.sanitize_token(F.col("url")).alias("token"),
                        X.sanitize_token(F.col("url"), lower=True).alias("token_lower"))


oracle("sanitize_token", [], f"""
SELECT page_id, {sql_sanitize('url', False)} AS token, {sql_sanitize('url', True)} AS token_lower FROM pages""")


@query("review_id")
def q_review_id(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    return ev.select("event_id", X.review_id(F.col("ts"), F.col("event_type"), F.col("user_id").cast("string"),
                                             F.col("event_id").cast("string")).alias("review_id"))


oracle("review_id", [], f"""
SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') || '-' || {sql_sanitize('event_type', True)} || '-v'
       || {sql_sanitize('CAST(user_id AS VARCHAR)', True)} || '-' || {sql_sanitize('CAST(event_id AS VARCHAR)', True)} AS review_id
FROM events""")


@query("format_metrics")
def q_format_metrics(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    return li.select(
        "l_orderkey", "l_linenumber",
        X.thousands(F.col("l_extendedprice")).alias("price"),
        X.signed_thousands(F.col("l_extendedprice") - 50000).alias("price_delta"),
        X.percent(F.col("l_discount")).alias("discount_pct"),
        X.signed_percent(F.col("l_tax") - F.col("l_discount")).alias("tax_minus_discount"),
        X.percent(F.col("l_tax"), 0).alias("tax_pct0"),
        X.fixed(F.col("l_discount") * F.col("l_tax"), 4).alias("product4"),
    )


oracle("format_metrics", [], f"""
SELECT l_orderkey, l_linenumber, {thousands('l_extendedprice')} AS price,
       {signed_thousands('l_extendedprice - 50000')} AS price_delta, {pct('l_discount')} AS discount_pct,
       {signed_pct('l_tax - l_discount')} AS tax_minus_discount, {pct('l_tax', 0)} AS tax_pct0,
       printf('%.4f', l_discount * l_tax) AS product4
FROM lineitem""")


@query("compact_text")
def q_compact_text(spark, sf_dir):
    c = Tables(spark, sf_dir).conversations
    return c.select("conv_id", "turn", X.compact_text(F.col("text"), 240).alias("preview"))


oracle("compact_text", [], f"""
SELECT conv_id, turn,
  CASE WHEN length(regexp_replace({sql_strip('text')}, '\\s+', ' ', 'g')) > 240
       THEN substr(regexp_replace({sql_strip('text')}, '\\s+', ' ', 'g'), 1, 237) || '...'
       ELSE regexp_replace({sql_strip('text')}, '\\s+', ' ', 'g') END AS preview
FROM conversations""")


@query("humanize_checks")
def q_humanize(spark, sf_dir):
    v = gate_job(spark, sf_dir).verdicts
    return v.select("model_name", "model_version", X.humanize_checks(F.col("checks_passed")).alias("passed_text"),
                    X.humanize_checks(F.col("checks_failed")).alias("failed_text"))


oracle("humanize_checks", ["verdict"], f"""
SELECT model_name, model_version, {sql_humanize('passed_list')} AS passed_text, {sql_humanize('failed_list')} AS failed_text
FROM verdict""")


# --- E: statistic-level keys ------------------------------------------------------
@query("psi")
def q_psi(spark, sf_dir):
    d = gate_job(spark, sf_dir).drift_rows.where(F.col("drift_type") == "psi")
    return d.select("model_name", "column", r("statistic", 9).alias("psi"))


oracle("psi", ["psi"], 'SELECT model_name, column_name AS "column", round(statistic, 9) AS psi FROM psi')


@query("ks_statistic")
def q_ks_statistic(spark, sf_dir):
    from modelgate.operators.drift import ks_statistics
    from modelgate.schema import NUMERIC_FEATURES

    j = gate_job(spark, sf_dir)
    ref = j.rows_of("train")
    cur = j.rows_of("test")
    ks = ks_statistics(ref, cur, NUMERIC_FEATURES, ["model_name"], materialize=True)
    return ks.select("model_name", "column", r("statistic", 9), "n_reference", "n_current")


oracle("ks_statistic", ["ks"], """
SELECT model_name, column_name AS "column", round(statistic, 9) AS statistic, n_reference, n_current FROM ks""")


@query("ks_pvalue")
def q_ks_pvalue(spark, sf_dir):
    d = gate_job(spark, sf_dir).drift_rows.where(F.col("drift_type") == "ks")
    return d.select("model_name", "column", r("p_value"), "is_drifted")


oracle("ks_pvalue", ["drift_rows"], """
SELECT model_name, "column", round(p_value, 6) AS p_value, is_drifted FROM drift_rows WHERE drift_type = 'ks'""")


# --- F: comparison wrappers ---------------------------------------------------------
@query("compare_models")
def q_compare_models(spark, sf_dir):
    j = gate_job(spark, sf_dir)
    n = j.segment_deltas.groupBy("model_name", "model_version").agg(F.count(F.lit(1)).alias("n_segment_deltas"))
    return j.pairs.join(n, ["model_name", "model_version"], "left").select(
        "model_name", "model_version", "has_champion", "champion_version", r("rmse", 4), r("champion_rmse", 4),
        r("rmse_delta_pct"), F.coalesce("n_segment_deltas", F.lit(0)).alias("n_segment_deltas"),
    )


oracle("compare_models", ["pairs", "deltas"], """
SELECT p.model_name, p.model_version, p.has_champion, p.champion_version, round(p.rmse, 4) AS rmse,
       round(p.champion_rmse, 4) AS champion_rmse, round(p.rmse_delta_pct, 6) AS rmse_delta_pct,
       coalesce(d.n, 0) AS n_segment_deltas
FROM pairs p LEFT JOIN (SELECT model_name, model_version, count(*) AS n FROM deltas GROUP BY ALL) d
USING (model_name, model_version)""")


@query("gather_evidence")
def q_gather_evidence(spark, sf_dir):
    g = gate_job(spark, sf_dir).gate_input
    return g.select("model_name", "model_version", "has_champion",
                    F.array_join("evidence_errors", " | ").alias("evidence_errors"))


oracle("gather_evidence", ["pairs", "evaluation"], """
SELECT p.model_name, p.model_version, p.has_champion,
  CASE WHEN p.has_champion AND NOT EXISTS (
      SELECT 1 FROM evaluation e WHERE e.model_name = p.model_name AND e.model_version = p.model_version
        AND e.segment_column IS NOT NULL)
    THEN 'Promotion blocked because candidate segment metrics are unavailable for champion comparison.'
    ELSE '' END AS evidence_errors
FROM pairs p""")


@query("metric_prefix")
def q_metric_prefix(spark, sf_dir):
    from modelgate.operators.registry import test_metrics

    j = gate_job(spark, sf_dir)
    m = j.split_metrics
    metrics = F.create_map(*[x for k in ("validation_rmse", "validation_mae", "test_rmse", "test_mae")
                             for x in (F.lit(k), F.col(k))])
    return m.select("model_name", "model_version", F.explode(test_metrics(metrics)).alias("metric", "value")).select(
        "model_name", "model_version", "metric", r("value", 4))


oracle("metric_prefix", ["scored"], """
SELECT model_name, model_version, metric, round(value, 4) AS value FROM (
  SELECT model_name, model_version,
         sqrt(avg((resale_price - prediction) * (resale_price - prediction))) AS rmse,
         avg(abs(resale_price - prediction)) AS mae
  FROM scored GROUP BY ALL)
UNPIVOT (value FOR metric IN (rmse, mae))""")


# --- L1: one-hot encoding ------------------------------------------------------------
@query("one_hot")
def q_one_hot(spark, sf_dir):
    """Category -> one-hot slot learned on the train split (alphabetical), applied
    to every test row by a join with the dictionary; counts rows per
    (column, value, slot) with slot -1 for unseen categories (all zeros)."""
    from modelgate.operators.encode import category_dictionary, slot_columns
    from modelgate.schema import CATEGORICAL_FEATURES

    j = gate_job(spark, sf_dir)
    columns = list(CATEGORICAL_FEATURES)
    dictionary = category_dictionary(j.rows_of("train"), columns)
    out = slot_columns(j.rows_of("test").select(*columns), dictionary, columns)
    row = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value"),
                                       F.coalesce(f"{c}__slot", F.lit(-1)).alias("slot")) for c in columns]))
    counted = _count(out.select(row.alias("x")).select("x.*"), "column", "value", "slot")
    width = dictionary.groupBy("column").agg(F.count(F.lit(1)).alias("width"))
    return counted.join(width, "column", "left").select("column", "value", "slot", F.coalesce("width", F.lit(0)).alias("width"), "rows")


def _one_hot_sql() -> str:
    from modelgate.schema import CATEGORICAL_FEATURES

    parts = []
    for c in CATEGORICAL_FEATURES:
        parts.append(f"""
SELECT '{c}' AS "column", t.{c} AS value, coalesce(v.slot, -1) AS slot, (SELECT count(*) FROM (SELECT DISTINCT {c} FROM prepared WHERE split = 'train')) AS width
FROM prepared t LEFT JOIN (SELECT {c} AS val, CAST(row_number() OVER (ORDER BY {c}) - 1 AS INTEGER) AS slot
                          FROM (SELECT DISTINCT {c} FROM prepared WHERE split = 'train')) v ON t.{c} = v.val
WHERE t.split = 'test'""")
    return "SELECT \"column\", value, slot, width, count(*) AS rows FROM (" + " UNION ALL ".join(parts) + ") GROUP BY ALL"


oracle("one_hot", ["prepared"], _one_hot_sql())


# --- B10, C2, H1 ------------------------------------------------------------------------
@query("features_and_target")
def q_features_and_target(spark, sf_dir):
    """Features without, and target without, the rest of the prepared rows."""
    from modelgate.operators.features import split_features_and_target

    features, target = split_features_and_target(gate_job(spark, sf_dir).prepared_once)
    side = lambda df, name: df.unpivot([], [F.col(c).cast("string").alias(c) for c in df.columns], "column", "v").groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("v").alias("distinct_values")).withColumn("side", F.lit(name))
    return side(features, "features").unionByName(side(target, "target"))


def _features_sql() -> str:
    from modelgate.schema import FEATURE_COLUMNS, TARGET_COLUMN

    part = lambda c, side: (
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(DISTINCT {c}) AS distinct_values, '{side}' AS side FROM prepared")
    return " UNION ALL ".join([part(c, "features") for c in FEATURE_COLUMNS] + [part(TARGET_COLUMN, "target")])


oracle("features_and_target", ["prepared"], _features_sql())


@query("holdout_guard")
def q_holdout_guard(spark, sf_dir):
    """Whether the months of the raw rows allow a holdout of each length: the
    guard refuses one as long as the months themselves."""
    from modelgate.functions.parse import parse_month
    from modelgate.operators.splits import split_bounds

    raw = gate_job(spark, sf_dir).raw.select("month")
    months = raw.select("month").distinct()
    n = months.count()
    found = []
    for validation, test in ((12, 12), (1, n - 2), (1, n - 1)):
        try:
            bounds = split_bounds(months, parse_month(F.col("month")), validation, test)
            found.append((validation, test, True, bounds[0].isoformat(), bounds[1].isoformat()))
        except ValueError:
            found.append((validation, test, False, None, None))
    return spark.createDataFrame(found, "validation_months int, test_months int, allowed boolean, test_start string, validation_start string")


oracle("holdout_guard", ["months"], """
SELECT validation_months, test_months, n > validation_months + test_months AS allowed,
  CASE WHEN n > validation_months + test_months THEN (SELECT strftime(m, '%Y-%m-%d') FROM months WHERE k = test_months) END AS test_start,
  CASE WHEN n > validation_months + test_months THEN (SELECT strftime(m, '%Y-%m-%d') FROM months WHERE k = validation_months + test_months) END AS validation_start
FROM (SELECT n, unnest([12, 1, 1]) AS validation_months, unnest([12, n - 2, n - 1]) AS test_months
      FROM (SELECT CAST(count(*) AS INTEGER) AS n FROM months))""")


@query("thresholds")
def q_thresholds(spark, sf_dir):
    """Limits of every candidate: a model's own where it has one, else the
    override, else the default."""
    from modelgate.operators.policy import THRESHOLD_COLUMNS, with_thresholds

    pairs = gate_job(spark, sf_dir).pairs
    own = pairs.groupBy("model_name").agg(F.round(F.max("champion_rmse"), 2).alias("max_test_rmse"))
    out = with_thresholds(pairs.select("model_name", "model_version"), {"max_segment_rmse_regression_pct": 0.3}, own)
    return out.select("model_name", "model_version", *THRESHOLD_COLUMNS)


oracle("thresholds", ["pairs"], """
SELECT p.model_name, p.model_version, o.own AS max_test_rmse, CAST(170000 AS DOUBLE) AS max_test_mae,
  CAST(0.1 AS DOUBLE) AS max_rmse_regression_pct, CAST(0.3 AS DOUBLE) AS max_segment_rmse_regression_pct, TRUE AS drift_blocks_promotion
FROM pairs p JOIN (SELECT model_name, round(max(champion_rmse), 2) AS own FROM pairs GROUP BY model_name) o USING (model_name)""")
