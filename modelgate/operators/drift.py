"""Distribution drift between a reference and a current sample.

Categorical columns: Population Stability Index. Numeric columns: two-sample
Kolmogorov-Smirnov statistic and p-value. All monitored columns are measured
in one job: both samples are tagged with a side flag, unioned (no shuffle),
unpivoted to ``(keys, column, value, side)`` and counted once per distinct
``(keys, column, value)``. A value that holds a third of all rows is
pre-aggregated map-side into one row per task, so skew never reaches a
single reducer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelgate.functions.stats import ks_pvalue, ks_pvalue_exact, psi_term
from modelgate.schema import DEFAULT_KS_ALPHA, DEFAULT_PSI_THRESHOLD, PSI_EPSILON

SIDE = "__is_reference"


def _present(reference: DataFrame, current: DataFrame, columns) -> list[str]:
    """Columns missing from either sample are skipped."""
    return [c for c in columns if c in reference.columns and c in current.columns]


def _ordinal(columns: list[str], offset: int = 0) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column")).cast("int") + offset - 1


def categorical_drift(
    reference: DataFrame,
    current: DataFrame,
    columns,
    psi_threshold: float = DEFAULT_PSI_THRESHOLD,
    keys: list[str] = (),
) -> DataFrame:
    """One PSI row per column: sum over categories of (cur% - ref%) ln(cur%/ref%)
    with each % floored at 1e-4 (not renormalised); 0.0 when either side has
    no values; drifted when psi > threshold."""
    return drift_report(reference, current, columns, [], psi_threshold=psi_threshold, keys=keys)


def _value_long(reference: DataFrame, current: DataFrame, categorical: list[str], numeric: list[str],
                keys: list[str]) -> DataFrame:
    """Both samples, every monitored column, one row per non-missing value:
    (keys, side, column, sval, dval). Categorical values go to ``sval``,
    numeric ones to ``dval`` (NaN counts as missing)."""
    def side(df: DataFrame, is_ref: bool) -> DataFrame:
        vals = [F.struct(F.col(c).cast("string").alias("s"), F.lit(None).cast("double").alias("d")).alias(c) for c in categorical]
        vals += [F.struct(F.lit(None).cast("string").alias("s"), F.col(c).cast("double").alias("d")).alias(c) for c in numeric]
        return df.select(*keys, *vals, F.lit(is_ref).alias(SIDE))

    both = side(reference, True).unionByName(side(current, False))
    long = both.unpivot([*keys, SIDE], [*categorical, *numeric], "column", "v").select(
        *keys, SIDE, "column", F.col("v.s").alias("sval"), F.col("v.d").alias("dval"))
    valid = F.col("sval").isNotNull() | (F.col("dval").isNotNull() & ~F.isnan("dval"))
    return long.where(valid)


def value_counts(
    reference: DataFrame, current: DataFrame, categorical: list[str], numeric: list[str], keys: list[str] = (),
    materialize: bool = False,
) -> DataFrame:
    """(keys, column, sval, dval, r, c, n_reference, n_current).

    The value-count aggregate is combined map-side, so a value holding a
    third of all rows is one row per task before the shuffle. Totals per
    column are then taken from those distinct-value counts. With
    ``materialize`` the counts are written once and the samples are read once;
    without it Spark may read the samples again for the totals and for the
    bounds of the value ranges.
    """
    keys = list(keys)
    long = _value_long(reference, current, categorical, numeric, keys)
    distinct = long.groupBy(*keys, "column", "sval", "dval").agg(
        F.count_if(F.col(SIDE)).alias("r"), F.count_if(~F.col(SIDE)).alias("c")
    )
    if materialize:
        # Written once to the shared checkpoint folder: the totals and the
        # value ranges below both read it, so the samples are read once.
        from modelgate.session import cut_lineage

        distinct = cut_lineage(distinct, name="drift_value_counts")
    stats = distinct.groupBy(*keys, "column").agg(F.sum("r").alias("n_reference"), F.sum("c").alias("n_current"))
    if materialize:  # one row per key and column, from a written table: worth a count
        from modelgate.operators.common import bounded_broadcast

        stats = bounded_broadcast(stats)
    return distinct.join(stats, [*keys, "column"]).select(
        *keys, "column", "sval", "dval", "r", "c", "n_reference", "n_current")


def psi_from_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """PSI per (keys, column) from categorical value counts."""
    ref_pct = F.greatest(F.col("r") / F.col("n_reference"), F.lit(PSI_EPSILON))
    cur_pct = F.greatest(F.col("c") / F.col("n_current"), F.lit(PSI_EPSILON))
    usable = (F.col("n_reference") > 0) & (F.col("n_current") > 0)
    return counts.where(F.col("sval").isNotNull()).groupBy(*keys, "column").agg(
        F.coalesce(F.sum(F.when(usable, psi_term(ref_pct, cur_pct))), F.lit(0.0)).alias("statistic")
    )


def _range_gaps(names: list[str]):
    """A task's range of value counts, sorted by ``names`` and value, to one row
    per group in it: the range's number, the largest and smallest gap between
    the running shares, and the range's totals."""

    def run(batches):
        number = TaskContext.get().partitionId()
        group, n_r, n_c, seen_r, seen_c, top, low = None, 0, 0, 0, 0, 0.0, 0.0

        def row():
            values = [pa.array([number], pa.int32()), [n_r], [n_c], [top], [low], [seen_r], [seen_c]]
            return pa.RecordBatch.from_arrays(
                [group.column(c) for c in names] + [v if isinstance(v, pa.Array) else pa.array(v) for v in values],
                names=[*names, "range", "n_reference", "n_current", "gmax", "gmin", "br", "bc"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, dtype=bool)
            for c in names:
                code = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= code[1:] != code[:-1]
            new[0] = group is None or [group.column(c)[0].as_py() for c in names] != [batch.column(c)[0].as_py() for c in names]
            r, c = (batch.column(x).to_numpy() for x in ("r", "c"))
            starts = np.unique(np.append(np.flatnonzero(new), 0))
            for start, stop in zip(starts, [*starts[1:], batch.num_rows]):
                if new[start]:
                    if group is not None:
                        yield row()
                    group = batch.slice(start, 1)
                    n_r, n_c = group.column("n_reference")[0].as_py(), group.column("n_current")[0].as_py()
                    seen_r, seen_c, top, low = 0, 0, -np.inf, np.inf
                run_r, run_c = seen_r + np.cumsum(r[start:stop]), seen_c + np.cumsum(c[start:stop])
                gap = run_r / n_r - run_c / n_c
                seen_r, seen_c = int(run_r[-1]), int(run_c[-1])
                top, low = max(top, float(gap.max())), min(low, float(gap.min()))
        if group is not None:
            yield row()

    return run


def ks_from_counts(counts: DataFrame, keys: list[str], buckets: int | None = None) -> DataFrame:
    """Largest CDF gap per (keys, column) from numeric value counts.

    The counts are spread by ranges of (keys, column, value) whose bounds Spark
    samples (``buckets`` of them, by default as many as shuffle partitions): a
    column that holds all rows is spread over all tasks, and nothing in the plan
    or on the driver grows with the rows. Each task runs through its sorted
    range once and reports, per column in it, the largest and smallest gap and
    the totals; the ranges' offsets are prefix sums over these few rows.
    """
    part = [*keys, "column"]
    num = counts.where(F.col("dval").isNotNull() & (F.col("n_reference") > 0) & (F.col("n_current") > 0))
    by = [F.col(f"`{c}`") for c in part] + [F.col("dval")]
    num = num.select(*by, "r", "c", "n_reference", "n_current")
    ranged = (num.repartitionByRange(buckets, *by) if buckets else num.repartitionByRange(*by)).sortWithinPartitions(*by)
    schema = num.select(*part).schema
    for name, kind in (("range", "integer"), ("n_reference", "long"), ("n_current", "long"), ("gmax", "double"),
                       ("gmin", "double"), ("br", "long"), ("bc", "long")):
        schema = schema.add(name, kind)
    per_range = ranged.mapInArrow(_range_gaps(part), schema)
    before = Window.partitionBy(*part).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offset = (F.coalesce(F.sum("br").over(before), F.lit(0)) / F.col("n_reference")) - (
        F.coalesce(F.sum("bc").over(before), F.lit(0)) / F.col("n_current"))
    with_offset = per_range.select(*part, "n_reference", "n_current", "gmax", "gmin", offset.alias("off"))
    return with_offset.groupBy(*part).agg(
        F.max(F.greatest(F.abs(F.col("off") + F.col("gmax")), F.abs(F.col("off") + F.col("gmin")))).alias("statistic"),
        F.first("n_reference").alias("n_reference"),
        F.first("n_current").alias("n_current"),
    )


KS_METHODS = {"asymptotic": ks_pvalue, "exact": ks_pvalue_exact}


def with_ks_pvalue(ks: DataFrame, method: str = "asymptotic") -> DataFrame:
    """Add ``p_value`` by ``functions.stats.ks_pvalue`` (the default, for samples
    of any size) or ``ks_pvalue_exact`` (``exact``, for small ones). The
    method is the caller's choice and never depends on the rows."""
    if method not in KS_METHODS:
        raise ValueError(f"unknown method {method!r}: one of {sorted(KS_METHODS)}")
    return ks.withColumn("p_value", KS_METHODS[method](F.col("statistic"), F.col("n_reference"), F.col("n_current")))


def ks_statistics(
    reference: DataFrame,
    current: DataFrame,
    columns,
    keys: list[str] = (),
    buckets: int | None = None,
    materialize: bool = False,
) -> DataFrame:
    """(keys, column, statistic, n_reference, n_current): the largest gap
    between the two empirical CDFs, for every column in one job, without a
    global sort (see ``value_counts`` and ``ks_from_counts``). Exact: ties
    are merged before the running sums, and range boundaries only cut
    between distinct values. ``materialize`` writes the value counts once, so
    that each sample is read once."""
    keys = list(keys)
    counts = value_counts(reference, current, [], list(columns), keys, materialize)
    return ks_from_counts(counts, keys, buckets)


def numeric_drift(
    reference: DataFrame,
    current: DataFrame,
    columns,
    ks_alpha: float = DEFAULT_KS_ALPHA,
    keys: list[str] = (),
    buckets: int | None = None,
    method: str = "asymptotic",
) -> DataFrame:
    """One KS row per column with values on both sides; drifted when
    p < alpha. ``threshold`` holds alpha; ``method`` names the p-value's."""
    return drift_report(reference, current, [], columns, ks_alpha=ks_alpha, keys=keys, buckets=buckets, method=method)


def _empty_drift(like: DataFrame, keys: list[str]) -> DataFrame:
    key_types = dict(like.dtypes)
    ddl = ", ".join([f"`{k}` {key_types[k]}" for k in keys] + [
        "column string, drift_type string, statistic double, threshold double, "
        "p_value double, is_drifted boolean, ord int"
    ])
    return like.sparkSession.createDataFrame([], ddl)


def drift_report(
    reference: DataFrame,
    current: DataFrame,
    categorical_columns,
    numeric_columns,
    psi_threshold: float = DEFAULT_PSI_THRESHOLD,
    ks_alpha: float = DEFAULT_KS_ALPHA,
    keys: list[str] = (),
    buckets: int | None = None,
    materialize: bool = False,
    method: str = "asymptotic",
) -> DataFrame:
    """Categorical (PSI) rows then numeric (KS) rows; ``ord`` gives report
    order. Both come from one shared value-count aggregate. Columns missing
    from either sample are skipped; a numeric column with no values on a
    side gives no row; a categorical one gives PSI 0.0."""
    keys = list(keys)
    cat = _present(reference, current, categorical_columns)
    num = _present(reference, current, numeric_columns)
    if not cat and not num:
        return _empty_drift(reference, keys)
    counts = value_counts(reference, current, cat, num, keys, materialize)
    psi = psi_from_counts(counts, keys)
    if cat:
        # every configured column has a row, also one without a single value
        if keys:
            known = reference.select(*keys).unionByName(current.select(*keys)).distinct()
        else:
            known = reference.sparkSession.range(1).select()
        present = known.withColumn("column", F.explode(F.array(*[F.lit(c) for c in cat])))
        joined = present.alias("p").join(psi.alias("s"), F.expr(
            " AND ".join([f"p.`{k}` <=> s.`{k}`" for k in keys] + ["p.column = s.column"])), "left")
        psi = joined.select(*[F.col(f"p.{k}").alias(k) for k in keys], F.col("p.column").alias("column"),
                            F.coalesce("s.statistic", F.lit(0.0)).alias("statistic"))
    psi_rows = psi.select(
        *keys, "column", F.lit("psi").alias("drift_type"), "statistic", F.lit(float(psi_threshold)).alias("threshold"),
        F.lit(None).cast("double").alias("p_value"), (F.col("statistic") > psi_threshold).alias("is_drifted"),
        _ordinal(cat).alias("ord") if cat else F.lit(0).alias("ord"),
    )
    ks = with_ks_pvalue(ks_from_counts(counts, keys, buckets), method)
    ks_rows = ks.select(
        *keys, "column", F.lit("ks").alias("drift_type"), "statistic", F.lit(float(ks_alpha)).alias("threshold"),
        "p_value", (F.col("p_value") < ks_alpha).alias("is_drifted"),
        _ordinal(num, len(cat)).alias("ord") if num else F.lit(0).alias("ord"),
    )
    if not cat:
        return ks_rows
    if not num:
        return psi_rows
    return psi_rows.unionByName(ks_rows)


def drift_summary(report: DataFrame, keys: list[str] = ()) -> DataFrame:
    """One row per key: ``overall_drift_detected``, ordered ``column_results``
    and ``drifted_columns``. The collected lists are bounded by the number of
    monitored columns (configuration), not by the data."""
    keys = list(keys)
    row = F.struct("ord", "column", "drift_type", "statistic", "threshold", "p_value", "is_drifted")
    grouped = report.groupBy(*keys).agg(
        F.bool_or("is_drifted").alias("overall_drift_detected"),
        F.array_sort(F.collect_list(row)).alias("__rows"),
    )
    return grouped.select(
        *keys,
        "overall_drift_detected",
        F.transform(
            "__rows",
            lambda r: F.struct(
                r["column"].alias("column"),
                r["drift_type"].alias("drift_type"),
                r["statistic"].alias("statistic"),
                r["threshold"].alias("threshold"),
                r["p_value"].alias("p_value"),
                r["is_drifted"].alias("is_drifted"),
            ),
        ).alias("column_results"),
        F.transform(F.filter("__rows", lambda r: r["is_drifted"]), lambda r: r["column"]).alias("drifted_columns"),
    )
