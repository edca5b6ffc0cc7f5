"""Statistical column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KS_SERIES_TERMS = 100


def ks_pvalue(d: Column, n: Column, m: Column, terms: int = KS_SERIES_TERMS) -> Column:
    """Two-sided two-sample KS p-value, one formula for every sample size.

    The Kolmogorov distribution at the effective size e = nm/(n+m), with the
    finite-sample shift of its argument (Vrbik, Small-Sample Corrections to
    Kolmogorov-Smirnov Test Statistic): for x = D sqrt(e),
    z = x + 1/(6 sqrt(e)) + (x - 1)/(4 e) and
    p = 2 * sum_{k>=1} (-1)^(k-1) exp(-2 k^2 z^2), clamped to [0, 1]; p = 1
    where z < 0.2 (there the series is 1 to double precision) and where D is
    0. A fixed number of terms whatever the samples' sizes, evaluated as a
    SQL expression without Python.
    """
    n = n.cast("double")
    m = m.cast("double")
    e = n * m / (n + m)
    x = d * F.sqrt(e)
    z = x + 1.0 / (6.0 * F.sqrt(e)) + (x - 1.0) / (4.0 * e)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc + 2.0 * F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * z * z),
    )
    p = F.when((z < 0.2) | (d <= 0), F.lit(1.0)).when(d >= 1.0 + 1e-12, F.lit(0.0)).otherwise(series)
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def ks_pvalue_exact(d: Column, n: Column, m: Column) -> Column:
    """Two-sided two-sample KS p-value from the exact distribution of D for
    samples of n and m values without ties, as a SQL expression.

    The orders of n + m values are the lattice paths from (0, 0) to (n, m); D is
    below its observed value where a path keeps |i/n - j/m| below it at every
    step. The paths that do are counted row by row, ``row[j] = above[j] + row[j - 1]``
    inside and 0 outside, each row divided by the number of all paths to
    its last place but one, so that the last value is their share. For small
    samples: it takes n times m steps, and arrays of the smaller size.
    """
    n, m = n.cast("long"), m.cast("long")
    long, short = F.greatest(n, m), F.least(n, m)
    # D is a multiple of 1 / (n m): whole numbers from here on
    reach = F.round(d * long * short).cast("long")
    inside = lambda i, j: F.abs(i * short - j * long) < reach
    columns = F.sequence(F.lit(0).cast("long"), short)
    first = F.transform(columns, lambda j: F.when(inside(F.lit(0), j), F.lit(1.0)).otherwise(F.lit(0.0)))

    def next_row(above: Column, i: Column) -> Column:
        scale = i / (short + i)

        def cell(row: Column, j: Column) -> Column:
            left = F.when(j > 0, F.element_at(row, -1)).otherwise(F.lit(0.0))
            value = F.get(above, j.cast("int")) * scale + left
            return F.concat(row, F.array(F.when(inside(i, j), value).otherwise(F.lit(0.0))))

        return F.aggregate(columns, F.array().cast("array<double>"), cell)

    share = F.element_at(F.aggregate(F.sequence(F.lit(1).cast("long"), long), first, next_row), -1)
    p = F.when(reach <= 0, F.lit(1.0)).when(d > 1.0 + 1e-12, F.lit(0.0)).otherwise(1.0 - share)
    return F.when(d.isNotNull() & (n > 0) & (m > 0), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def psi_term(ref_pct: Column, cur_pct: Column) -> Column:
    """(cur - ref) * ln(cur / ref) on percentages already floored."""
    return (cur_pct - ref_pct) * F.log(cur_pct / ref_pct)
