"""Chronological train / validation / test split over observed months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelgate.functions.parse import parse_month
from modelgate.schema import DEFAULT_TEST_MONTHS, DEFAULT_VALIDATION_MONTHS

SPLITS = ("train", "validation", "test")


def _month_bounds(months: DataFrame, validation_months: int, test_months: int):
    """Start month of test and of validation from the distinct month list.

    Only the newest ``validation+test`` months and the month count reach the
    driver (bounded by the arguments, not by the data).
    """
    holdout = validation_months + test_months
    # One action: the newest holdout+1 months, a null month sorted first.
    newest = [r["m"] for r in months.orderBy(F.col("m").desc_nulls_first()).limit(holdout + 1).collect()]
    if newest and newest[0] is None:
        raise ValueError("The month column holds null values; cannot place them in a split.")
    if len(newest) <= holdout:
        raise ValueError(
            f"Need more than {holdout} unique months to create train, validation, and test splits."
        )
    return newest[test_months - 1], newest[holdout - 1]


def split_bounds(
    df: DataFrame,
    month: Column,
    validation_months: int = DEFAULT_VALIDATION_MONTHS,
    test_months: int = DEFAULT_TEST_MONTHS,
) -> tuple:
    """(test_start, validation_start) month of the distinct months of
    ``month`` (a date column or expression) over all rows of ``df``."""
    if validation_months < 1 or test_months < 1:
        raise ValueError("validation_months and test_months must both be at least 1.")
    months = df.select(F.trunc(month, "month").alias("m")).distinct()
    return _month_bounds(months, validation_months, test_months)


def split_label(month: Column, bounds: tuple) -> Column:
    """'test' / 'validation' / 'train' from a month and the split bounds."""
    test_start, validation_start = bounds
    m = F.trunc(month, "month")
    return (
        F.when(m >= F.lit(test_start), F.lit("test"))
        .when(m >= F.lit(validation_start), F.lit("validation"))
        .otherwise(F.lit("train"))
    )


def split_predicate(month: Column, bounds: tuple, splits) -> Column:
    """Month-range predicate selecting ``splits``: plain comparisons on the
    month column, so they reach the parquet scan as pushed filters."""
    test_start, validation_start = bounds
    ranges = {
        "test": month >= F.lit(test_start),
        "validation": (month >= F.lit(validation_start)) & (month < F.lit(test_start)),
        "train": month < F.lit(validation_start),
    }
    pred = F.lit(False)
    for s in splits:
        pred = pred | ranges[s]
    return pred


def chrono_split(
    raw: DataFrame,
    validation_months: int = DEFAULT_VALIDATION_MONTHS,
    test_months: int = DEFAULT_TEST_MONTHS,
    month_column: str = "month",
) -> DataFrame:
    """Add a ``split`` column: newest ``test_months`` distinct months -> test,
    the ``validation_months`` before them -> validation, the rest -> train.

    Months are ranked on the raw rows (before any feature filtering). Since
    the three splits are contiguous month ranges, the label is two literal
    comparisons on the row's month (only the small distinct-month list is
    aggregated; no join back to the rows). To read one split, filter with
    ``split_predicate`` (a month range that reaches the scan as a pushed
    filter) rather than on the label.
    """
    if validation_months < 1 or test_months < 1:
        raise ValueError("validation_months and test_months must both be at least 1.")
    month = F.trunc(parse_month(F.col(month_column)), "month")
    months = raw.select(month.alias("m")).distinct()
    test_start, validation_start = _month_bounds(months, validation_months, test_months)
    label = (
        F.when(month >= F.lit(test_start), F.lit("test"))
        .when(month >= F.lit(validation_start), F.lit("validation"))
        .otherwise(F.lit("train"))
    )
    return raw.withColumn("split", label)


def split_summary(split_df: DataFrame, month_column: str = "month") -> DataFrame:
    """Rows and first/last month per split (one partial + final aggregate)."""
    month = F.trunc(parse_month(F.col(month_column)), "month")
    return split_df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.date_format(F.min(month), "yyyy-MM").alias("first_month"),
        F.date_format(F.max(month), "yyyy-MM").alias("last_month"),
    )


def split_summary_wide(split_df: DataFrame, month_column: str = "month") -> DataFrame:
    """The summary as one row: ``<split>_rows``, ``<split>_month_start/end``."""
    long = split_summary(split_df, month_column)
    wide = long.groupBy().pivot("split", list(SPLITS)).agg(
        F.first("rows").alias("rows"),
        F.first("first_month").alias("month_start"),
        F.first("last_month").alias("month_end"),
    )
    return wide
