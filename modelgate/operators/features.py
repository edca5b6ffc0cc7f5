"""Feature preparation: raw string rows -> typed model features.

Staged projections plus one null filter: a single narrow stage, no shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgate.functions import parse as P
from modelgate.operators.common import require_columns
from modelgate.schema import (
    CATEGORICAL_FEATURES,
    DATE_COLUMN,
    DEFAULT_LEASE_YEARS,
    FEATURE_COLUMNS,
    NUMERIC_FEATURES,
    PREPARED_COLUMNS,
    PREPARED_SCHEMA,
    TARGET_COLUMN,
)


def _numeric(df: DataFrame, name: str) -> Column:
    """Number coercion; numeric input columns are only widened to double."""
    dtype = dict(df.dtypes)[name]
    if dtype in ("double", "float", "int", "bigint", "smallint", "tinyint") or dtype.startswith("decimal"):
        return F.col(name).cast("double")
    return P.to_number(F.col(name))


def _normalized_columns(df: DataFrame) -> dict[str, Column]:
    """Stage 1: coerce numbers, parse the month, normalise free text."""
    require_columns(df, ["month"], "raw dataset")
    lease = P.ascii_digits(F.lower(P.strip(F.col("remaining_lease").cast("string")))) \
        if "remaining_lease" in df.columns else F.lit(None).cast("string")
    return {
        DATE_COLUMN: P.parse_month(F.col("month")),
        TARGET_COLUMN: _numeric(df, TARGET_COLUMN),
        **{c: F.col(c).cast("string") for c in CATEGORICAL_FEATURES},
        "floor_area_sqm": _numeric(df, "floor_area_sqm"),
        "__lease_start": _numeric(df, "lease_commence_date"),
        "__lease_text": lease,
        "__storey_text": P.ascii_digits(F.upper(P.strip(F.col("storey_range").cast("string")))),
    }


def _derived_columns() -> dict[str, Column]:
    """Stage 2: features from the stage-1 values."""
    age = P.year_fraction(F.col(DATE_COLUMN)) - F.col("__lease_start")
    lease = P.nan_to_null(P.lease_years_normalized(F.col("__lease_text")))
    return {
        DATE_COLUMN: F.col(DATE_COLUMN),
        TARGET_COLUMN: F.col(TARGET_COLUMN),
        **{c: F.col(c) for c in CATEGORICAL_FEATURES},
        "floor_area_sqm": F.col("floor_area_sqm"),
        "flat_age_years": age,
        "remaining_lease_years": F.coalesce(lease, F.lit(DEFAULT_LEASE_YEARS) - age),
        "storey_midpoint": P.storey_midpoint_normalized(F.col("__storey_text")),
    }


def feature_columns(df: DataFrame) -> dict[str, Column]:
    """Typed feature expressions over raw columns in one projection (for
    per-feature queries and tests)."""
    require_columns(df, ["month"], "raw dataset")
    sale_month = P.parse_month(F.col("month"))
    age = P.year_fraction(sale_month) - _numeric(df, "lease_commence_date")
    if "remaining_lease" in df.columns:
        lease = P.nan_to_null(P.lease_years(F.col("remaining_lease")))
    else:
        lease = F.lit(None).cast("double")
    return {
        DATE_COLUMN: sale_month,
        TARGET_COLUMN: _numeric(df, TARGET_COLUMN),
        **{c: F.col(c).cast("string") for c in CATEGORICAL_FEATURES},
        "floor_area_sqm": _numeric(df, "floor_area_sqm"),
        "flat_age_years": age,
        "remaining_lease_years": F.coalesce(lease, F.lit(DEFAULT_LEASE_YEARS) - age),
        "storey_midpoint": P.storey_midpoint(F.col("storey_range")),
    }


def _stage(df: DataFrame, cols: dict[str, Column], carry: list[str]) -> DataFrame:
    """Project through a one-row Generate so later operators read computed
    values (predicate push-down cannot re-inline the expressions)."""
    row = F.struct(*[e.alias(n) for n, e in cols.items()], *[F.col(c) for c in carry])
    return df.select(F.inline(F.array(row)))


VALID = "__valid"


def typed_features(raw: DataFrame, passthrough: list[str] | None = None) -> DataFrame:
    """Every raw row typed (prepared columns + passthrough) with a ``__valid``
    flag: target and all features present and not NaN. Rows are not yet
    dropped, so month statistics still see every raw row.

    Two staged projections (normalise, then derive) keep every generated
    method small enough to be JIT-compiled and compute shared inputs once;
    this is one narrow stage, no shuffle.
    """
    passthrough = [c for c in (passthrough or []) if c not in PREPARED_COLUMNS]
    stage1 = _stage(raw, _normalized_columns(raw), passthrough)
    typed = _stage(stage1, _derived_columns(), passthrough)
    keep = F.lit(True)
    for c in [TARGET_COLUMN, *FEATURE_COLUMNS]:
        ok = F.col(c).isNotNull()
        if c == TARGET_COLUMN or c in NUMERIC_FEATURES:
            ok = ok & ~F.isnan(c)
        keep = keep & ok
    return typed.select(*PREPARED_COLUMNS, *passthrough, keep.alias(VALID))


def prepare_features(raw: DataFrame, passthrough: list[str] | None = None) -> DataFrame:
    """Raw rows -> prepared schema, dropping rows whose target or any feature
    is null or NaN. ``passthrough`` columns (split label, keys, predictions)
    are carried after the prepared columns."""
    return typed_features(raw, passthrough).where(F.col(VALID)).drop(VALID)


def split_features_and_target(prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    return prepared.select(*FEATURE_COLUMNS), prepared.select(TARGET_COLUMN)


def feature_schema(spark: SparkSession) -> DataFrame:
    """Role of every prepared column, plus the Spark schema as JSON."""
    schema_json = json.dumps(json.loads(PREPARED_SCHEMA.json()), sort_keys=True)
    rows = (
        [(DATE_COLUMN, "date", 0)]
        + [(TARGET_COLUMN, "target", 1)]
        + [(c, "categorical_feature", 2 + i) for i, c in enumerate(CATEGORICAL_FEATURES)]
        + [(c, "numeric_feature", 2 + len(CATEGORICAL_FEATURES) + i) for i, c in enumerate(NUMERIC_FEATURES)]
    )
    types = {f.name: f.dataType.simpleString() for f in PREPARED_SCHEMA.fields}
    return spark.createDataFrame(
        [(c, role, pos, types[c], schema_json) for c, role, pos in rows],
        "column string, role string, position int, data_type string, schema_json string",
    )
