"""Schemas and fixed values shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values live in modelgate.fixed; re-exported here for the schemas.
from modelgate.fixed import *  # noqa: E402,F401,F403
from modelgate.fixed import (  # noqa: E402
    CATEGORICAL_FEATURES,
    DATE_COLUMN,
    NUMERIC_FEATURES,
    RAW_COLUMNS,
    TARGET_COLUMN,
)

FEATURE_COLUMNS = CATEGORICAL_FEATURES + NUMERIC_FEATURES
PREPARED_COLUMNS = [DATE_COLUMN, TARGET_COLUMN, *FEATURE_COLUMNS]

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])

PREPARED_SCHEMA = T.StructType(
    [
        T.StructField(DATE_COLUMN, T.DateType(), True),
        T.StructField(TARGET_COLUMN, T.DoubleType(), True),
        *[T.StructField(c, T.StringType(), True) for c in CATEGORICAL_FEATURES],
        *[T.StructField(c, T.DoubleType(), True) for c in NUMERIC_FEATURES],
    ]
)

MODEL_KEY = ["model_name", "model_version"]
