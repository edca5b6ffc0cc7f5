"""Helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_BROADCAST_ROWS = 1_000_000


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only after checking it has at most ``max_rows`` rows;
    otherwise return it unchanged so the planner shuffles both sides.

    The check is one ``count`` of an already small table (dimension tables,
    month lists, per-column bounds); never call it on a fact table.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def require_columns(df: DataFrame, columns, what: str = "input") -> None:
    """Driver-side guard on the schema (no data is read)."""
    present = {c.lower() for c in df.columns}
    missing = [c for c in columns if c.lower() not in present]
    if missing:
        raise KeyError(f"Expected column(s) {missing} in the {what}.")


def long_predictions(
    df: DataFrame,
    prediction_columns: dict[str, str],
    model_name: str,
    keep: list[str],
) -> DataFrame:
    """Wide prediction columns -> long rows keyed by (model_name, model_version).

    ``unpivot`` is an Expand in the same stage: no shuffle.
    """
    ids = [c for c in keep]
    stacked = df.select(*ids, *[F.col(c).alias(v) for v, c in prediction_columns.items()])
    return (
        stacked.unpivot(ids, list(prediction_columns), "model_version", "prediction")
        .withColumn("model_name", F.lit(model_name))
        .select("model_name", "model_version", *ids, F.col("prediction").cast("double").alias("prediction"))
    )


def top_k_per_group(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    k: int,
    salt_buckets: int = 16,
    rank_column: str = "rank",
) -> DataFrame:
    """Exact top ``k`` rows per group by ``order`` (a total order), skew-safe.

    Stage 1 ranks inside ``(keys, salt)`` sub-groups (salt = hash of the
    row's order values), keeping ``k`` rows each; stage 2 ranks the at most
    ``k * salt_buckets`` survivors of each group. The global top ``k`` is a
    subset of the survivors, so the result is exact, and no task ever holds
    more than one salt slice of a hot group. The salt hashes the whole row,
    so it is deterministic under task retries.
    """
    from pyspark.sql import Window

    from pyspark.sql.types import MapType

    hashable = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, MapType)]
    salt = F.pmod(F.xxhash64(*hashable), F.lit(salt_buckets))
    staged = df.withColumn("__salt", salt)
    w1 = Window.partitionBy(*keys, "__salt").orderBy(*order)
    survivors = staged.withColumn("__rn", F.row_number().over(w1)).where(F.col("__rn") <= k)
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return (
        survivors.withColumn(rank_column, F.row_number().over(w2).cast("long"))
        .where(F.col(rank_column) <= k)
        .drop("__salt", "__rn")
    )


def rank_per_group(df: DataFrame, keys: list[str], first: str, then: list[Column], rank_column: str) -> DataFrame:
    """Exact rank (from 1) of every row in its group by ``first``, then
    ``then`` (a total order), without gathering a group in one task."""
    from modelgate.operators.ordering import place_in_group

    return place_in_group(df, keys, [F.col(first), *then], rank_column)
