"""Stand-in inputs built from the synthetic star-schema tables.

These functions only shape rows into the schemas the operators expect (raw
transactions, model predictions, messages, ...). They do none of the
operators' work: every split, feature, metric, comparison, drift statistic
and verdict is computed downstream by the library on whatever rows arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelgate.operators.common import bounded_broadcast
from modelgate.sources.tables import Tables

MODEL_NAME = "resale_price_model"

# Stand-in "models": price predictions as fixed formulas of the source
# columns, one per model version. Version 1 is registered as champion.
PREDICTION_FORMULAS = {
    "1": "l_extendedprice * CAST(0.95 + 0.0097 * (c_nationkey % 10) AS DOUBLE)",
    "2": "l_extendedprice * CAST(1.0 - (0.05 - 0.0097 * (c_nationkey % 10)) * (0.85 + 0.001 * c_nationkey) AS DOUBLE)",
    "3": "l_extendedprice * CAST(CASE WHEN c_nationkey % 5 = 0 THEN 1.2 + 0.01 * (c_nationkey % 3) ELSE 1.0 - (0.05 - 0.0097 * (c_nationkey % 10)) * (0.85 + 0.001 * c_nationkey) END AS DOUBLE)",
    "4": "l_extendedprice * CAST(CASE WHEN c_nationkey = 0 THEN 1.08 ELSE 1.0 - (0.05 - 0.0097 * (c_nationkey % 10)) * (0.85 + 0.001 * c_nationkey) END AS DOUBLE)",
}


def _lease_text(k: Column) -> Column:
    years = (F.lit(99) - F.col("p_size")).cast("string")
    return (
        F.when(k == 0, F.concat(years, F.lit(" years "), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit(" months")))
        .when(k == 1, F.concat(years, F.lit(" years")))
        .when(k == 2, F.concat(F.col("l_linenumber").cast("string"), F.lit(" months")))
        .when(k == 3, F.concat(years, F.lit(".5")))
    )


def sales_source(t: Tables) -> DataFrame:
    """lineitem ⋈ orders ⋈ part ⋈ customer ⋈ nation with the columns the
    stand-ins need. lineitem ⋈ orders is a shuffle (sort-merge) join on the
    order key — both are fact-sized; part and customer are left to AQE's
    runtime size check; nation is broadcast after a row-count check."""
    li = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    p = t.part.select("p_partkey", "p_type", "p_size", "p_retailprice")
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    n = bounded_broadcast(t.nation.select("n_nationkey", "n_name"), max_rows=10_000)
    # lineitem and orders are both fact-sized: a shuffle (sort-merge) join
    # on the order key, which also spreads the per-row work over the
    # shuffle partitions; part and customer are left to AQE.
    return (
        li.join(o.hint("merge"), li.l_orderkey == o.o_orderkey)
        .join(p, li.l_partkey == p.p_partkey)
        .join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
    )


def raw_columns() -> list[Column]:
    """Raw transaction schema (all strings) as projections of ``sales_source``."""
    key = F.col("l_orderkey")
    size = F.col("p_size")
    return [
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.col("n_name").alias("town"),
        F.col("c_mktsegment").alias("flat_type"),
        F.col("p_type").alias("flat_model"),
        F.when(key % 97 == 0, F.lit(""))
        .otherwise(F.concat(F.lpad(size.cast("string"), 2, "0"), F.lit(" TO "), F.lpad((size + 2).cast("string"), 2, "0")))
        .alias("storey_range"),
        F.when(key % 89 == 0, F.lit("n/a")).otherwise(F.col("l_quantity").cast("string")).alias("floor_area_sqm"),
        (F.year("o_orderdate") - size).cast("string").alias("lease_commence_date"),
        _lease_text(key % 5).alias("remaining_lease"),
        F.col("l_extendedprice").cast("string").alias("resale_price"),
    ]


def raw_sales_with_predictions(t: Tables, versions: list[str] | None = None) -> DataFrame:
    """Raw transactions plus one ``prediction_<v>`` column per stand-in model."""
    src = sales_source(t)
    versions = versions or list(PREDICTION_FORMULAS)
    preds = [F.expr(PREDICTION_FORMULAS[v]).alias(f"prediction_{v}") for v in versions]
    return src.select(*raw_columns(), *preds)


def prediction_columns(versions: list[str] | None = None) -> dict[str, str]:
    versions = versions or list(PREDICTION_FORMULAS)
    return {v: f"prediction_{v}" for v in versions}
