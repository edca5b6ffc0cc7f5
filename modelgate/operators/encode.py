"""One-hot encoding with the category dictionary as a table.

The dictionary has a row per category: its column, its value, its slot in
alphabetical order. It is made by ``distinct`` and by places in ranges, and
rows get their slots by joins, so a column of any number of categories never
passes through the driver; only the columns' widths do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelgate.operators.common import bounded_broadcast
from modelgate.operators.ordering import place_in_group


def category_dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, slot): the non-null values of each column, numbered from
    0 in alphabetical (byte) order."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    known = long.where(F.col("value").isNotNull()).distinct()
    placed = place_in_group(known, ["column"], [F.col("value")])
    return placed.select("column", "value", (F.col("place") - 1).cast("int").alias("slot"))


def widths(dictionary: DataFrame, columns: list[str]) -> dict[str, int]:
    """Number of categories of each column (a row per column reaches the driver)."""
    found = {r["column"]: r["n"] for r in dictionary.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {c: found.get(c, 0) for c in columns}


def slot_columns(df: DataFrame, dictionary: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``<column>__slot``: a row's slot in each column, null for a
    null or unknown category."""
    out = df
    for c in columns:
        own = dictionary.where(F.col("column") == c).select(F.col("value").alias(f"{c}__value"), F.col("slot").alias(f"{c}__slot"))
        out = out.join(bounded_broadcast(own), F.col(c).cast("string") == F.col(f"{c}__value"), "left").drop(f"{c}__value")
    return out


def one_hot(df: DataFrame, dictionary: DataFrame, columns: list[str], numeric: list[str] = ()) -> tuple[DataFrame, int]:
    """``df`` with the sparse vector ``indices``, ``values`` of its one-hot
    columns and then ``numeric`` (zeros left out, unknown categories in no
    slot), and the vector's length."""
    size = widths(dictionary, columns)
    entries: list[Column] = []
    offset = 0
    for c in columns:
        entries.append(F.when(F.col(f"{c}__slot").isNotNull(), F.struct((F.col(f"{c}__slot") + offset).alias("i"), F.lit(1.0).alias("v"))))
        offset += size[c]
    for j, c in enumerate(numeric):
        v = F.col(c).cast("double")
        entries.append(F.when(v != 0.0, F.struct(F.lit(offset + j).alias("i"), v.alias("v"))))
    pairs = F.array_compact(F.array(*entries))
    out = slot_columns(df, dictionary, columns)
    vector = out.withColumn("indices", F.transform(pairs, lambda e: e["i"])).withColumn("values", F.transform(pairs, lambda e: e["v"]))
    return vector.drop(*[f"{c}__slot" for c in columns]), offset + len(numeric)
