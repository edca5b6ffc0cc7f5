"""Places in a sorted order, for groups of any size.

A window numbers the rows of a group in one task. Here the rows are spread by
ranges of (keys, order): bounds are sampled by Spark, every task sorts its own
range and numbers its rows, each (group, range) reports its rows, the counts of
a group's earlier ranges are prefix sums over one row per range, and the sum of
both is a row's place. A group of all rows is spread over all tasks, and many
small groups share them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: ``monotonically_increasing_id``: the partition above these bits, the row's
#: place in it below.
ROW_BITS = 33


def place_in_group(df: DataFrame, keys: list[str], order: list[Column], place: str = "place") -> DataFrame:
    """``df`` with every row's place (from 1, without gaps) in its group by
    ``order``. ``order`` should be total: rows that it ties get neighbouring
    places in any order, and stay in one task. Null keys make a group.

    The sorted rows are written once (their ranges are drawn by sampling, so
    both uses must see the same ones); what is joined to them has a row per
    group and range."""
    from modelgate.session import cut_lineage

    by = [F.col(f"`{k}`") for k in keys]
    sorted_ = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    rows = cut_lineage(sorted_.withColumn("__id", F.monotonically_increasing_id()), name="ranges")
    part = F.shiftright("__id", ROW_BITS)
    counts = rows.groupBy(*by, part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)],
        "__part",
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
    )
    same = part == F.col("__part")
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}"))
    joined = rows.join(starts, same)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__id") + F.col("__shift") + 1).alias(place))
