"""Candidate versus current champion, overall and per segment.

Every candidate row is paired with the champion of its model by an equi
join on ``model_name``; per-segment deltas join the two segment tables on
``(model_name, segment_column, segment)``. Both join sides are model-level
tables (rows = models x segments), never observation rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelgate.schema import DEFAULT_SEGMENT_COLUMNS

from modelgate.fixed import CHAMPION_LOOKUP_ERROR, CHAMPION_SEGMENTS_ERROR, MISSING_SEGMENTS_ERROR  # noqa: E402
from modelgate.functions.text import fill  # noqa: E402


def metric_deltas(candidate: Column, champion: Column) -> tuple[Column, Column]:
    """(delta, delta_pct): missing values count as 0.0; pct is 0 unless the
    champion value is > 0."""
    cand = F.coalesce(candidate, F.lit(0.0))
    champ = F.coalesce(champion, F.lit(0.0))
    delta = cand - champ
    # Spark holds NaN > 0 true; here a NaN champion value is not positive
    pct = F.when((champ > 0) & ~F.isnan(champ), delta / champ).otherwise(F.lit(0.0))
    return delta, pct


def pair_with_champion(candidates: DataFrame, champions: DataFrame) -> DataFrame:
    """Left join candidates ``(model_name, model_version, rmse, mae, ...)`` to
    champions ``(model_name, champion_version, champion_rmse, champion_mae)``;
    adds ``has_champion`` and the four overall deltas (null without champion)."""
    joined = candidates.join(champions, "model_name", "left")
    has = F.col("champion_version").isNotNull()
    cols = [F.col(c) for c in candidates.columns]
    out = [*cols, "champion_version", "champion_rmse", "champion_mae", has.alias("has_champion")]
    for m in ("rmse", "mae"):
        d, p = metric_deltas(F.col(m), F.col(f"champion_{m}"))
        out += [F.when(has, d).alias(f"{m}_delta"), F.when(has, p).alias(f"{m}_delta_pct")]
    return joined.select(*out)


REPEATED_SEGMENT = "A segment has several rows: name the column that holds their load order."


def _last_rows(segments: DataFrame, load_order: str | None) -> DataFrame:
    """One row per segment: of rows that repeat one, the last by ``load_order``.
    Rows of a DataFrame have no order of their own, so without such a column a
    repeated segment is refused."""
    keys = ["model_name", "model_version", "segment_column", "segment"]
    if load_order is not None:
        rmse = F.max_by("rmse", load_order)
    else:
        rmse = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(REPEATED_SEGMENT)).cast("double")).otherwise(F.min("rmse"))
    return segments.where(F.col("segment").isNotNull() & F.col("rmse").isNotNull()).groupBy(*keys).agg(rmse.alias("rmse"))


def _order_of(segments: DataFrame, load_order: str | None) -> str | None:
    return load_order or ("ord" if "ord" in segments.columns else None)


def segment_deltas(
    candidate_segments: DataFrame,
    champion_segments: DataFrame,
    pairs: DataFrame,
    segment_columns=DEFAULT_SEGMENT_COLUMNS,
    load_order: str | None = None,
) -> DataFrame:
    """Per-segment rmse deltas of each candidate against its champion.

    ``load_order`` names the column that says which of several rows of one
    segment was loaded last (a column ``ord`` of the table is used by itself);
    tables without one must have a row per segment.

    ``*_segments``: ``(model_name, model_version, segment_column, segment, rmse)``;
    ``pairs``: ``(model_name, model_version, champion_version)``. Segments
    present on one side only are dropped, as are champion rmse <= 0 and rows
    without segment or rmse. ``ord`` = (segment column position, candidate
    rmse, segment) is the comparison order.
    """
    segment_columns = list(segment_columns)
    cand = (
        _last_rows(candidate_segments, _order_of(candidate_segments, load_order)).where(F.col("segment").isNotNull() & F.col("rmse").isNotNull())
        .where(F.col("segment_column").isin(segment_columns))
        .select("model_name", "model_version", "segment_column",
                F.col("segment").cast("string").alias("segment_value"), F.col("rmse").alias("candidate_rmse"))
    )
    champ = (
        _last_rows(champion_segments, _order_of(champion_segments, load_order)).where(F.col("segment").isNotNull() & F.col("rmse").isNotNull())
        .select("model_name", F.col("model_version").alias("champion_version"), "segment_column",
                F.col("segment").cast("string").alias("segment_value"), F.col("rmse").alias("champion_rmse"))
    )
    p = pairs.select("model_name", "model_version", "champion_version").where(F.col("champion_version").isNotNull())
    joined = cand.join(p, ["model_name", "model_version"]).join(
        champ, ["model_name", "champion_version", "segment_column", "segment_value"]
    ).where((F.col("champion_rmse") > 0) & ~F.isnan("champion_rmse"))
    delta = F.col("candidate_rmse") - F.col("champion_rmse")
    position = F.array_position(F.array(*[F.lit(c) for c in segment_columns]), F.col("segment_column")).cast("int")
    return joined.select(
        "model_name",
        "model_version",
        "champion_version",
        "segment_column",
        "segment_value",
        "candidate_rmse",
        "champion_rmse",
        delta.alias("rmse_delta"),
        (delta / F.col("champion_rmse")).alias("rmse_delta_pct"),
        F.struct(position.alias("pos"), F.col("candidate_rmse").alias("rmse"), F.col("segment_value").alias("seg")).alias("ord"),
    )


def evidence_errors(
    pairs: DataFrame, candidate_segments: DataFrame, lookup_errors: DataFrame | None = None,
    champion_segments: DataFrame | None = None, segment_columns=DEFAULT_SEGMENT_COLUMNS,
) -> DataFrame:
    """Per candidate: ``evidence_errors`` array. A champion exists but the
    candidate has no segment rows -> missing-segments error; a failed
    champion lookup (``lookup_errors``: model_name, detail) -> lookup error; a
    champion without rows for a segment column (``champion_segments``, where
    given, with ``champion_run_id`` in ``pairs`` or the version as its name)
    -> lookup error naming the columns."""
    has_rows = candidate_segments
    if "segment_column" in has_rows.columns:  # the overall row of an evaluation is no segment
        has_rows = has_rows.where(F.col("segment_column").isNotNull())
    seg_keys = has_rows.select("model_name", "model_version").distinct().withColumn("__has_seg", F.lit(True))
    out = pairs.join(seg_keys, ["model_name", "model_version"], "left")
    lookup_msg = F.lit(None).cast("string")
    if lookup_errors is not None:
        out = out.join(lookup_errors.select("model_name", F.col("detail").alias("__lookup")), "model_name", "left")
        lookup_msg = F.when(F.col("__lookup").isNotNull(), fill(CHAMPION_LOOKUP_ERROR, detail=F.col("__lookup")))
    champion_msg = F.lit(None).cast("string")
    if champion_segments is not None:
        seen = champion_segments.where(F.col("segment_column").isin(list(segment_columns))).groupBy(
            "model_name", F.col("model_version").alias("champion_version")
        ).agg(F.collect_set("segment_column").alias("__seen"))
        out = out.join(seen, ["model_name", "champion_version"], "left")
        lacking = F.array_except(
            F.array(*[F.lit(c) for c in segment_columns]), F.coalesce("__seen", F.array().cast("array<string>"))
        )
        run = F.col("champion_run_id") if "champion_run_id" in pairs.columns else F.col("champion_version")
        detail = fill(CHAMPION_SEGMENTS_ERROR, run=run, columns=F.array_join(lacking, ", "))
        champion_msg = F.when(F.col("has_champion") & (F.size(lacking) > 0), fill(CHAMPION_LOOKUP_ERROR, detail=detail))
    missing = F.when(F.col("has_champion") & F.col("__has_seg").isNull(), F.lit(MISSING_SEGMENTS_ERROR))
    errors = F.filter(F.array(lookup_msg, champion_msg, missing), lambda x: x.isNotNull())
    return out.select(*pairs.columns, errors.alias("evidence_errors"))
