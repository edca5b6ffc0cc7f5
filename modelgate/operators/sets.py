"""Set-like operations that keep first-seen order: unique URLs, unique
lines, merged provider payloads. Each is a grouped ``min`` by position
(partial aggregation), so duplicates of a hot value collapse map-side; the
output stays in rows with an explicit order column, never one big array."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelgate.functions.text import strip_text
from modelgate.operators.ordering import place_in_group


def dedupe_urls(results: DataFrame, list_keys: list[str], order: str, url: str = "url") -> DataFrame:
    """Unique non-blank URLs per list, first occurrence wins;
    ``first_seen`` (the position of that occurrence) orders the result."""
    cleaned = results.select(*list_keys, F.col(order).alias("__ord"), strip_text(F.coalesce(F.col(url).cast("string"), F.lit(""))).alias("url"))
    return cleaned.where(F.col("url") != "").groupBy(*list_keys, "url").agg(F.min("__ord").alias("first_seen"))


def unique_lines(lines: DataFrame, keys: list[str], order: str, line: str = "line") -> DataFrame:
    """Keep a line unless blank or already present earlier in its document,
    comparing case-insensitively and ignoring outer whitespace."""
    norm = F.lower(strip_text(F.col(line)))
    return (
        lines.withColumn("__norm", norm)
        .where(F.col("__norm") != "")
        .groupBy(*keys, "__norm")
        .agg(F.min_by(F.col(line), F.col(order)).alias(line), F.min(order).alias(order))
        .drop("__norm")
    )


def merge_results(results: DataFrame, keys: list[str], provider_order: str, position: str) -> DataFrame:
    """All providers' result rows of each query as one list: every row of
    ``results`` with its ``place`` (from 1) in the lists joined in provider
    order, each in its own order (``position``; equal positions of a provider
    in any order). Nothing is dropped, and no list is gathered."""
    return place_in_group(results, keys, [F.col(provider_order), F.col(position)], "place")


def merged_sources(merged: DataFrame, keys: list[str], url: str = "url") -> DataFrame:
    """Unique non-blank urls of each query's merged list in first-seen order:
    ``first_seen`` is the place of a url's first result, ``source_place`` (from
    1) its place among the unique ones."""
    return place_in_group(dedupe_urls(merged, keys, "place", url), keys, [F.col("first_seen")], "source_place")


def merge_payloads(payloads: DataFrame, keys: list[str], provider_order: str) -> DataFrame:
    """Merge per-provider payload rows of each query.

    ``payloads``: keys, provider order, ``provider``, ``summary``, ``error``,
    ``model``. Returns per query: providers used (in order), summary lines
    ``provider: summary`` joined by blank lines, errors ``provider: error``
    and models. These lists are bounded by the number of providers.
    """
    p = F.struct(F.col(provider_order).alias("o"), "provider", strip_text(F.coalesce("summary", F.lit(""))).alias("summary"),
                 F.col("error").alias("error"), F.col("model").cast("string").alias("model"))
    g = payloads.groupBy(*keys).agg(F.array_sort(F.collect_list(p)).alias("__p"), F.count(F.lit(1)).alias("n_providers"))
    with_summary = F.filter("__p", lambda x: x["summary"] != "")
    with_error = F.filter("__p", lambda x: x["error"].isNotNull() & (x["error"] != ""))
    with_model = F.filter("__p", lambda x: x["model"].isNotNull() & (x["model"] != ""))
    return g.select(
        *keys,
        "n_providers",
        F.when(F.col("n_providers") == 1, F.element_at("__p", 1)["provider"]).otherwise(F.lit("both")).alias("provider"),
        F.transform("__p", lambda x: x["provider"]).alias("providers_used"),
        F.when(F.col("n_providers") == 1, F.element_at("__p", 1)["summary"]).otherwise(
            F.array_join(F.transform(with_summary, lambda x: F.concat(x["provider"], F.lit(": "), x["summary"])), "\n\n")
        ).alias("summary"),
        F.transform(with_error, lambda x: F.concat(x["provider"], F.lit(": "), x["error"])).alias("errors"),
        F.transform(with_model, lambda x: x["model"]).alias("models"),
    )
