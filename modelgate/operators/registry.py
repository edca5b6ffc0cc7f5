"""Model registry as append-only tables.

Three tables hold all state: ``runs`` (one row per registered version, with
params and metrics maps), ``alias_events`` and ``tag_events``. Current state
is a fold: the latest event per key by ``(ts, seq)``, where a null value
means "removed". Folding is a grouped ``max_by`` (partial aggregation), so
no key's history is ever gathered into one task, and appends never rewrite
history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgate.fixed import (
    AUTO_REJECT_ACTION,
    BAD_DECISION_ERROR,
    CHAMPION_RUN_ERROR,
    DEFAULT_REJECT_REASON,
    PENDING_ACTION,
    REVIEW_COMPLETED,
    REVIEW_NOT_FOUND,
)
from modelgate.functions.text import fill
from modelgate.functions.text import review_id as review_id_expr
from modelgate.operators.common import top_k_per_group
from modelgate.operators.ordering import place_in_group
from modelgate.schema import (
    DECISION_REJECT,
    DEFAULT_HISTORY_DEPTH,
    FEATURE_COLUMNS,
    NUMERIC_FEATURES,
    REVIEW_STATUS_AUTO_REJECTED,
    REVIEW_STATUS_COMPLETED,
    REVIEW_STATUS_PENDING,
)

RUNS_DDL = (
    "model_name string, model_version string, run_id string, registered_at timestamp, "
    "params map<string,string>, metrics map<string,double>"
)
ALIAS_EVENTS_DDL = "model_name string, alias string, model_version string, ts timestamp, seq bigint"
TAG_EVENTS_DDL = "model_name string, model_version string, key string, value string, ts timestamp, seq bigint"

HISTORY_TAGS = ["promotion_status", "policy_verdict", "decision_source", "rejection_reasons"]


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


def _latest(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    order = F.struct("ts", "seq")
    return events.groupBy(*keys).agg(F.max_by(F.col(value), order).alias(value))


def compact_events(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Snapshot of an append-only event log: the latest event per key, kept
    as an event (with its ``ts``/``seq``, deletes included). Folding the
    snapshot together with newer events gives exactly the fold of the whole
    history, so long logs can be compacted periodically and current-state
    reads only touch the snapshot plus the tail."""
    latest = events.groupBy(*keys).agg(F.max_by(F.struct(value, "ts", "seq"), F.struct("ts", "seq")).alias("__e"))
    return latest.select(*keys, F.col(f"__e.{value}").alias(value), F.col("__e.ts").alias("ts"), F.col("__e.seq").alias("seq"))


def compact_alias_events(alias_events: DataFrame) -> DataFrame:
    return compact_events(alias_events, ["model_name", "alias"], "model_version")


def compact_tag_events(tag_events: DataFrame) -> DataFrame:
    return compact_events(tag_events, ["model_name", "model_version", "key"], "value")


def current_aliases(alias_events: DataFrame) -> DataFrame:
    """(model_name, alias, model_version) for aliases that are set now."""
    return _latest(alias_events, ["model_name", "alias"], "model_version").where(F.col("model_version").isNotNull())


def fold_tags(tag_events: DataFrame) -> DataFrame:
    """Current tags (model_name, model_version, key, value); deletes drop the key."""
    return _latest(tag_events, ["model_name", "model_version", "key"], "value").where(F.col("value").isNotNull())


def test_metrics(metrics: Column) -> Column:
    """Keep keys starting with 'test_' and drop that prefix (every occurrence)."""
    kept = F.map_filter(metrics, lambda k, v: k.startswith("test_"))
    return F.transform_keys(kept, lambda k, v: F.regexp_replace(k, "test_", ""))


def current_champion(alias_events: DataFrame, runs: DataFrame) -> DataFrame:
    """Champion per model: version, run id, test rmse/mae from the backing run.

    ``lookup_error`` is set (and metrics null) when the alias points at a
    version without a run; callers treat that as "no champion" plus an
    evidence error.
    """
    champ = current_aliases(alias_events).where(F.col("alias") == "champion").select(
        "model_name", F.col("model_version").alias("champion_version")
    )
    r = runs.select("model_name", F.col("model_version").alias("champion_version"), "run_id",
                    test_metrics(F.col("metrics")).alias("m"))
    joined = champ.join(r, ["model_name", "champion_version"], "left")
    missing = F.col("run_id").isNull()
    err = fill(CHAMPION_RUN_ERROR, model=F.col("model_name"), version=F.col("champion_version"))
    return joined.select(
        "model_name",
        "champion_version",
        F.col("run_id").alias("champion_run_id"),
        F.col("m")["rmse"].alias("champion_rmse"),
        F.col("m")["mae"].alias("champion_mae"),
        F.when(missing, err).alias("lookup_error"),
    )


def normalize_tag_value(value: Column) -> Column:
    """Tag values are strings; booleans become 'true'/'false'; null and ''
    mean "do not set"."""
    s = value.cast("string")
    return F.when(s.isNull() | (s == ""), F.lit(None).cast("string")).otherwise(s)


def register_candidates(candidates: DataFrame, runs: DataFrame) -> dict[str, DataFrame]:
    """Append new versions for ``candidates``.

    ``candidates``: ``model_name, candidate_id, registered_at, params (map),
    validation_rmse, validation_mae, test_rmse, test_mae``. Versions continue
    from the model's current maximum (compared as numbers), in
    ``(registered_at, candidate_id)`` order. Returns the rows to append to
    ``runs``, ``alias_events`` (alias ``candidate``) and ``tag_events``
    (``promotion_status=candidate``).
    """
    base = runs.groupBy("model_name").agg(F.max(F.col("model_version").cast("bigint")).alias("__max"))
    ranked = place_in_group(candidates, ["model_name"], [F.col("registered_at"), F.col("candidate_id")], "__rank")
    numbered = ranked.join(base, "model_name", "left").withColumn(
        "model_version", (F.coalesce(F.col("__max"), F.lit(0)) + F.col("__rank")).cast("string")
    )
    metrics = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("validation_rmse", "validation_mae", "test_rmse", "test_mae")]),
        F.array(*[F.col(k).cast("double") for k in ("validation_rmse", "validation_mae", "test_rmse", "test_mae")]),
    )
    new_runs = numbered.select(
        "model_name", "model_version",
        F.concat_ws("-", F.lit("run"), F.col("model_name"), F.col("model_version")).alias("run_id"),
        "registered_at", F.col("params").cast("map<string,string>").alias("params"), metrics.alias("metrics"),
    )
    alias = numbered.select("model_name", F.lit("candidate").alias("alias"), "model_version",
                            F.col("registered_at").alias("ts"), F.col("model_version").cast("bigint").alias("seq"))
    tags = numbered.select("model_name", "model_version", F.lit("promotion_status").alias("key"),
                           F.lit("candidate").alias("value"), F.col("registered_at").alias("ts"),
                           F.lit(1).cast("bigint").alias("seq"))
    return {"runs": new_runs, "alias_events": alias, "tag_events": tags}


def training_history(runs: DataFrame, tag_events: DataFrame, max_versions: int = DEFAULT_HISTORY_DEPTH) -> DataFrame:
    """Newest ``max_versions`` versions per model (version compared as a
    number), with test metrics and past review outcomes from version tags."""
    ranked = top_k_per_group(
        runs, ["model_name"], [F.col("model_version").cast("bigint").desc(), F.col("model_version").desc()],
        max_versions,
    )
    tags = fold_tags(tag_events).where(F.col("key").isin(HISTORY_TAGS))
    wide = tags.groupBy("model_name", "model_version").pivot("key", HISTORY_TAGS).agg(F.first("value"))
    return ranked.join(wide, ["model_name", "model_version"], "left").select(
        "model_name",
        F.col("model_version").alias("version"),
        "run_id",
        F.col("metrics")["test_rmse"].alias("test_rmse"),
        F.col("metrics")["test_mae"].alias("test_mae"),
        *HISTORY_TAGS,
        "rank",
    )


def _iso(ts: Column) -> Column:
    """Python ``datetime.isoformat()`` of an aware UTC timestamp."""
    micros = F.date_format(ts, "SSSSSS")
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(base, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(F.lit("")), F.lit("+00:00"))


def decision_audit(decisions: DataFrame) -> DataFrame:
    """Audit tags of a decision as tag events.

    ``decisions``: ``model_name, model_version, decided_at, seq, decision
    (policy verdict), reasons (array), decision_source, reviewer,
    rejection_overridden``. Emits decision_source, decision_timestamp,
    policy_verdict, rejection_overridden, policy_reasons (when reasons
    exist) and decision_reviewer (when known); empty values are skipped.
    """
    reasons = F.when(F.size("reasons") > 0, F.array_join("reasons", "; "))
    entries = F.array(
        F.struct(F.lit("decision_source").alias("key"), F.col("decision_source").alias("value")),
        F.struct(F.lit("decision_timestamp").alias("key"), _iso(F.col("decided_at")).alias("value")),
        F.struct(F.lit("policy_verdict").alias("key"), F.col("decision").alias("value")),
        F.struct(F.lit("rejection_overridden").alias("key"), F.col("rejection_overridden").cast("string").alias("value")),
        F.struct(F.lit("policy_reasons").alias("key"), reasons.alias("value")),
        F.struct(F.lit("decision_reviewer").alias("key"), F.col("reviewer").cast("string").alias("value")),
    )
    exploded = decisions.select("model_name", "model_version", "decided_at", "seq",
                                F.posexplode(entries).alias("pos", "e"))
    return exploded.select(
        "model_name", "model_version", F.col("e.key").alias("key"), normalize_tag_value(F.col("e.value")).alias("value"),
        F.col("decided_at").alias("ts"), (F.col("seq") * 100 + 10 + F.col("pos")).cast("bigint").alias("seq"),
    ).where(F.col("value").isNotNull())


def apply_decisions(decisions: DataFrame) -> dict[str, DataFrame]:
    """Registry events for final outcomes.

    ``decisions`` as in ``decision_audit`` plus ``outcome`` ('promoted' or
    'rejected'). Promoted: alias champion moves to the version, status
    'champion', audit tags, and ``rejection_reasons`` removed. Rejected:
    status 'rejected', reasons joined with '; ' (default reason when none),
    audit tags.
    """
    promoted = F.col("outcome") == "promoted"
    reasons = F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit(DEFAULT_REJECT_REASON)))
    alias = decisions.where(promoted).select(
        "model_name", F.lit("champion").alias("alias"), "model_version", F.col("decided_at").alias("ts"),
        (F.col("seq") * 100).cast("bigint").alias("seq"),
    )
    status = decisions.select(
        "model_name", "model_version",
        F.posexplode(F.array(
            F.struct(F.lit("promotion_status").alias("key"),
                     F.when(promoted, F.lit("champion")).otherwise(F.lit("rejected")).alias("value"),
                     F.lit(True).alias("keep")),
            F.struct(F.lit("rejection_reasons").alias("key"),
                     F.when(promoted, F.lit(None).cast("string")).otherwise(F.array_join(reasons, "; ")).alias("value"),
                     F.lit(True).alias("keep")),
        )).alias("pos", "e"),
        "decided_at", "seq",
    )
    # For a promotion the rejection_reasons event carries null = delete; it is
    # ordered after the audit tags, as the removal happens last.
    status_events = status.select(
        "model_name", "model_version", F.col("e.key").alias("key"), F.col("e.value").alias("value"),
        F.col("decided_at").alias("ts"),
        (F.col("seq") * 100 + F.when(F.col("pos") == 0, F.lit(1)).otherwise(F.lit(50))).cast("bigint").alias("seq"),
    )
    # Audit tags carry the verdict's own reasons (no default line).
    tags = status_events.unionByName(decision_audit(decisions))
    return {"alias_events": alias, "tag_events": tags}


def judge_metrics(payloads: DataFrame, payload_column: str = "judge_evaluation") -> DataFrame:
    """Judge scores to log: only for status 'scored', numeric (not boolean)
    values, keys prefixed 'judge_'. One row per (row keys, metric).

    One typed JSON parse: a score field typed double is null unless the
    JSON value is a number, so booleans and strings drop out by themselves.
    """
    keys = ["completeness", "accuracy", "actionability", "safety", "average"]
    schema = "status string, scores struct<" + ", ".join(f"{k}: double" for k in keys) + ">"
    parsed = payloads.withColumn("__j", F.from_json(F.col(payload_column), schema))
    others = [c for c in payloads.columns if c != payload_column]
    entries = F.array(*[
        F.struct(F.lit(f"judge_{k}").alias("metric"), F.col("__j.scores")[k].alias("value")) for k in keys
    ])
    out = parsed.where(F.col("__j.status") == "scored").select(*others, F.explode(entries).alias("e"))
    return out.where(F.col("e.value").isNotNull()).select(*others, F.col("e.metric").alias("metric"), F.col("e.value").alias("value"))


def input_example(scored: DataFrame, n: int = 5, order: list[str] | None = None) -> DataFrame:
    """First ``n`` rows of the feature columns in an explicit order, numeric
    features as double (a bounded top-n, the feature itself)."""
    order = order or ["sale_month", *FEATURE_COLUMNS]
    cols = [F.col(c).cast("double").alias(c) if c in NUMERIC_FEATURES else F.col(c) for c in FEATURE_COLUMNS]
    return scored.orderBy(*order).limit(n).select(*cols)


def open_reviews(routed: DataFrame, created_at: Column, thread_id: Column) -> DataFrame:
    """One review packet per gated candidate.

    ``routed``: a ``route_reviews`` result (plus any report columns). REJECT
    packets are already completed (``auto_rejected``, outcome 'rejected');
    others wait (``pending_review``).
    """
    auto = F.col("status") == REVIEW_STATUS_AUTO_REJECTED
    return routed.select(
        review_id_expr(created_at, F.col("model_name"), F.col("model_version"), thread_id).alias("review_id"),
        "*",
        created_at.alias("created_at"),
        F.when(auto, created_at).alias("completed_at"),
        thread_id.alias("thread_id"),
        F.when(auto, F.lit("auto_reject")).otherwise(F.lit("")).alias("human_decision"),
        F.when(auto, F.lit("rejected")).otherwise(F.lit(REVIEW_STATUS_PENDING)).alias("outcome"),
        F.when(auto, F.lit(AUTO_REJECT_ACTION)).otherwise(F.lit(PENDING_ACTION)).alias("action_required"),
    )


def latest_reviews(review_events: DataFrame) -> DataFrame:
    """Latest state of every review (events ordered by ``(updated_at, seq)``)."""
    cols = [c for c in review_events.columns if c != "review_id"]
    latest = review_events.groupBy("review_id").agg(
        F.max_by(F.struct(*cols), F.struct("updated_at", "seq")).alias("r")
    )
    return latest.select("review_id", "r.*")


def resume_reviews(reviews: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """Apply a batch of human decisions to the latest review states.

    ``reviews``: latest states (``review_id, status, model_name,
    model_version, decision, reasons``). ``decisions``: ``review_id,
    decision_text, reviewer, decided_at, seq``. Per review only the earliest
    valid decision applies; later ones, unknown reviews, bad decision words
    (which leave the review open) and completed reviews go to ``errors``. Returns ``completed`` (review rows),
    ``registry`` (input for ``apply_decisions``) and ``errors``.
    """
    norm = F.lower(F.trim(F.col("decision_text")))
    valid_word = F.coalesce(F.col("human_decision").isin("approve", "reject"), F.lit(False))
    order = F.struct("decided_at", "seq", "human_decision", "reviewer")
    d = decisions.withColumn("human_decision", norm).withColumn("__order", order)
    # the valid decision that counts, as a partial aggregate: no review's
    # decisions meet in one window
    first = d.where(valid_word).groupBy("review_id").agg(F.min("__order").alias("__first"))
    d = d.join(first, "review_id", "left")
    r = reviews.select("review_id", "status", "model_name", "model_version", "decision", "reasons")
    j = d.join(r, "review_id", "left")
    error = (
        F.when(~valid_word, F.lit(BAD_DECISION_ERROR))
        .when(F.col("status").isNull(), fill(REVIEW_NOT_FOUND, review_id=F.col("review_id")))
        .when((F.col("status") == REVIEW_STATUS_COMPLETED) | (F.col("__order") != F.col("__first")), fill(REVIEW_COMPLETED, review_id=F.col("review_id")))
    )
    j = j.withColumn("error", error)
    ok = j.where(F.col("error").isNull()).dropDuplicates(["review_id"])  # a decision sent twice counts once
    approve = F.col("human_decision") == "approve"
    pending = F.col("status") == REVIEW_STATUS_PENDING
    source = (
        F.when(pending, F.lit("human_review"))
        .when(approve, F.lit("human_override_after_policy_reject"))
        .otherwise(F.lit("human_confirmed_reject"))
    )
    overridden = F.when(pending, approve & (F.col("decision") == DECISION_REJECT)).otherwise(approve)
    applied = ok.select(
        "review_id", "model_name", "model_version", "decided_at", "seq", "decision", "reasons", "reviewer",
        "human_decision",
        F.when(approve, F.lit("promoted")).otherwise(F.lit("rejected")).alias("outcome"),
        source.alias("decision_source"),
        overridden.alias("rejection_overridden"),
    )
    completed = applied.select(
        "review_id", F.lit(REVIEW_STATUS_COMPLETED).alias("status"), "human_decision", "outcome",
        F.col("decided_at").alias("completed_at"), F.col("decided_at").alias("updated_at"), "seq",
    )
    errors = j.where(F.col("error").isNotNull()).select("review_id", "decision_text", "decided_at", "error")
    return {"completed": completed, "registry": applied, "errors": errors}
