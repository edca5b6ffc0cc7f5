"""The registry life cycle of a gated fleet, as appends and folds.

register every candidate -> gate verdicts -> open review packets (REJECT is
executed at once as an automatic rejection) -> a batch of human decisions is
applied -> alias and tag events are appended -> current state is folded.

Times are inputs (no wall clock inside an operator).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelgate.operators import registry as R
from modelgate.plans.gate import GateJob
from modelgate.schema import DECISION_PROMOTE, REVIEW_STATUS_AUTO_REJECTED, REVIEW_STATUS_PENDING

REGISTERED_AT = dt.datetime(2024, 1, 1, 8, 0, 0)
REVIEW_OPENED_AT = dt.datetime(2024, 1, 2, 9, 30, 0)
DECIDED_AT = dt.datetime(2024, 1, 3, 14, 15, 30)
LATE_DECISION_AT = dt.datetime(2024, 1, 4, 10, 0, 0)
EARLY_DECISION_AT = DECIDED_AT - dt.timedelta(hours=1)
REVIEWER = "fleet-reviewer"
THREAD_ID = "fleet"
BOOTSTRAP_CHAMPION = "1"


def _ts(value: dt.datetime):
    """Timestamp from wall-clock text (read and rendered in the session time
    zone, so results do not depend on the Python process's zone)."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


@dataclass
class RegistryFlow:
    job: GateJob

    @property
    def spark(self):
        return self.job.spark

    @cached_property
    def registration(self) -> dict[str, DataFrame]:
        m = self.job.split_metrics
        candidates = m.select(
            "model_name",
            F.col("model_version").alias("candidate_id"),
            _ts(REGISTERED_AT).alias("registered_at"),
            F.create_map(F.lit("model.kind"), F.lit("stand-in formula")).alias("params"),
            "validation_rmse", "validation_mae", "test_rmse", "test_mae",
        )
        empty_runs = R.empty(self.spark, R.RUNS_DDL)
        return R.register_candidates(candidates, empty_runs)

    @cached_property
    def runs(self) -> DataFrame:
        return self.job._cut(self.registration["runs"])

    @cached_property
    def bootstrap(self) -> dict[str, DataFrame]:
        """The incumbent: version 1 holds the champion alias before the gate."""
        name = F.lit(self.job.model_name)
        alias = self.spark.range(1).select(name.alias("model_name"), F.lit("champion").alias("alias"),
                                           F.lit(BOOTSTRAP_CHAMPION).alias("model_version"),
                                           _ts(REGISTERED_AT).alias("ts"), F.lit(5).cast("bigint").alias("seq"))
        tag = self.spark.range(1).select(name.alias("model_name"), F.lit(BOOTSTRAP_CHAMPION).alias("model_version"),
                                         F.lit("promotion_status").alias("key"), F.lit("champion").alias("value"),
                                         _ts(REGISTERED_AT).alias("ts"), F.lit(6).cast("bigint").alias("seq"))
        return {"alias_events": alias, "tag_events": tag}

    @cached_property
    def reviews(self) -> DataFrame:
        routed = self.job.routed.select("model_name", "model_version", "decision", "reasons", "checks_passed",
                                        "checks_failed", "status", "rmse", "mae")
        return self.job._cut(R.open_reviews(routed, _ts(REVIEW_OPENED_AT), F.lit(THREAD_ID)).withColumn(
            "updated_at", F.col("created_at")
        ).withColumn("seq", F.lit(0).cast("bigint")))

    @cached_property
    def auto_decisions(self) -> DataFrame:
        auto = self.reviews.where(F.col("status") == REVIEW_STATUS_AUTO_REJECTED)
        return auto.select(
            "model_name", "model_version", F.col("created_at").alias("decided_at"),
            F.col("model_version").cast("bigint").alias("seq"), "decision", "reasons",
            F.lit("policy_auto_reject").alias("decision_source"), F.lit(None).cast("string").alias("reviewer"),
            F.lit(False).alias("rejection_overridden"), F.lit("rejected").alias("outcome"),
        )

    @cached_property
    def human_decisions(self) -> DataFrame:
        """Stand-in reviewer batch: approve pending PROMOTE verdicts, reject
        the other pending ones, confirm automatic rejections; then a second,
        late 'approve' for every review (which must be refused)."""
        r = self.reviews
        first = r.select(
            "review_id",
            F.when((F.col("status") == REVIEW_STATUS_PENDING) & (F.col("decision") == DECISION_PROMOTE), F.lit("Approve"))
            .otherwise(F.lit(" reject ")).alias("decision_text"),
            F.lit(REVIEWER).alias("reviewer"), _ts(DECIDED_AT).alias("decided_at"),
            F.col("model_version").cast("bigint").alias("seq"),
        )
        late = r.select("review_id", F.lit("approve").alias("decision_text"), F.lit(REVIEWER).alias("reviewer"),
                        _ts(LATE_DECISION_AT).alias("decided_at"), F.col("model_version").cast("bigint").alias("seq"))
        # a word that is no decision, sent before: the review stays open
        early = late.withColumn("decision_text", F.lit("maybe")).withColumn("decided_at", _ts(EARLY_DECISION_AT))
        unknown = late.withColumn("review_id", F.concat(F.lit("unknown-"), F.col("review_id")))
        return first.unionByName(late).unionByName(early).unionByName(unknown)

    @cached_property
    def resumed(self) -> dict[str, DataFrame]:
        return R.resume_reviews(R.latest_reviews(self.reviews.select(
            "review_id", "status", "model_name", "model_version", "decision", "reasons", "updated_at", "seq")),
            self.human_decisions)

    @cached_property
    def decisions(self) -> DataFrame:
        cols = ["model_name", "model_version", "decided_at", "seq", "decision", "reasons", "decision_source",
                "reviewer", "rejection_overridden", "outcome"]
        return self.job._cut(self.auto_decisions.select(*cols).unionByName(self.resumed["registry"].select(*cols)))

    @cached_property
    def decision_events(self) -> dict[str, DataFrame]:
        return R.apply_decisions(self.decisions)

    @cached_property
    def alias_events(self) -> DataFrame:
        return (self.registration["alias_events"].unionByName(self.bootstrap["alias_events"])
                .unionByName(self.decision_events["alias_events"]))

    @cached_property
    def tag_events(self) -> DataFrame:
        return (self.registration["tag_events"].unionByName(self.bootstrap["tag_events"])
                .unionByName(self.decision_events["tag_events"]))
