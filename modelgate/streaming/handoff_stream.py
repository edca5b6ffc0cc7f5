"""Hand-off packets arriving in a folder become review records.

The policy-gate step writes one nested JSON packet per gated version. This
Structured Streaming job picks up new packet files as they land, turns each
packet into a review record (pending, or already completed for automatic
rejections) and appends the records to a parquet reviews table. Progress is
kept in the stream checkpoint, so a restarted or failed job neither loses
nor repeats packets. The creation time of a review is the packet file's
modification time, never the wall clock of the task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from modelgate.functions.text import review_id
from modelgate.fixed import AUTO_REJECT_ACTION, PENDING_ACTION
from modelgate.schema import REVIEW_STATUS_AUTO_REJECTED, REVIEW_STATUS_PENDING
from modelgate.sources.io import HANDOFF_DDL


def review_records(packets: DataFrame, created_at, thread_id: str) -> DataFrame:
    """Review rows from hand-off packets (batch or stream)."""
    auto = F.col("status") == REVIEW_STATUS_AUTO_REJECTED
    return packets.select(
        review_id(created_at, F.col("model_name"), F.col("model_version"), F.lit(thread_id)).alias("review_id"),
        "model_name", "model_version",
        F.when(auto, F.lit(REVIEW_STATUS_AUTO_REJECTED)).otherwise(F.lit(REVIEW_STATUS_PENDING)).alias("status"),
        created_at.alias("created_at"),
        F.when(auto, created_at).alias("completed_at"),
        F.lit(thread_id).alias("thread_id"),
        F.col("candidate_metrics").alias("candidate_metrics"),
        F.col("policy_verdict").alias("policy_verdict"),
        F.when(auto, F.lit("auto_reject")).otherwise(F.lit("")).alias("human_decision"),
        F.when(auto, F.lit("rejected")).otherwise(F.lit(REVIEW_STATUS_PENDING)).alias("outcome"),
        F.when(auto, F.lit(AUTO_REJECT_ACTION)).otherwise(F.lit(PENDING_ACTION)).alias("action_required"),
    )


def start_review_stream(
    spark: SparkSession,
    handoff_dir: str,
    reviews_dir: str,
    checkpoint_location: str,
    thread_id: str = "handoff",
    available_now: bool = True,
) -> StreamingQuery:
    """Start the stream; ``available_now`` processes what is there and stops
    (batch-style scheduling), otherwise it keeps polling for new packets."""
    packets = spark.readStream.schema(HANDOFF_DDL).json(handoff_dir).select("*", "_metadata.file_modification_time")
    records = review_records(packets, F.col("file_modification_time"), thread_id)
    writer = (
        records.writeStream.format("parquet")
        .option("path", reviews_dir)
        .option("checkpointLocation", checkpoint_location)
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
