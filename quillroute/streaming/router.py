"""Routing of a stream of questions, and windowed route counts: an extension to the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.routing import penalty_routes

EVENT_CUES = {"click": "Find exact code", "view": "What concept feels like", "purchase": "Is a member a class of", "error": "What bridge connects"}


def questions_of(events: DataFrame) -> DataFrame:
    """qid, ts, question: each event as a question with a cue of its type."""
    cue = F.lit("Show")
    for kind, text in EVENT_CUES.items():
        cue = F.when(F.col("event_type") == kind, text).otherwise(cue)
    return events.select(F.col("event_id").alias("qid"), F.col("ts").cast("timestamp").alias("ts"), F.concat(cue, F.lit(" "), F.coalesce("props", F.lit(""))).alias("question"))


def route_counts(events: DataFrame, window: str = "1 hour", late: str | None = None) -> DataFrame:
    """Routed events per window and route; with ``late`` a watermark bounds the state."""
    q = questions_of(events)
    if late:
        q = q.withWatermark("ts", late)
    r = penalty_routes(q)
    return r.groupBy(F.window("ts", window).alias("w"), "route").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "route", "n")


def stream_route_counts(spark: SparkSession, path: str, checkpoint: str, sink: str, window: str = "1 hour", late: str = "1 day"):
    """A streaming query over a folder of event files, appended to Parquet window by window."""
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).parquet(path)
    return route_counts(events, window, late).writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
