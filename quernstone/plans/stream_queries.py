"""Streaming queries over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.plans.bindings import table
from quernstone.plans.catalogue import query
from quernstone.streaming.ingest import append_stream, appended, working_folder


@query("stream_append_seq", "SELECT event_id, user_id AS binary_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def stream_append_seq(spark, d):
    """All events through a stream that appends them with their sequence."""
    schema = table(spark, d, "events").schema
    folder = working_folder(spark, "event-stream")
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    events = events.select(F.col("user_id").alias("binary_id"), "event_id", "ts")
    append_stream(events, folder, ["ts", "event_id"]).awaitTermination()
    return appended(spark, folder).select("event_id", "binary_id", "seq")
