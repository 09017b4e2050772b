"""Streaming jobs run to the end of the given tables and compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyrhythm.catalog import sqltext
from keyrhythm.catalog.profiles import STATS, VALUE
from keyrhythm.catalog.registry import query, table
from keyrhythm.catalog.sessions import DISCRIMINANT_SQL, fitted_discriminant, sessions
from keyrhythm.functions.numeric import rounded
from keyrhythm.session import new_folder
from keyrhythm.sources.files import write_table
from keyrhythm.streaming.jobs import (
    running_profile,
    session_stream,
    start_running_counts,
    start_session_scoring,
    start_window_states,
    table_stream,
    windowed_profile,
)


@query("stream_profile", "SELECT user_id, event_type, count(*) AS count, " + ", ".join(
    sqltext.rounded(sqltext.stat(s, "value"), s) for s in STATS
) + " FROM events WHERE value > 0 AND value < 200 GROUP BY user_id, event_type")
def stream_profile(spark, folder):
    schema = table(spark, folder, "events").schema
    rows = table_stream(spark, f"{folder}/events.parquet", schema).where((F.col("value") > 0) & (F.col("value") < 200))
    state = new_folder(spark, "running")
    start_running_counts(rows, "user_id", [VALUE], state).awaitTermination()
    out = running_profile(spark, state, "user_id")
    return out.select("user_id", F.col("category").alias("event_type"), "count", *[rounded(s).alias(s) for s in STATS])


@query("stream_session_score", DISCRIMINANT_SQL)
def stream_session_score(spark, folder):
    """What the stream wrote for each arriving session."""
    model = fitted_discriminant(spark, folder)
    inbox, sink = new_folder(spark, "sessions"), new_folder(spark, "scores")
    write_table(sessions(spark, folder), inbox, "json")
    start_session_scoring(session_stream(spark, inbox), model, sink, new_folder(spark, "scoring")).awaitTermination()
    return spark.read.parquet(sink).select("session_id", "prediction")


@query("stream_window_profile", "WITH w AS (SELECT *, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start FROM events) "
       "SELECT user_id, event_type, count(*) AS count, " + ", ".join(
    sqltext.rounded(sqltext.stat(s, "value"), s) for s in ("mean", "amax", "amin", "var", "skew", "kurtosis")
) + " FROM w WHERE start + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY user_id, event_type")
def stream_window_profile(spark, folder):
    """Running statistics of bounded state: weekly sketches that leave the state when their week is over, merged from the sink."""
    schema = table(spark, folder, "events").schema
    rows = table_stream(spark, f"{folder}/events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    sink = new_folder(spark, "weeks")
    start_window_states(rows, "user_id", [VALUE], "ts", new_folder(spark, "weekly"), sink, "7 days", "1 day").awaitTermination()
    out = windowed_profile(spark, sink, "user_id")
    kept = ("mean", "amax", "amin", "var", "skew", "kurtosis")
    return out.select("user_id", F.col("category").alias("event_type"), "count", *[rounded(s).alias(s) for s in kept])
