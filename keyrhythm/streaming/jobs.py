"""Streaming jobs: session scoring and running per-entity statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from keyrhythm.config import FeatureConfig
from keyrhythm.operators import sketch
from keyrhythm.operators.profile import Measure, observations, profile_counts, value_counts
from keyrhythm.plans.scoring import score_sessions
from keyrhythm.sources.files import SESSION_SCHEMA


def session_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Arriving JSON-lines files of sessions."""
    reader = spark.readStream.schema(SESSION_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def start_session_scoring(sessions: DataFrame, model, sink: str, checkpoint: str,
                          config: FeatureConfig | None = None, **options) -> StreamingQuery:
    """Append the prediction of every arriving session to a Parquet table.

    Stateless: a session is complete in its own record.
    """
    scored = score_sessions(sessions, model, config, **options)
    return (
        scored.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(sink)
    )


def table_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table as a stream, be it one file or a folder of files."""
    glob = path[:-1] + "[" + path[-1] + "]"
    return spark.readStream.schema(schema).parquet(glob)


def start_running_counts(rows: DataFrame, key: str, measures: Sequence[Measure], checkpoint: str) -> StreamingQuery:
    """Count the values of every (key, measure, level) as rows arrive.

    The state is the exact summary itself, one entry per distinct value, so it is spread by value
    even when a single key sends a third of the stream. It is read from the state store; no
    sink is needed.
    """
    counts = value_counts(observations(rows, key, measures), [key, "measure", "category"])
    return (
        counts.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def running_counts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The counts held by the job's state store: (key, measure, category, value, n)."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.*", F.col("value.count").alias("n"))


def running_profile(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """Statistics of all rows seen so far, by the same formulas as in batch."""
    return profile_counts(running_counts(spark, checkpoint), [key, "measure", "category"])


def start_window_states(rows: DataFrame, key: str, measures: Sequence[Measure], ts: str, checkpoint: str, sink: str,
                        window: str = "1 hour", delay: str = "10 minutes", size: int = sketch.SIZE) -> StreamingQuery:
    """Append the state of every (window, key, measure, level) to a Parquet table once its window is over.

    The job's own state holds a bounded sketch for each group of the windows that are still open:
    a window is dropped when the watermark (the latest time seen, less ``delay``) passes its end.
    Rows that come later than that are not counted.
    """
    timed = observations(rows.withWatermark(ts, delay), key, measures, keep=[ts])
    parts = sketch.states(timed, [F.window(ts, window).alias("window"), key, "measure", "category"], size=size)
    return (
        parts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in parts.columns if c != "window"])
        .writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(sink)
    )


def windowed_profile(spark: SparkSession, sink: str, key: str, by_window: bool = False) -> DataFrame:
    """Statistics of the closed windows, each or all together by (key, measure, level)."""
    keys = [*(["window_start", "window_end"] if by_window else []), key, "measure", "category"]
    parts = spark.read.parquet(sink)
    return sketch.statistics(parts if by_window else sketch.merged_states(parts, keys), keys)
