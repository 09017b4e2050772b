"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster use the one the cluster gives."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("keyrhythm")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only on a local master, where that setting is missing, does this choose one itself. On a cluster
    there is no folder that is shared by definition, so a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    chosen = tempfile.mkdtemp(prefix="keyrhythm-")
    spark.conf.set("spark.checkpoint.dir", chosen)
    return chosen


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for written tables and stream checkpoints."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the plan so far is replaced by files that outlive an executor."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table as Parquet files in the shared folder, for one that is read several times and by few columns at a time."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def settled(df: DataFrame, rows_per_task: int = 50_000) -> DataFrame:
    """A table that loops of model fits read again and again.

    Written once to the shared folder, so a lost executor costs a re-read and not the features'
    whole lineage; cached; and, if it proves small, held in few partitions, because every
    iteration of a fit pays for each task. A large table keeps its partitions.
    """
    written = cut_lineage(df)
    tasks = max(1, -(-written.count() // rows_per_task))
    if tasks < written.rdd.getNumPartitions():
        written = written.coalesce(tasks)
    return written.persist()
