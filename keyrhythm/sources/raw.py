"""Writers of the raw formats: one text file per profile, one log per user and month.

The tasks write the files themselves, under the names that the readers take the ids from. A repeated
task writes the same files again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F


def opened(folder: str):
    """(file system, path in it) of a folder."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_profile_files(profiles: DataFrame, folder: str, user_id: str = "user_id", text: str = "text") -> int:
    """Write ``User_<id>.txt`` for each row; returns how many."""
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        n = 0
        for batch in batches:
            for user, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_output_stream(f"{base}/User_{user}.txt") as file:
                    file.write((content or "").encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    # A short table is read by few tasks, but every row costs a file.
    rows = profiles.select(user_id, text).repartition(profiles.sparkSession.sparkContext.defaultParallelism, user_id)
    return rows.mapInArrow(put, "n bigint").agg(F.sum("n")).first()[0] or 0


def write_log_files(rows: DataFrame, folder: str, fields: Sequence[str], order: Sequence[str], user_id: str = "user_id",
                    date: str = "Date", partitions: int = 32) -> int:
    """Write ``<id>_<yymm>.txt`` for each user and month: tab-separated, with the extra tab and CRLF of the recorder.

    A file's rows are sorted in their task and streamed into it, never held together. Returns how many files.
    """
    line = F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in fields])
    name = F.concat_ws("_", user_id, F.substring(date, 1, 4))
    told = rows.select(name.alias("_name"), F.concat(line, F.lit("\t\r\n")).alias("_line"), *order)
    sorted_rows = told.repartition(partitions, "_name").sortWithinPartitions("_name", *order).select("_name", "_line")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        n, name, file = 0, None, None
        try:
            for batch in batches:
                for own, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if own != name:
                        if file:
                            file.close()
                        name, file, n = own, system.open_output_stream(f"{base}/{own}.txt"), n + 1
                    file.write(content.encode())
        finally:
            if file:
                file.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return sorted_rows.mapInArrow(put, "n bigint").agg(F.sum("n")).first()[0] or 0
