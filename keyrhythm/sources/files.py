"""Readers for profile texts, keystroke logs, session JSON and wide CSV tables."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from keyrhythm.config import KEYSTROKE_FIELDS, PROFILE_FIELDS
from keyrhythm.functions.numeric import to_number
from keyrhythm.functions.text import id_from_log_path, id_from_profile_path, profile_fields
from keyrhythm.operators.prefix import positions
from keyrhythm.operators.ranges import with_range
from keyrhythm.sources.raw import opened

DURATIONS = ("Hold time", "Latency time", "Flight time")
KEYSTROKE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in KEYSTROKE_FIELDS])

# Field names of the session JSON.
SESSION_SCHEMA = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("profile", T.StructType([T.StructField(c, T.StringType()) for c in ("Gender", "Tremors", "Sided")])),
    T.StructField("keys", T.ArrayType(T.StructType(
        [T.StructField(c, T.StringType())
         for c in ("Hand", "Hold time", "Direction", "Latency time", "Flight time")]
    ))),
])
# End of fixed values.


#: Bytes of a log that one task reads at most, but for the end of its last line, and of the lines it holds at a time.
PIECE, BLOCK = 64 << 20, 1 << 20
#: Names of files that cannot be read from their middle.
PACKED = (".gz", ".bz2", ".zst", ".lz4")


def _found(spark: SparkSession, paths: Sequence[str], piece: int | None = None) -> DataFrame:
    """(folder, file, start, stop) of the files in folders that are not empty, in as many parts as a shuffle has.

    A task lists the folders, not the driver, which therefore holds no file's status; and Spark's own
    reader would take a task for every few small files. A file of more than ``piece`` bytes has several rows.
    """
    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, base = opened(path)
                if system.get_file_info(base).is_file:
                    folder, file = path.rsplit("/", 1) if "/" in path else (".", path)
                    yield from _pieces(folder, [(file, system.get_file_info(base).size)], piece)
                elif isinstance(system, fs.LocalFileSystem):
                    with os.scandir(base) as entries:
                        yield from _pieces(path, ((e.name, e.stat().st_size) for e in entries if e.is_file()), piece)
                else:
                    listed = system.get_file_info(fs.FileSelector(base))
                    yield from _pieces(path, ((f.base_name, f.size) for f in listed if f.is_file), piece)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    folders = spark.createDataFrame([(path,) for path in paths], "path string").coalesce(1)
    return folders.mapInArrow(names, "folder string, file string, start bigint, stop bigint").repartition(parts, "file", "start")


def _pieces(folder: str, files: Iterator[tuple[str, int]], piece: int | None, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    found = (
        (name, start, min(size, start + step))
        for name, size in files if size and not name.startswith(("_", "."))
        for step in [size if piece is None or name.endswith(PACKED) else piece]
        for start in range(0, size, step)
    )
    while some := list(islice(found, rows)):
        file, start, stop = zip(*some)
        yield pa.RecordBatch.from_pydict({
            "folder": pa.array([folder] * len(some), pa.string()), "file": pa.array(file, pa.string()),
            "start": pa.array(start, pa.int64()), "stop": pa.array(stop, pa.int64())})


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, user_id, place) of the profile files in a folder, in the order of their names. Contents are not read."""
    files = _found(spark, [path]).select("file")
    ranged = with_range(files, "_range", ["file"])
    placed = positions(ranged, [], ["file"], F.col("_range"), "place", "_of").drop("_range", "_of")
    return placed.select("file", id_from_profile_path("file").alias("user_id"), "place")


def read_profiles(spark: SparkSession, path: str, fields: Sequence[str] = tuple(PROFILE_FIELDS)) -> DataFrame:
    """One row per ``User_<id>.txt`` file of ``Key: value`` lines; every field stays text."""
    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                texts = []
                for folder, file in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    system, base = opened(folder)
                    with system.open_input_stream(f"{base}/{file}", compression=None) as stream:
                        texts.append(stream.read())
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(texts, pa.binary())], names=["file", "bytes"])

    files = _found(spark, [path]).mapInArrow(contents, "file string, bytes binary")
    files = files.select("file", F.col("bytes").cast("string").alias("value"))
    return files.select(id_from_profile_path("file").alias("user_id"), *profile_fields("value", fields))


def _blocks(folder: str, file: str, start: int, stop: int, size: int) -> Iterator[bytes]:
    """The lines that begin in a piece of a file, about ``size`` bytes of whole lines at a time."""
    system, base = opened(folder)
    if file.endswith(PACKED):
        stream, stop = system.open_input_stream(f"{base}/{file}"), float("inf")
    else:
        stream = system.open_input_file(f"{base}/{file}")
        stream.seek(max(0, start - 1))
    with stream, io.BufferedReader(stream, min(size, 1 << 16)) as lines:
        at = start - 1 + len(lines.readline()) if start else 0
        while at < stop and (block := lines.read(min(size, stop - at))):
            if not block.endswith(b"\n"):
                block += lines.readline()
            yield block.removeprefix(b"\xef\xbb\xbf") if not at else block
            at += len(block)


def read_keystrokes(spark: SparkSession, path: str | list[str], piece: int = PIECE, block: int = BLOCK) -> DataFrame:
    """All ``<id>_<yymm>.txt`` logs as one table of text columns. ``path``: folders of logs, or single logs.

    Rows end in an extra tab; the fixed schema leaves the empty ninth field out. ``file_id`` is
    the id in the file name, by which whole files are chosen. Many small logs are read by one task, and a
    log of more than ``piece`` bytes by several.
    """
    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, texts, held = [], [], 0
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                for text in _blocks(*row, block):
                    files.append(row[1])
                    texts.append(text)
                    held += len(text)
                    if held >= block:
                        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(texts, pa.binary())], names=["file", "lines"])
                        files, texts, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(texts, pa.binary())], names=["file", "lines"])

    found = _found(spark, [path] if isinstance(path, str) else path, piece)
    texts = found.mapInArrow(contents, "file string, lines binary")
    lines = texts.select("file", F.explode(F.split(F.col("lines").cast("string"), "\r\n|\r|\n")).alias("line"))
    told = F.from_csv("line", ", ".join(f"`{c}` string" for c in KEYSTROKE_FIELDS), {"sep": "\t", "mode": "PERMISSIVE"})
    # Lines without any visible character are no rows, as in Spark's own reader.
    rows = lines.where(F.col("line").rlike("[^\\x00-\\x20]")).select(told.alias("_row"), id_from_log_path("file").alias("file_id"))
    return rows.select("_row.*", "file_id")


def typed_keystrokes(rows: DataFrame) -> DataFrame:
    """The three durations as doubles; text that is no number becomes NULL."""
    return rows.withColumns({c: to_number(f"`{c}`") for c in DURATIONS})


def union_logs(parts: Sequence[DataFrame]) -> DataFrame:
    """Logs from separate sources as one table, matched by column name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``{session_id, profile, keys}``, one typing session each."""
    return spark.read.schema(SESSION_SCHEMA).json(path)


def sessions_from_posts(posts: DataFrame, session_id: str = "session_id", payload: str = "payload") -> DataFrame:
    """Sessions from the posted form ``[profile, key, key, ...]`` held in a text column."""
    profile, key = SESSION_SCHEMA["profile"].dataType, SESSION_SCHEMA["keys"].dataType.elementType
    element = T.StructType([*profile.fields, *key.fields])
    items = posts.select(F.col(session_id).alias("session_id"), F.from_json(payload, T.ArrayType(element)).alias("_items"))

    def only(item, names):
        return F.struct(*[item[c].alias(c) for c in names])

    keys = F.slice("_items", F.lit(2), F.greatest(F.size("_items") - 1, F.lit(0)))
    return items.select(
        "session_id",
        only(F.get("_items", F.lit(0)), profile.names).alias("profile"),
        F.transform(keys, lambda k: only(k, key.names)).alias("keys"),
    )


def write_table(df: DataFrame, path: str, form: str = "csv") -> None:
    """CSV with a header, tab-separated text without one, JSON lines, or Parquet."""
    if form == "csv":
        df.write.option("header", True).csv(path)
    elif form == "tsv":
        df.write.option("sep", "\t").option("header", False).csv(path)
    elif form == "json":
        # Repeated field names make up most of JSON lines; the readers unpack them by the files' names.
        df.write.option("compression", "gzip").json(path)
    else:
        df.write.format(form).save(path)


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_tsv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").csv(path)
