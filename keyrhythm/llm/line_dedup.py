"""Line dedup against levelled, sorted runs of line hashes. DataFrame operations only.

Documents come in batches, those with the largest ids first. A batch's line hashes are counted,
merge-anti-joined with the runs that exist (what no run knows is new, and the batch's largest
document keeps it), and written as one more run, bucketed and sorted by hash. When a level holds
``fanout`` runs they are merged into one run of the next level. The runs together give every
line's number of documents and its keeper.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from keyrhythm.llm.common import LOWER, SPACES, UPPER, packed, remove, unpacked, written
from keyrhythm.llm.registry import query, table
from keyrhythm.session import new_folder

HASH = ["_h1", "_h2"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def hashed(key: Column) -> list[Column]:
    """128 bits of a line's key."""
    return [F.xxhash64(key), F.xxhash64(F.lit(7), key)]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


class LineRuns:
    """Sorted runs of (hash, documents, keeper), kept by level as bucketed tables."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[tuple[str, str]]] = []

    def add(self, own: DataFrame) -> None:
        """``own``: the batch's distinct hashes with ``docs`` and ``keeper``.

        Hashes of earlier runs add their documents only: their keeper, of an earlier batch and so
        of a larger id, is known.
        """
        self.schema = own.schema
        own = own.repartition(self.buckets, *HASH)
        new, known = own, []
        for name, _ in self.runs():
            run = self.spark.table(name).select(*HASH)
            known.append(new.join(run, HASH, "left_semi"))
            new = new.join(run, HASH, "left_anti")
        for seen in known:
            new = new.unionByName(seen.withColumn("keeper", F.lit(None).cast(own.schema["keeper"].dataType)))
        self._write(new.repartition(self.buckets, *HASH), 0)

    def runs(self) -> list[tuple[str, str]]:
        return [run for level in self.levels for run in level]

    def totals(self) -> DataFrame:
        """Every hash once, with its documents and keeper over all runs."""
        return self._merged([folder for _, folder in self.runs()])

    def close(self) -> None:
        """Forget the tables' names and delete their files."""
        self._drop(self.runs())
        self.levels = []

    def _merged(self, folders: list[str]) -> DataFrame:
        # Plain files: a union of bucketed tables was taken for partitioned by hash when it was not.
        rows = self.spark.read.schema(self.schema).parquet(*folders)
        return rows.groupBy(*HASH).agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))

    def _write(self, rows: DataFrame, level: int) -> None:
        name, folder = f"line_run_{uuid.uuid4().hex}", new_folder(self.spark, "line-run")
        (rows.sortWithinPartitions(*HASH).write.format("parquet").bucketBy(self.buckets, *HASH)
         .sortBy(*HASH).option("path", folder).saveAsTable(name))
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append((name, folder))
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merged([f for _, f in full]).repartition(self.buckets, *HASH), level + 1)
            self._drop(full)

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, _ in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, [folder for _, folder in runs])


def _batch(doc_id: Column, borders: list) -> Column:
    """0 for the largest ids; NULL ids come last."""
    out = F.lit(len(borders))
    for i, border in enumerate(sorted(borders)):
        out = F.when(doc_id > F.lit(border), F.lit(len(borders) - 1 - i)).otherwise(out)
    return out


def drop_repeated_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5,
    batches: int = 3, fanout: int = 2, buckets: int | None = None,
) -> DataFrame:
    """All columns, the text without its repeated lines, and ``n_lines``, ``n_dropped`` (bigint).

    A line's key is the line without outer white space and with A-Z in lower case. Keys of at least
    ``min_chars`` code points in at least ``min_docs`` documents lose all their lines, except in the
    document with the largest id. A NULL or empty text has one empty line and comes back empty. Rows
    that repeat an id count as documents of their own, and all rows with the largest id keep the
    line. ``buckets`` of a run: the session's shuffle partitions unless given. A NULL id is smaller than any other; if no other holds the line, nothing is dropped. Input
    columns named like the new ones are replaced. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    names = docs.columns
    docs = packed(docs, ["n_lines", "n_dropped"], _doc=doc_id, _text=text)
    shares = [i / batches for i in range(1, batches)]
    borders = [b for b in (docs.agg(F.percentile_approx("_doc", shares, 1000)).first()[0] or []) if b is not None]
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col("_text")), line_key), lambda k: F.length(k) >= min_chars))
    lines = (docs.select(F.col("_doc").alias("_id"), F.explode(keys).alias("_key"))
             .select("_id", *[c.alias(n) for c, n in zip(hashed(F.col("_key")), HASH)], _batch(F.col("_id"), borders).alias("_batch")))
    folder = new_folder(spark, "lines")
    lines.write.partitionBy("_batch").parquet(folder)
    lines = spark.read.schema(lines.schema).parquet(folder)

    runs = LineRuns(spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), fanout)
    for i in range(len(borders) + 1):
        runs.add(lines.where(F.col("_batch") == i).groupBy(*HASH)
                 .agg(F.count(F.lit(1)).alias("docs"), F.max("_id").alias("keeper")))
    repeated = written(runs.totals().where((F.col("docs") >= min_docs) & F.col("keeper").isNotNull())
                       .select(*HASH, "keeper"), "repeated-lines")
    runs.close()

    losing = lines.join(repeated, HASH).where(~F.col("_id").eqNullSafe(F.col("keeper")))
    losing = losing.groupBy("_id").agg(F.collect_set(F.struct(*HASH)).alias("_losing"))
    out = docs.join(losing, F.col("_doc").eqNullSafe(F.col("_id")), "left")
    all_lines = lines_of(F.col("_text"))

    def stays(line: Column) -> Column:
        h1, h2 = hashed(line_key(line))
        return ~F.array_contains(F.col("_losing"), F.struct(h1.alias("_h1"), h2.alias("_h2")))

    out = out.withColumn("_kept", F.when(F.col("_losing").isNull(), all_lines).otherwise(F.filter(all_lines, stays)))
    n_lines = F.size(all_lines).cast("bigint")
    out = unpacked(out, F.array_join("_kept", "\n").alias("_cleaned"), n_lines.alias("n_lines"), (n_lines - F.size("_kept")).alias("n_dropped"))
    kept = [c for c in names if c not in ("n_lines", "n_dropped")]
    return out.select(*[F.col("_cleaned").alias(text) if c == text else F.col(f"`{c}`") for c in kept], "n_lines", "n_dropped")


OP10_SQL = r"""
WITH l AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents),
k AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (
    SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, r.key IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op10_line_dedup", OP10_SQL)
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = drop_repeated_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
