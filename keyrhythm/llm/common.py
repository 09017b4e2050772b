"""Written tables, clean-up and small column helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from keyrhythm.session import new_folder

#: The white space of the word and line rules, as characters and as a regular expression.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table as files in the shared folder: read many times, and no lineage to lose."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def remove(spark: SparkSession, folders: Iterable[str]) -> None:
    """Delete written folders that a newer table has replaced."""
    jvm = spark._jvm
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        remove(table.sparkSession, {jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).getParent().toString() for f in table.inputFiles()})


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query go when it ends, and not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def n_words(text: Column) -> Column:
    """Words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def packed(df: DataFrame, replaced: Iterable[str] = (), **named: str) -> DataFrame:
    """All columns but the replaced ones in one struct ``_row``, and the ones needed under own names.

    So no column that a caller brings along can clash with an operator's working columns.
    """
    gone = set(replaced)
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in gone]).alias("_row"),
                     *[F.col(f"`{c}`").alias(name) for name, c in named.items()])


def unpacked(df: DataFrame, *more: Column | str) -> DataFrame:
    """The callers' columns again, and further ones."""
    return df.select("_row.*", *more)


def with_extremes(rows: DataFrame, group: str, value: str, spread: str, salts: int = 64) -> DataFrame:
    """Add to each row its group's number of rows ``_n`` and smallest and largest value, ``_low`` and ``_high``.

    A group is counted and joined in ``salts`` parts, chosen by a hash of ``spread``, so one that holds
    a third of all rows is not one task's. The window sees at most ``salts`` rows of a group.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    parts = salted.groupBy(group, "_salt").agg(
        F.count(F.lit(1)).alias("_n"), F.min(value).alias("_low"), F.max(value).alias("_high"))
    whole = Window.partitionBy(group)
    parts = parts.select(group, "_salt", F.sum("_n").over(whole).alias("_n"), F.min("_low").over(whole).alias("_low"),
                         F.max("_high").over(whole).alias("_high"))
    return salted.join(parts, [group, "_salt"]).drop("_salt")
