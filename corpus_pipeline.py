"""From raw documents to a training mix: five stages, each on all that the one before it kept.

quality rules, line dedup, near-dedup, benchmark decontamination, mixing to target weights. Every
stage's result is written to the shared folder and read again, so a lost executor costs at most one
stage's tasks. NULLs, empty and repeated rows and empty tables are handled as each operator states;
rows keep their extra columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from keyrhythm.llm.common import n_words, written
from keyrhythm.llm.decontaminate import contamination
from keyrhythm.llm.line_dedup import drop_repeated_lines
from keyrhythm.llm.mixing import mix_sources
from keyrhythm.llm.near_dedup import near_duplicates, one_of_each
from keyrhythm.llm.outliers import mark_outliers
from keyrhythm.llm.registry import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return mark_outliers(docs).where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the long lines that five or more of them share; ``n_chars`` follows."""
    out = drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates."""
    return one_of_each(docs, near_duplicates(docs, percent=80))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    found = written(contamination(docs, table(spark, sf_dir, "benchmark")), "contamination")
    ids = found.select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_leak"]), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: documents with ``size``, ``source_size``, ``target``, ``epochs`` and ``taken``."""
    return mix_sources(docs.withColumn("size", n_words(F.col("text")))).where("taken > 0")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: The outlier estimates of the first stage have no SQL form; tests/llm holds each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
