"""The labelled table of the model queries: text measurements of the documents that have labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keyrhythm.catalog.registry import table

FEATURES = ["chars", "spaces", "lines", "digits", "word_length"]

DOCUMENTS_SQL = """
SELECT doc_id, quality AS label, CAST(n_chars AS DOUBLE) AS chars,
       CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS spaces,
       CAST(length(text) - length(replace(text, chr(10), '')) AS DOUBLE) AS lines,
       CAST(length(text) - length(translate(text, '0123456789', '')) AS DOUBLE) AS digits,
       n_chars / CAST(length(text) - length(replace(text, ' ', '')) + 1 AS DOUBLE) AS word_length, toxic
FROM documents JOIN labels USING (doc_id)
"""

# Predictions made by a rule, so that the metrics can be checked without a fitted model.
PREDICTIONS_SQL = f"""
SELECT doc_id, label, round(digits / (digits + 12), 3) AS score, CAST(digits > 12 AS INTEGER) AS prediction
FROM ({DOCUMENTS_SQL})
"""


def _removed(text: Column, without: Column) -> Column:
    return (F.length(text) - F.length(without)).cast("double")


def labelled_documents(spark, folder) -> DataFrame:
    text = F.col("text")
    spaces = _removed(text, F.replace(text, F.lit(" "), F.lit("")))
    joined = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    return joined.select(
        "doc_id", F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("chars"),
        spaces.alias("spaces"), _removed(text, F.replace(text, F.lit("\n"), F.lit(""))).alias("lines"),
        _removed(text, F.translate(text, "0123456789", "")).alias("digits"),
        (F.col("n_chars") / (spaces + 1)).alias("word_length"), "toxic",
    )


def rule_predictions(spark, folder) -> DataFrame:
    digits = F.col("digits")
    return labelled_documents(spark, folder).select(
        "doc_id", "label", F.round(digits / (digits + 12), 3).alias("score"),
        (digits > 12).cast("int").alias("prediction"),
    )
