"""Filling of missing and negative values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def fill_with_group_mean(stats_rows: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """NULL statistics become the mean of the same statistic over the entity's other levels.

    For statistics rows, of which an entity has one per level, so the window stays small.
    """
    same = Window.partitionBy(*group)
    filled = {c: F.coalesce(F.col(c), F.avg(c).over(same)) for c in columns}
    return stats_rows.withColumns(filled)


def negatives_to_mean(rows: DataFrame, column: str) -> DataFrame:
    """Values below zero become the column's overall mean."""
    mean = rows.agg(F.avg(column)).scalar()
    return rows.withColumn(column, F.when(F.col(column) < 0, mean).otherwise(F.col(column)))


def handle_missing(wide: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """What to do with NULL features: ``keep``, ``drop``, ``zero``, ``mean`` or ``error``.

    ``mean`` uses the column mean over the table, ``error`` stops the job at the first NULL.
    """
    columns = list(columns)
    if how == "keep":
        return wide
    if how == "drop":
        return wide.dropna(subset=columns)
    if how == "zero":
        return wide.fillna(0, subset=columns)
    if how == "mean":
        means = wide.agg(F.struct(*[F.avg(c).alias(c) for c in columns])).scalar()
        filled = {c: F.coalesce(F.col(c), F.col("_means")[c]) for c in columns}
        return wide.withColumn("_means", means).withColumns(filled).drop("_means")
    if how == "error":
        checks = {
            c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"missing value in {c}")).cast("double"))
            .otherwise(F.col(c).cast("double"))
            for c in columns
        }
        return wide.withColumns(checks)
    raise ValueError(f"unknown rule for missing values: {how}")
