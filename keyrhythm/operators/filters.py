"""Cohort, range and group-size filters, and semi joins that keep a heavy key spread out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def mild_or_untreated(label: str = "Parkinsons", severity: str = "Impact",
                      treated: str = "Levadopa", mild: str = "Mild") -> Column:
    """Cohort rule: diagnosed and mild, or neither diagnosed nor treated."""
    return ((F.col(label) == 1) & (F.col(severity) == mild)) | (
        (F.col(label) == 0) & (F.col(treated) == 0)
    )


def inside(columns: Sequence[str], upper: float, lower: float = 0.0) -> Column:
    """All columns strictly between the bounds; a NULL fails."""
    tests = [(F.col(c) > lower) & (F.col(c) < upper) for c in columns]
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def keys_of(df: DataFrame, key: str, alias: str | None = None) -> DataFrame:
    """The distinct keys. Partial aggregation removes copies before the shuffle."""
    return df.select(F.col(key).alias(alias or key)).where(F.col(key).isNotNull()).distinct()


def semi_join_spread(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``keys`` (one row per key), with a heavy key split over several tasks.

    Spark measures the key list before it joins: a short one is broadcast, once per key, so that no row
    moves. A longer one is joined by a shuffle, in which adaptive execution cuts a heavy key's rows
    into parts and gives each the few keys that it needs. No key is ever repeated by this function.
    """
    return rows.join(keys.select(key), key, "left_semi").select(*rows.columns)


def large_groups(rows: DataFrame, key: str, more_than: int) -> DataFrame:
    """Keys with strictly more rows than asked for."""
    return rows.groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > more_than).select(key)


def keep_large_groups(rows: DataFrame, key: str, more_than: int) -> DataFrame:
    return semi_join_spread(rows, large_groups(rows, key, more_than), key)
