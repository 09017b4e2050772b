"""Train/test split and folds, exact and repeatable, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keyrhythm.operators.prefix import positions
from keyrhythm.operators.ranges import with_range


def shuffled_order(key: str, seed: int) -> Column:
    """A fixed pseudo-random order of the keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def stratified_split(df: DataFrame, key: str, label: str, test_share: float = 0.4, seed: int = 0) -> DataFrame:
    """Add ``is_test`` (0/1): per label exactly round(share * n) rows, chosen by a seeded order.

    The hash is uniform, so its first three digits cut every label into 4096 even buckets.
    """
    # Inside a struct a missing label is a group like any other.
    marked = df.withColumn("_order", shuffled_order(key, seed)).withColumn("_label", F.struct(label))
    placed = positions(marked, ["_label"], ["_order", key], F.substring("_order", 1, 3), "_at", "_of")
    wanted = F.floor(F.col("_of") * F.lit(test_share) + 0.5)
    return placed.withColumn("is_test", (F.col("_at") <= wanted).cast("int")).drop("_label", "_order", "_at", "_of")


def _in_key_order(df: DataFrame, groups: list[str], key: str) -> DataFrame:
    """Add the place in the key's order and the size of the group. Rows with a NULL key come first."""
    ranged = with_range(df, "_range", [key])
    return positions(ranged, groups, [key], F.coalesce("_range", F.lit(-1)), "_at", "_of").drop("_range")


def contiguous_folds(df: DataFrame, key: str, folds: int = 10) -> DataFrame:
    """Add ``fold``: blocks in key order; the first ``n mod folds`` blocks have one row more."""
    placed = _in_key_order(df, [], key)
    at = F.col("_at") - 1
    size = F.floor(F.col("_of") / folds)
    longer = F.col("_of") % folds
    border = longer * (size + 1)
    fold = F.when(at < border, F.floor(at / (size + 1))).otherwise(
        longer + F.floor((at - border) / F.greatest(size, F.lit(1)))
    )
    return placed.withColumn("fold", fold.cast("int")).drop("_at", "_of")


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 5) -> DataFrame:
    """Add ``fold``: every label is dealt over the folds in key order."""
    placed = _in_key_order(df.withColumn("_label", F.struct(label)), ["_label"], key)
    return placed.withColumn("fold", ((F.col("_at") - 1) % folds).cast("int")).drop("_label", "_at", "_of")
