"""Statistics of groups from a state of bounded size that can be merged.

A state holds the count, mean and central moments, the extremes, and a KLL quantile sketch. It is made
in one shuffle with partial aggregation, however large a group is, and states of parts of a group
(time windows, days, streams) merge into the state of the whole. Moments and extremes are exact;
quartiles are values whose rank is off by at most ``rank_error`` of the group's rows (with 99 %
confidence each), and exact in groups of no more than about ``size`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Numbers that the sketch keeps of the largest groups, times about three.
SIZE = 400
MOMENTS = ("m2", "m3", "m4")


def rank_error(size: int = SIZE) -> float:
    """How far a quantile's rank may be off, as a share of the rows."""
    return 2.296 / size**0.9021


def states(obs: DataFrame, keys: Sequence[str | Column], value: str = "value", size: int = SIZE) -> DataFrame:
    """One state per group: keys, count, mean, m2, m3, m4, amin, amax, sketch. Missing values (NULL, NaN) are left out."""
    x, n = F.col(value), F.col("count")
    summed = obs.where(x.isNotNull() & ~F.isnan(x)).groupBy(*keys).agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.var_pop(x).alias("_v"), F.skewness(x).alias("_s"),
        F.kurtosis(x).alias("_k"), F.min(x).alias("amin"), F.max(x).alias("amax"),
        F.kll_sketch_agg_double(x, F.lit(size)).alias("sketch"),
    )
    names = [c for c in summed.columns if c not in ("count", "mean", "_v", "_s", "_k", "amin", "amax", "sketch")]
    flat = F.col("amin") == F.col("amax")
    return summed.select(
        *names, "count", "mean",
        F.when(flat, 0.0).otherwise(n * F.col("_v")).alias("m2"),
        F.when(flat, 0.0).otherwise(n * F.col("_s") * F.pow("_v", F.lit(1.5))).alias("m3"),
        F.when(flat, 0.0).otherwise(n * (F.col("_k") + 3.0) * F.col("_v") * F.col("_v")).alias("m4"),
        "amin", "amax", "sketch",
    )


def merged_states(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The states of whole groups from states of their parts."""
    n, group = F.col("count"), Window.partitionBy(*keys)
    whole = F.sum(n * F.col("mean")).over(group) / F.sum(n).over(group)
    d = F.col("mean") - F.col("_whole")
    moved = parts.withColumn("_whole", whole).select(
        *keys, n, "_whole", "amin", "amax", "sketch",
        (F.col("m2") + n * d * d).alias("m2"),
        (F.col("m3") + 3.0 * d * F.col("m2") + n * d * d * d).alias("m3"),
        (F.col("m4") + 4.0 * d * F.col("m3") + 6.0 * d * d * F.col("m2") + n * d * d * d * d).alias("m4"),
    )
    return moved.groupBy(*keys).agg(
        F.sum("count").alias("count"), F.max("_whole").alias("mean"), *[F.sum(m).alias(m) for m in MOMENTS],
        F.min("amin").alias("amin"), F.max("amax").alias("amax"), F.kll_merge_agg_double("sketch").alias("sketch"),
    )


def statistics(of: DataFrame, keys: Sequence[str], degenerate: str = "null") -> DataFrame:
    """The columns of the exact statistics from states."""
    size, m2 = F.col("count"), F.col("m2")
    flat = F.col("amin") == F.col("amax")
    none = F.lit(None).cast("double")
    skew_flat, kurtosis_flat = (F.lit(0.0), F.lit(-3.0)) if degenerate == "zero" else (none, none)
    variance = F.when(size > 1, m2 / F.greatest(size - 1, F.lit(1)))
    quartiles = F.kll_sketch_get_quantile_double("sketch", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    q1, median, q3 = (F.get("_q", F.lit(i)) for i in range(3))
    return of.withColumn("_q", quartiles).select(
        *keys, "count", F.when(flat, F.col("amin")).otherwise(F.col("mean")).alias("mean"), median.alias("median"), "amax", "amin",
        variance.alias("var"), F.sqrt(variance).alias("std"), (q3 - q1).alias("iqr"),
        F.when(flat, skew_flat).otherwise((F.col("m3") / size) / F.pow(m2 / size, F.lit(1.5))).alias("skew"),
        F.when(flat, kurtosis_flat).otherwise(size * F.col("m4") / (m2 * m2) - 3.0).alias("kurtosis"),
        q1.alias("q1"), q3.alias("q3"),
    )


def profile_sketched(obs: DataFrame, keys: Sequence[str], value: str = "value", degenerate: str = "null",
                     size: int = SIZE) -> DataFrame:
    """The columns of ``profile`` in a single shuffle of bounded states, with inexact quartiles."""
    return statistics(states(obs, keys, value, size), keys, degenerate)
