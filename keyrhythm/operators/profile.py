"""Exact statistics per group, and the wide row per entity made from them.

All statistics of a group, quantiles included, come from one pass over the rows:

1. equal values of a group are counted, with partial aggregation before the shuffle, so a group
   with billions of rows shrinks to its distinct values in every map task;
2. the counts are summed per range of values, cut at sampled borders; a window over this small table
   gives each range its starting rank and each group its mean;
3. the counted values take these up (joined on group *and* range, so a heavy group stays spread
   over its ranges), and central moments and order statistics are summed up with partial
   aggregation.

No step needs the values of one group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from keyrhythm.functions.numeric import all_known
from keyrhythm.operators.ranges import with_range

# Names of the statistics as they appear in feature names.
ALL_STATS = ["mean", "median", "amax", "amin", "var", "std", "iqr", "skew", "kurtosis"]
# End of fixed values.

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


class Measure(NamedTuple):
    """A value summarised per level of a category; ``suffix`` ends the feature names."""

    suffix: str
    category: str
    value: str
    levels: tuple[str, ...]


class Difference(NamedTuple):
    """Absolute difference of the means of two levels of one measure."""

    name: str
    suffix: str
    first: str
    second: str


def _number(value: Column) -> Column:
    """As a double; NaN is a missing value like NULL."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def observations(rows: DataFrame, key: str, measures: Sequence[Measure], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (key, measure, category, value); levels that are not asked for are left out.

    The measures are unfolded from the same scan. ``keep`` are further columns, such as the time.
    """
    def unfolded(m: Measure) -> Column:
        return F.struct(
            F.lit(m.suffix).alias("measure"),
            F.when(F.col(m.category).isin(list(m.levels)), F.col(m.category)).alias("category"),
            _number(F.col(m.value)).alias("value"),
        )

    unfolded_rows = rows.select(key, *keep, F.explode(F.array(*[unfolded(m) for m in measures])).alias("_o"))
    return unfolded_rows.select(key, *keep, "_o.measure", "_o.category", "_o.value").where(
        F.col(key).isNotNull() & F.col("category").isNotNull() & F.col("value").isNotNull()
    )


def value_counts(obs: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """How often each value occurs in each group: the exact, mergeable form of the observations."""
    return obs.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, value).agg(F.count("*").alias("n"))


def profile_counts(
    counts: DataFrame, keys: Sequence[str], value: str = "value", degenerate: str = "null"
) -> DataFrame:
    """All statistics of counted values: ``keys, count, q1, q3`` and every name in ALL_STATS.

    ``degenerate`` says what skew and kurtosis are when a group has no spread: ``"null"``, or
    ``"zero"`` for 0 and -3.
    """
    keys = list(keys)
    known = counts.where(all_known(keys))
    # Counted values are never NULL. Saying so of the edge keeps a join from testing it on raw rows.
    placed = with_range(known, "_edge", [value], [*keys, value]).withColumn("_edge", F.coalesce("_edge", F.lit(0)))
    n, x = F.col("n"), F.col(value)
    buckets = placed.groupBy(*keys, "_edge").agg(F.sum(n).alias("_n"), F.sum(n * x).alias("_s"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_edge").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(
        *keys,
        "_edge",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(group).alias("_total"),
        (F.sum("_s").over(group) / F.sum("_n").over(group)).alias("_mean"),
    )
    in_bucket = (
        Window.partitionBy(*keys, "_edge")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = placed.join(starts, [*keys, "_edge"]).withColumn(
        "_upto", F.col("_start") + F.sum("n").over(in_bucket)
    )

    def order_statistic(rank: Column, name: str) -> Column:
        covered = (F.col("_upto") - n <= rank) & (rank < F.col("_upto"))
        return F.max(F.when(covered, x)).alias(name)

    last = F.col("_total") - 1
    picks = []
    for name, p in QUARTILES.items():
        picks.append(order_statistic(F.floor(last * p), f"_{name}_lo"))
        picks.append(order_statistic(F.ceil(last * p), f"_{name}_hi"))
    away = x - F.col("_mean")
    summed = ranked.groupBy(*keys).agg(
        F.max("_total").alias("count"),
        F.max("_mean").alias("mean"),
        F.max(x).alias("amax"),
        F.min(x).alias("amin"),
        F.sum(n * away * away).alias("_m2"),
        F.sum(n * away * away * away).alias("_m3"),
        F.sum(n * away * away * away * away).alias("_m4"),
        *picks,
    )

    def quantile(name: str, p: float) -> Column:
        at = (F.col("count") - 1) * p
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        return low + (high - low) * (at - F.floor(at))

    flat = F.col("amin") == F.col("amax")
    size = F.col("count")
    spread = F.when(flat, F.lit(0.0)).otherwise(F.col("_m2"))
    variance = F.when(size > 1, spread / F.greatest(size - 1, F.lit(1)))
    none = F.lit(None).cast("double")
    skew_flat, kurtosis_flat = (F.lit(0.0), F.lit(-3.0)) if degenerate == "zero" else (none, none)
    q1, q3 = quantile("q1", 0.25), quantile("q3", 0.75)
    return summed.select(
        *keys,
        "count",
        F.when(flat, F.col("amin")).otherwise(F.col("mean")).alias("mean"),
        quantile("median", 0.5).alias("median"),
        "amax",
        "amin",
        variance.alias("var"),
        F.sqrt(variance).alias("std"),
        (q3 - q1).alias("iqr"),
        F.when(flat, skew_flat)
        .otherwise((F.col("_m3") / size) / F.pow(F.col("_m2") / size, 1.5))
        .alias("skew"),
        F.when(flat, kurtosis_flat)
        .otherwise(size * F.col("_m4") / (F.col("_m2") * F.col("_m2")) - 3.0)
        .alias("kurtosis"),
        q1.alias("q1"),
        q3.alias("q3"),
    )


def profile(obs: DataFrame, keys: Sequence[str], value: str = "value", degenerate: str = "null") -> DataFrame:
    """Exact statistics of every group; see the module text for how a heavy group is spread."""
    return profile_counts(value_counts(obs, keys, value), keys, value, degenerate)


def profile_small_groups(obs: DataFrame, keys: Sequence[str], value: str = "value",
                         degenerate: str = "null", approximate: bool = False) -> DataFrame:
    """The same columns by Spark's own aggregates: a single shuffle.

    Exact percentiles hold the distinct values of a group in one buffer, so this is for groups
    that are known to be small, such as one typing session. ``approximate=True`` bounds that
    buffer by a sketch and makes the form fit for any size, at the price of inexact quartiles.
    """
    x = F.col(value)
    pick = F.percentile_approx if approximate else F.percentile
    agg = obs.groupBy(*keys).agg(
        F.count(x).alias("count"),
        F.avg(x).alias("mean"),
        F.max(x).alias("amax"),
        F.min(x).alias("amin"),
        F.var_samp(x).alias("var"),
        F.stddev_samp(x).alias("std"),
        F.skewness(x).alias("skew"),
        F.kurtosis(x).alias("kurtosis"),
        pick(x, F.array(*[F.lit(p) for p in QUARTILES.values()])).alias("_q"),
    )
    flat = F.col("amin") == F.col("amax")
    skew, kurtosis = F.col("skew"), F.col("kurtosis")
    if degenerate == "zero":
        skew, kurtosis = F.when(flat, 0.0).otherwise(skew), F.when(flat, -3.0).otherwise(kurtosis)
    q = [F.get("_q", F.lit(i)) for i in range(3)]
    return agg.select(
        *keys, "count", "mean", q[1].alias("median"), "amax", "amin", "var", "std",
        (q[2] - q[0]).alias("iqr"), skew.alias("skew"), kurtosis.alias("kurtosis"),
        q[0].alias("q1"), q[2].alias("q3"),
    )


def feature_name(stat: str, level: str, suffix: str) -> str:
    return f"{stat}_{level}_{suffix}"


def feature_names(measure: Measure, stats: Sequence[str]) -> list[str]:
    return [feature_name(s, level, measure.suffix) for s in stats for level in measure.levels]


def widen(stats_rows: DataFrame, key: str, measures: Sequence[Measure], stats: Sequence[str],
          differences: Sequence[Difference] = (), required: str | None = None) -> DataFrame:
    """One row per key with a fixed set of columns; a missing (key, level) stays NULL.

    ``required`` names the measure a key must have to appear at all. The input has at most one
    row per (key, measure, level), so no group here is large.
    """
    def cell(stat: str, m: Measure, level: str) -> Column:
        hit = (F.col("measure") == m.suffix) & (F.col("category") == level)
        return F.max(F.when(hit, F.col(stat))).alias(feature_name(stat, level, m.suffix))

    cells = [cell(s, m, level) for m in measures for s in stats for level in m.levels]
    extra = {
        m.suffix: [
            F.abs(F.col(feature_name("mean", d.first, m.suffix)) - F.col(feature_name("mean", d.second, m.suffix)))
            .alias(d.name)
            for d in differences
            if d.suffix == m.suffix
        ]
        for m in measures
    }
    present = F.max(F.when(F.col("measure") == required, 1)) if required else F.lit(1)
    wide = stats_rows.groupBy(key).agg(*cells, present.alias("_present"))
    ordered = []
    for m in measures:
        ordered += [F.col(c) for c in feature_names(m, stats)] + extra[m.suffix]
    return wide.where(F.col("_present") == 1).select(key, *ordered)


def wide_profile(rows: DataFrame, key: str, measures: Sequence[Measure], stats: Sequence[str],
                 differences: Sequence[Difference] = (), required: str | None = None,
                 degenerate: str = "null") -> DataFrame:
    """Observations -> exact statistics -> one wide row per key."""
    needed = list(dict.fromkeys([*stats, "mean"])) if differences else list(stats)
    long = profile(observations(rows, key, measures), [key, "measure", "category"], degenerate=degenerate)
    wide = widen(long, key, measures, needed, differences, required)
    if needed == list(stats):
        return wide
    dropped = [c for m in measures for c in feature_names(m, ["mean"])]
    return wide.drop(*dropped)


def last_per_group(rows: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """The value of the last row of each group under an explicit order (partially aggregated)."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(f"last_{value}"))
