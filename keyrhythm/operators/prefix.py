"""Running totals and exact positions inside groups of any size.

A window over a whole group runs in one task, so a group that holds a third of the table would
bring the job to a halt. Here the group is cut into buckets that follow its order. Each bucket is
summed in its own task, a small table of bucket totals is accumulated, and every row adds the
total of the buckets before its own. The answer is the exact running total.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from keyrhythm.functions.numeric import all_known

BUCKET = "_bucket"


def running_totals(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    sums: Mapping[str, Column],
    descending: bool = False,
) -> DataFrame:
    """Add ``<name>`` (running total, own row included) and ``<name>_total`` for each sum.

    ``bucket`` must never decrease along ``order`` (never increase when ``descending``), and
    ``order`` must be unique in a group. Rows with a NULL group or bucket have no place and are left
    out. The input is read twice, the second time only for a small partial aggregation of the group,
    bucket and summed columns.
    """
    keys = [*groups, BUCKET]
    marked = df.withColumn(BUCKET, bucket)
    for name, value in sums.items():
        marked = marked.withColumn(f"_x_{name}", value)
    marked = marked.where(all_known(keys))
    direction = F.desc if descending else F.asc

    per_bucket = marked.groupBy(*keys).agg(*[F.sum(f"_x_{n}").alias(f"_b_{n}") for n in sums])
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = whole.orderBy(direction(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys,
        *[F.sum(f"_b_{n}").over(before).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_b_{n}").over(whole).alias(f"{n}_total") for n in sums],
    )

    inside = (
        Window.partitionBy(*keys)
        .orderBy(*[direction(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = marked.join(offsets, keys)
    for name in sums:
        total = F.sum(f"_x_{name}").over(inside) + F.coalesce(F.col(f"_o_{name}"), F.lit(0))
        joined = joined.withColumn(name, total)
    return joined.drop(BUCKET, *[f"_x_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def positions(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], bucket: Column,
    position: str = "position", size: str = "size",
) -> DataFrame:
    """Add the 1-based position of each row in its group and the group's size."""
    out = running_totals(df, groups, order, bucket, {"_at": F.lit(1).cast("bigint")})
    return out.withColumnRenamed("_at", position).withColumnRenamed("_at_total", size)
