"""Cutting ordered rows into about even ranges, whatever their values are.

Work that goes along an order inside one large group (ranks, running totals, previous rows) is spread
by cutting the order into ranges. The borders are quantiles of a sample of the rows themselves, so
values that all lie close together, or a group that holds a third of the rows, get as many ranges as
they have rows. A value that many rows share is cut by the further columns of the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def with_range(df: DataFrame, name: str, order: Sequence[str], identity: Sequence[str] = (), parts: int = 128,
               per_part: int = 64) -> DataFrame:
    """Add the number of the row's range, 0 .. ``parts`` - 1; it never decreases along ``order``.

    ``identity`` tells rows apart, by default ``order`` does. The sample is the ``parts * per_part``
    rows whose identity has the smallest hash: chosen in the same job that uses it, and the same in
    every run. A row whose first ``order`` column is NULL has no place: its range is NULL.
    """
    place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    named = [*(identity or order)]
    chosen = (
        df.where(F.col(order[0]).isNotNull()).select(place.alias("_o"), F.xxhash64(*named).alias("_h"))
        .orderBy("_h", "_o").limit(parts * per_part)
    )
    sample = chosen.agg(F.array_sort(F.collect_list("_o")).alias("_s"))
    at = F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: F.get("_s", F.floor(F.size("_s") * i / parts).cast("int")))
    borders = sample.select(F.array_distinct(F.filter(at, lambda b: b.isNotNull())).alias("_b")).scalar()
    # Halving steps through the borders that are not above the row. One column a step is compiled, a fold over the steps is not.
    marked = df.withColumn("_borders", borders).withColumn("_place", place).withColumn("_low", F.lit(0))
    low = F.col("_low")
    for step in (1 << i for i in reversed(range(max(1, (parts - 1).bit_length())))):
        marked = marked.withColumn("_low", F.when(F.get("_borders", low + (step - 1)) <= F.col("_place"), low + step).otherwise(low))
    return marked.withColumn(name, F.when(F.col(order[0]).isNotNull(), low)).drop("_borders", "_place", "_low")
