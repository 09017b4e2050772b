"""Scaling of feature columns. Fitting reads a few numbers per column; applying is a projection."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F


class Scaling(NamedTuple):
    """Per column: subtract ``centre``, divide by ``spread``."""

    centre: dict[str, float]
    spread: dict[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (F.col(c) - F.lit(self.centre[c])) / F.lit(self.spread[c]) for c in self.spread
        })


def fit_scaling(df: DataFrame, columns: Sequence[str], centred: bool = True) -> Scaling:
    """Mean and population standard deviation of each column in one aggregation.

    A column without spread is only centred. ``centred=False`` scales to unit variance and leaves
    the mean alone.
    """
    aggs = [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]
    aggs += [F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]
    row = df.agg(*aggs).first()
    centre = {c: (row[f"m{i}"] or 0.0) if centred else 0.0 for i, c in enumerate(columns)}
    spread = {c: row[f"s{i}"] or 1.0 for i, c in enumerate(columns)}
    return Scaling(centre, spread)


def unit_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Divide the columns of each row by the row's Euclidean length; a zero row stays zero."""
    squares = [F.col(c) * F.col(c) for c in columns]
    total = squares[0]
    for s in squares[1:]:
        total = total + s
    length = F.sqrt(total)
    return df.withColumns({c: F.when(length == 0, F.col(c)).otherwise(F.col(c) / length) for c in columns})


def unit_array(vector: str):
    """The same for an array column."""
    values = F.transform(F.col(vector), lambda v: v.cast("double"))
    length = F.sqrt(F.aggregate(values, F.lit(0.0), lambda total, v: total + v * v))
    return F.transform(values, lambda v: F.when(length == 0, v).otherwise(v / length))


def assemble(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The kept columns and one ``features`` vector."""
    out = VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)
    return out.select(*keep, "features")
