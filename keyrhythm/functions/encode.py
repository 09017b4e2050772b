"""Recoding of flags and categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from keyrhythm.functions.numeric import _col


def recode(column: Column | str, codes: Mapping[str, int], others: str = "null") -> Column:
    """Replace the listed texts by integers. Other values have no code and become NULL.

    ``others="keep"`` leaves them unchanged; the column is then text, codes included.
    """
    column = _col(column)
    out = None
    for text, code in codes.items():
        out = F.when(column == text, code) if out is None else out.when(column == text, code)
    return F.coalesce(out.cast("string"), column) if others == "keep" else out.cast("int")


def true_false(column: Column | str, others: str = "null") -> Column:
    return recode(column, {"True": 1, "False": 0}, others)


def yes_no(column: Column | str, others: str = "null") -> Column:
    return recode(column, {"Yes": 1, "No": 0}, others)


def null_unless_in(column: Column | str, allowed: Sequence) -> Column:
    column = _col(column)
    return F.when(column.isin(list(allowed)), column)


def indicators(column: str, levels: Sequence[str], prefix: str | None = None) -> list[Column]:
    """One 0/1 column per level, named ``<prefix>_<level>``; all levels are kept."""
    prefix = prefix or column
    return [
        F.when(F.col(column) == level, 1).otherwise(0).cast("int").alias(f"{prefix}_{level}")
        for level in levels
    ]


def observed_levels(df: DataFrame, column: str) -> list[str]:
    """The sorted levels of a categorical column; each becomes a column of the encoded table."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().collect()
    return sorted(row[0] for row in rows)


def one_hot(df: DataFrame, column: str, levels: Sequence[str] | None = None) -> DataFrame:
    """Replace a categorical column by its indicators.

    Give ``levels`` to encode against a fixed (training) domain; without it they are read from
    the data once.
    """
    levels = observed_levels(df, column) if levels is None else levels
    kept = [F.col(c) for c in df.columns if c != column]
    return df.select(*kept, *indicators(column, levels))
