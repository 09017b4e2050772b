"""Pieces of the SQL checks that several queries share."""

from __future__ import annotations

from collections.abc import Sequence

_SHAPE = "(avg(pow({x}, 3)){f} - 3 * avg({x}){f} * avg(pow({x}, 2)){f} + 2 * pow(avg({x}){f}, 3))"

FORMULAS = {
    "mean": "avg({x}){f}",
    "median": "quantile_cont({x}, 0.5){f}",
    "amax": "max({x}){f}",
    "amin": "min({x}){f}",
    "var": "var_samp({x}){f}",
    "std": "stddev_samp({x}){f}",
    "iqr": "(quantile_cont({x}, 0.75){f} - quantile_cont({x}, 0.25){f})",
    "skew": "CASE WHEN max({x}){f} > min({x}){f} THEN " + _SHAPE + " / pow(var_pop({x}){f}, 1.5) END",
    "kurtosis": "CASE WHEN max({x}){f} > min({x}){f} THEN kurtosis_pop({x}){f} END",
    "q1": "quantile_cont({x}, 0.25){f}",
    "q3": "quantile_cont({x}, 0.75){f}",
}


def stat(name: str, x: str, where: str | None = None) -> str:
    """An aggregate expression for one statistic, optionally filtered."""
    return FORMULAS[name].format(x=x, f=f" FILTER (WHERE {where})" if where else "")


def rounded(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression} + 1e-9, {digits}) + 0.0 AS {name}"


def scaled(name: str, expression: str) -> str:
    """Variances of prices are too large for six decimals to be comparable."""
    return f"({expression}) / 1e6" if name == "var" else expression


def wide(measures: Sequence[tuple[str, str, str, Sequence[str]]], stats: Sequence[str]) -> list[tuple[str, str]]:
    """(column name, expression) for measures given as (suffix, category, value, levels)."""
    return [
        (f"{s}_{level}_{suffix}", stat(s, value, f"{category} = '{level}'"))
        for suffix, category, value, levels in measures
        for s in stats
        for level in levels
    ]
