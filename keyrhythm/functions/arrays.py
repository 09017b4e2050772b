"""Statistics of the values inside each record, for all records of an Arrow batch at once.

For records that carry their measurements with them, such as one posted typing session: no
explode, no shuffle, no state.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from keyrhythm.functions.numeric import NUMBER_PATTERN


def flat_strings(column: pa.Array) -> pa.Array:
    """The strings of all lists of a batch, one after the other."""
    return pc.list_flatten(column).cast(pa.string())


def flat_numbers(column: pa.Array) -> np.ndarray:
    """The same as doubles; what is no plain number becomes NaN. Every different text is read once."""
    texts = flat_strings(column).dictionary_encode()
    known = texts.dictionary
    plain = pc.if_else(pc.match_substring_regex(known, NUMBER_PATTERN), pc.utf8_trim_whitespace(known), None)
    values = plain.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)
    places = texts.indices.fill_null(len(values)).to_numpy(zero_copy_only=False)
    return np.append(values, np.nan)[places]


def grouped_statistics(group: np.ndarray, values: np.ndarray, groups: int, asked: Iterable[str] | None = None) -> dict[str, np.ndarray]:
    """mean, median, amax, amin, var, std, iqr, skew and kurtosis of each group's values, or at least those asked for.

    NaN stands for what is not defined: everything for an empty group, the variance of one value,
    skew and kurtosis of values that do not differ.
    """
    if asked is not None and set(asked) <= {"mean"}:
        with np.errstate(divide="ignore", invalid="ignore"):
            # Without the order of the values there is nothing to sort.
            return {"mean": np.bincount(group, values, groups) / np.bincount(group, minlength=groups)}
    order = np.lexsort((values, group))
    group, values = group[order], values[order]
    n = np.bincount(group, minlength=groups)
    first = np.cumsum(n) - n
    padded = np.append(values, np.nan)

    def at(place: np.ndarray) -> np.ndarray:
        return padded[np.where(n > 0, first + place, len(values))]

    def quantile(p: float) -> np.ndarray:
        place = np.maximum(n - 1, 0) * p
        below = np.floor(place).astype(int)
        low, high = at(below), at(np.ceil(place).astype(int))
        return low + (high - low) * (place - below)

    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.bincount(group, values, groups) / n
        away = values - mean[group]
        m2, m3, m4 = (np.bincount(group, away ** k, groups) for k in (2, 3, 4))
        low, high = at(np.zeros(groups, int)), at(np.maximum(n - 1, 0))
        same = low == high
        var = np.where(n > 1, np.where(same, 0.0, m2 / (n - 1)), np.nan)
        return {
            "mean": mean, "median": quantile(0.5), "amax": high, "amin": low, "var": var, "std": np.sqrt(var),
            "iqr": quantile(0.75) - quantile(0.25),
            "skew": np.where(same, np.nan, (m3 / n) / (m2 / n) ** 1.5),
            "kurtosis": np.where(same, np.nan, n * m4 / (m2 * m2) - 3.0),
        }
