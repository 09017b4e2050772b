"""Keyboard side of a key code, and transitions between sides."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from keyrhythm.functions.numeric import _col

# Browser key codes typed by each hand, and the space bar.
LEFT_HAND_CODES = [49, 50, 51, 52, 53, 81, 87, 69, 82, 84, 65, 83, 68, 70, 71, 90, 88, 67, 86, 66, 18, 9, 16,
                   17, 20, 27]
RIGHT_HAND_CODES = [54, 55, 56, 57, 48, 89, 85, 72, 73, 74, 75, 76, 77, 78, 79, 80, 13, 8, 46, 40, 37, 38, 39,
                    107, 108, 109, 110, 111, 188, 186, 187, 189, 190, 191, 219, 220, 221, 222]
SPACE_CODES = [32]
# End of fixed values.


def hand_of(key_code: Column | str) -> Column:
    """L, R or S for a known key code, NULL for any other."""
    key_code = _col(key_code)
    return (
        F.when(key_code.isin(LEFT_HAND_CODES), "L")
        .when(key_code.isin(RIGHT_HAND_CODES), "R")
        .when(key_code.isin(SPACE_CODES), "S")
    )


def category_of(value: Column | str, groups: dict[str, list]) -> Column:
    """Name of the group whose list holds the value."""
    value = _col(value)
    out = None
    for name, members in groups.items():
        out = F.when(value.isin(members), name) if out is None else out.when(value.isin(members), name)
    return out
