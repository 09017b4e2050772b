"""Parsing of ``Key: value`` profile text and of identifiers in file names."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from keyrhythm.functions.numeric import _col


def profile_fields(text: Column | str, names: Sequence[str]) -> list[Column]:
    """One text column per ``Key: value`` line, found by its key: what follows the last ``': '``, trimmed.

    A key without a line gives NULL, one without a value an empty text.
    """
    lines = F.transform(F.split(_col(text), "\r?\n"), lambda line: F.trim(line))

    def value(name: str) -> Column:
        own = F.get(F.filter(lines, lambda line: line.startswith(f"{name}:")), F.lit(0))
        told = F.regexp_replace(own, rf"^{re.escape(name)}:\s*", "")
        return F.trim(F.element_at(F.split(told, ": "), -1))

    return [value(name).alias(name) for name in names]


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def id_from_profile_path(path: Column | str) -> Column:
    """``User_<10 characters>.txt`` -> the ten characters."""
    return F.substring(file_name(path), 6, 10)


def id_from_log_path(path: Column | str) -> Column:
    """``<10 characters>_<yymm>.txt`` -> the ten characters."""
    return F.substring(file_name(path), 1, 10)
