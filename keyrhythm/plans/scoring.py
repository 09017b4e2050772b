"""Features and predictions for typing sessions that arrive as one record each.

A session carries all of its keystrokes, so its features are computed inside its own row. The
same function serves a batch table and a stream, needs no shuffle, and keeps no state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from keyrhythm.config import CHOSEN_FEATURES, LEVELS, FeatureConfig
from keyrhythm.functions.arrays import flat_numbers, flat_strings, grouped_statistics
from keyrhythm.functions.encode import yes_no
from keyrhythm.operators.profile import Measure, feature_name


def explode_sessions(sessions: DataFrame) -> DataFrame:
    """One row per keystroke, numbered from 0 in session order."""
    # The plain generator would make Spark test beforehand that there are keys: with their whole expression, written out
    # again for each use of its parts, and before any repartitioning. A session without keys has one row without a position.
    rows = sessions.select("session_id", "profile", F.posexplode_outer("keys").alias("position", "key"))
    rows = rows.where(F.col("position").isNotNull())
    return rows.select("session_id", "profile.*", "position", "key.*")


DURATIONS = ("Hold time", "Latency time", "Flight time")
CATEGORIES = ("Hand", "Direction")
#: The durations that must lie in range for a key to count.
FILTERED = ("Hold time", "Latency time")


def session_statistics(sessions: DataFrame, measures: Sequence[Measure], stats: Sequence[str],
                       config: FeatureConfig, strict_categories: bool = False, fill: bool = True,
                       columns: Sequence[str] | None = None) -> DataFrame:
    """Sessions with one column per statistic, level and measure, or only the named ``columns``.

    ``fill`` replaces a statistic that a level lacks by the mean over the levels the session has.
    A level without any key stays NULL, as does everything of a session without keys.
    ``strict_categories`` also asks for a known hand and direction, without which a key is left out of
    *all* statistics. The keys of an Arrow batch of sessions are read and summarised together.
    """
    names = [
        (m, stat, i, feature_name(stat, level, m.suffix))
        for m in measures for stat in stats for i, level in enumerate(m.levels)
    ]
    names = [n for n in names if columns is None or n[3] in columns]
    measures = [m for m in measures if any(n[0] == m for n in names)]
    stats = [s for s in stats if any(n[1] == s for n in names)]
    # Only the columns of the keys that the statistics and their filters ask for leave the row.
    categories = [c for c in CATEGORIES if strict_categories or any(m.category == c for m in measures)]
    durations = [c for c in DURATIONS if c in FILTERED or any(m.value == c for m in measures)]
    hands, directions, upper = list(config.hands), list(config.directions), config.upper

    def place(texts: pa.Array, levels: Sequence[str]) -> np.ndarray:
        """The number of each text's level, -1 for any other."""
        return pc.index_in(texts, pa.array(list(levels), pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)

    def batch_columns(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = batch.num_rows
        owner = pc.list_parent_indices(batch.column(FILTERED[0])).to_numpy(zero_copy_only=False)
        texts = {c: flat_strings(batch.column(c)) for c in categories}
        numbers = {c: flat_numbers(batch.column(c)) for c in durations}
        kept = np.ones(len(owner), bool)
        for c in FILTERED:
            kept &= (numbers[c] > 0) & (numbers[c] < upper)
        if strict_categories:
            kept &= (place(texts["Hand"], hands) >= 0) & (place(texts["Direction"], directions) >= 0)
        told = {}
        for m in measures:
            level = place(texts[m.category], m.levels)
            own = kept & (level >= 0) & ~np.isnan(numbers[m.value])
            found = grouped_statistics(owner[own] * len(m.levels) + level[own], numbers[m.value][own], rows * len(m.levels), {"mean", *stats})
            cells = {stat: v.reshape(rows, len(m.levels)) for stat, v in found.items()}
            if fill:
                for stat in stats:
                    here = ~np.isnan(cells[stat])
                    typical = np.where(here, cells[stat], 0.0).sum(1) / np.maximum(here.sum(1), 1)
                    typical[~here.any(1)] = np.nan
                    gap = ~here & ~np.isnan(cells["mean"])
                    cells[stat] = np.where(gap, typical[:, None], cells[stat])
            told[m.suffix] = cells
        out = [told[m.suffix][stat][:, i] for m, stat, i, _ in names]
        return [pa.array(v, pa.float64(), mask=np.isnan(v)) for v in out]

    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column("session_id"), batch.column("profile"), *batch_columns(batch)]
            yield pa.RecordBatch.from_arrays(values, names=["session_id", "profile", *[n[3] for n in names]])

    keys = [F.col("keys")[c].cast("array<string>").alias(c) for c in (*categories, *durations)]
    rows = sessions.select("session_id", "profile", *keys)
    schema = T.StructType([rows.schema["session_id"], rows.schema["profile"],
                           *[T.StructField(n[3], T.DoubleType()) for n in names]])
    return rows.mapInArrow(summarised, schema)


def session_features(sessions: DataFrame, config: FeatureConfig | None = None,
                     columns: Sequence[str] = tuple(CHOSEN_FEATURES), strict_categories: bool = False,
                     levels: Sequence[str] = tuple(LEVELS["Sided"])) -> DataFrame:
    """The model's input row of every session: (session_id, chosen columns), without NULLs.

    The side is encoded against the training levels, Yes/No become 1/0, and what is still missing
    becomes 0.
    """
    config = config or FeatureConfig()
    wide = session_statistics(sessions, config.measures, config.stats, config, strict_categories, columns=columns)
    known = {"Tremors": yes_no("profile.Tremors")}
    for level in levels:
        known[f"Sided_{level}"] = F.when(F.col("profile.Sided") == level, 1).otherwise(0)
    picked = [
        F.coalesce((known[c] if c in known else F.col(c)).cast("double"), F.lit(0.0)).alias(c) for c in columns
    ]
    return wide.select("session_id", *picked)


def score_sessions(sessions: DataFrame, model, config: FeatureConfig | None = None, **options) -> DataFrame:
    """Sessions with the prediction of a fitted pipeline over the chosen columns."""
    told = model.transform(session_features(sessions, config, **options))
    return told.select("session_id", F.col("prediction").cast("int").alias("prediction"))
