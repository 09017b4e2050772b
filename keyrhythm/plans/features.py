"""From raw profiles and keystrokes to labelled feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from keyrhythm.config import SEVERITIES, FeatureConfig
from keyrhythm.functions.encode import null_unless_in, one_hot, true_false
from keyrhythm.operators.filters import inside, keys_of, large_groups, mild_or_untreated, semi_join_spread
from keyrhythm.operators.impute import handle_missing, negatives_to_mean
from keyrhythm.operators.profile import observations, profile, widen
from keyrhythm.operators.sketch import profile_sketched
from keyrhythm.session import cut_lineage, stored
from keyrhythm.sources.files import DURATIONS, typed_keystrokes


def clean_profiles(profiles: DataFrame, config: FeatureConfig) -> DataFrame:
    """Encoded profiles of the cohort, one row per user."""
    coded = profiles.withColumns({c: true_false(c) for c in ("Parkinsons", "Tremors", "Levadopa")})
    for column in config.one_hot:
        # The levels are those of all users, whoever the cohort keeps.
        coded = one_hot(coded, column, config.levels.get(column))
    coded = coded.withColumn("Impact", null_unless_in("Impact", SEVERITIES))
    return coded.where(mild_or_untreated()).drop(*[c for c in config.dropped if c != "Levadopa"])


def users_with_logs(profiles: DataFrame, keystrokes: DataFrame) -> DataFrame:
    """Profiles of users who have at least one log file."""
    return profiles.join(keys_of(keystrokes, "file_id", "user_id"), "user_id", "left_semi")


def valid_keystrokes(keystrokes: DataFrame, cohort: DataFrame, config: FeatureConfig) -> DataFrame:
    """Keystrokes of cohort users with enough rows, in range on both durations.

    Rows are counted before they are cleaned. Both user rules meet in one short key list, so the
    log is filtered by a single semi join.
    """
    own = semi_join_spread(keystrokes, keys_of(cohort, "user_id", "file_id"), "file_id")
    enough = large_groups(own, "user_id", config.more_than).join(cohort.select("user_id"), "user_id", "left_semi")
    kept = typed_keystrokes(semi_join_spread(own, enough, "user_id"))
    if config.negatives == "mean":
        kept = negatives_to_mean(kept, "Hold time")
    return kept.where(inside(["Hold time", "Latency time"], config.upper))


def statistics(valid: DataFrame, config: FeatureConfig) -> DataFrame:
    """Rows (user, measure, level, statistics), exact or with sketched quartiles as the settings say."""
    obs, keys = observations(valid, "user_id", config.measures), ["user_id", "measure", "category"]
    if config.exact:
        return profile(obs, keys, degenerate=config.degenerate)
    return profile_sketched(obs, keys, degenerate=config.degenerate, size=config.sketch_size)


def feature_tables(profiles: DataFrame, keystrokes: DataFrame, config: FeatureConfig) -> dict[str, DataFrame]:
    """The tables ``both``, ``hold`` and ``latency``; each starts with the label.

    In ``both`` a user needs a valid hold row; latency columns may be missing.
    """
    # Raw files are opened once: the rows are asked for several times, by few columns each.
    used = dict.fromkeys(["user_id", "file_id", *DURATIONS, *[m.category for m in config.measures]])
    keystrokes = stored(keystrokes.select(*used), "keystrokes")
    cohort = cut_lineage(clean_profiles(users_with_logs(profiles, keystrokes), config))
    # Settled once, so that the log is read for one set of statistics and not for each of the tables.
    stats = cut_lineage(statistics(valid_keystrokes(keystrokes, cohort, config), config))
    needed = list(dict.fromkeys([*config.stats, *(["mean"] if config.differences else [])]))
    parts = {
        "both": (config.measures, "hold_time", None),
        "hold": ([config.hold], "hold_time", "hold_time"),
        "latency": ([config.latency], "latency_time", "latency_time"),
    }
    out = {}
    for name, (measures, required, suffix) in parts.items():
        wide = widen(stats, "user_id", measures, needed, config.differences, required)
        names = config.statistic_names(suffix)
        wide = handle_missing(wide.select("user_id", *names), names, config.missing)
        joined = cohort.join(wide, "user_id").drop(*config.dropped_at_end)
        if "Levadopa" in config.dropped:
            joined = joined.drop("Levadopa")
        first = ["Parkinsons", *[c for c in joined.columns if c != "Parkinsons"]]
        out[name] = joined.select(*first)
    return out


def class_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("Parkinsons").agg(F.count("*").alias("n"))
