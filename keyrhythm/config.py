"""Settings of the feature pipeline, and the named variants of it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from keyrhythm.operators.profile import Difference, Measure, feature_names

# Field names of the raw files, category levels and the chosen feature list.
PROFILE_FIELDS = ["BirthYear", "Gender", "Parkinsons", "Tremors", "DiagnosisYear", "Sided", "UPDRS", "Impact",
                  "Levadopa", "DA", "MAOB", "Other"]
KEYSTROKE_FIELDS = ["user_id", "Date", "Timestamp", "Hand", "Hold time", "Direction", "Latency time", "Flight time"]
LEVELS = {"Gender": ["Female", "Male"], "Sided": ["Left", "None", "Right"]}
SEVERITIES = ["Mild", "Severe", "Medium"]
FOUR_DIRECTIONS = ("LL", "LR", "RL", "RR")
EIGHT_DIRECTIONS = ("LL", "LR", "LS", "RL", "RR", "RS", "SL", "SR")
CHOSEN_FEATURES = [
    "Tremors", "Sided_None",
    "mean_L_hold_time", "mean_S_hold_time", "amax_L_hold_time", "var_S_hold_time", "iqr_S_hold_time",
    "skew_L_hold_time", "skew_R_hold_time", "skew_S_hold_time", "kurtosis_R_hold_time",
    "mean_LR_latency_time", "mean_RL_latency_time", "var_RR_latency_time", "iqr_LR_latency_time",
    "iqr_RR_latency_time", "skew_LR_latency_time",
]
# End of fixed values.

HOLD_LATENCY_DIFFERENCES = (
    Difference("R_L_mean_difference", "hold_time", "L", "R"),
    Difference("LL_RR_mean_difference", "latency_time", "LL", "RR"),
    Difference("LR_RL_mean_difference", "latency_time", "LR", "RL"),
)


@dataclass(frozen=True)
class FeatureConfig:
    """What the pipeline keeps and computes. All bounds are exclusive and in milliseconds."""

    hands: tuple[str, ...] = ("L", "R", "S")
    directions: tuple[str, ...] = FOUR_DIRECTIONS
    stats: tuple[str, ...] = ("mean", "median", "amax", "amin", "var", "iqr", "skew", "kurtosis")
    upper: float = 2000.0
    more_than: int = 2000
    one_hot: tuple[str, ...] = ("Gender", "Sided")
    dropped: tuple[str, ...] = ("BirthYear", "DiagnosisYear", "UPDRS", "DA", "MAOB", "Other")
    dropped_at_end: tuple[str, ...] = ("user_id", "Impact")
    differences: tuple[Difference, ...] = ()
    missing: str = "keep"
    degenerate: str = "null"
    #: Exact quartiles, or ones from a sketch of ``sketch_size`` that needs a single shuffle.
    exact: bool = True
    sketch_size: int = 400
    negatives: str = "drop"
    levels: dict = field(default_factory=lambda: dict(LEVELS))

    @property
    def hold(self) -> Measure:
        return Measure("hold_time", "Hand", "Hold time", self.hands)

    @property
    def latency(self) -> Measure:
        return Measure("latency_time", "Direction", "Latency time", self.directions)

    @property
    def measures(self) -> list[Measure]:
        return [self.hold, self.latency]

    def statistic_names(self, suffix: str | None = None) -> list[str]:
        """Names of the statistic and difference columns, in table order."""
        names: list[str] = []
        for m in self.measures:
            if suffix in (None, m.suffix):
                names += feature_names(m, self.stats)
                names += [d.name for d in self.differences if d.suffix == m.suffix]
        return names

    def with_rows_more_than(self, rows: int) -> "FeatureConfig":
        return replace(self, more_than=rows)


# The statistics and dropped columns of each variant.
VARIANTS = {
    "three_second": FeatureConfig(
        hands=("L", "R"), upper=3000.0, one_hot=("Sided",),
        dropped=("BirthYear", "DiagnosisYear", "UPDRS", "DA", "MAOB", "Other", "Gender"),
        stats=("mean", "skew", "kurtosis", "std", "var", "amax", "amin", "iqr", "median"),
        differences=HOLD_LATENCY_DIFFERENCES,
    ),
    "chosen": FeatureConfig(),
    "wide": FeatureConfig(
        directions=EIGHT_DIRECTIONS,
        stats=("mean", "median", "amax", "amin", "var", "iqr", "skew", "kurtosis", "std"),
        differences=HOLD_LATENCY_DIFFERENCES, dropped_at_end=("user_id", "Impact", "Levadopa"),
    ),
    "lean": FeatureConfig(
        one_hot=("Sided",),
        dropped=("BirthYear", "DiagnosisYear", "UPDRS", "DA", "MAOB", "Other", "Gender", "Levadopa"),
        stats=("mean", "median", "skew", "kurtosis", "amax", "amin", "iqr"),
    ),
}
# End of fixed values.


def model_columns(variant: str, table: str = "both") -> list[str]:
    """Feature names a variant trains on, by name. ``table``: ``both``, ``hold`` or ``latency``."""
    config = VARIANTS[variant]
    sided = [f"Sided_{level}" for level in LEVELS["Sided"]]
    gender = [f"Gender_{level}" for level in LEVELS["Gender"]] if "Gender" in config.one_hot else []
    suffix = {"both": None, "hold": "hold_time", "latency": "latency_time"}[table]
    names = config.statistic_names(suffix)
    if variant == "wide" and table == "hold":
        return ["Tremors", *gender, *sided, *names]
    if variant == "wide" and table == "both":
        return ["Tremors", *gender, *sided, *names]
    if variant == "three_second" and table == "hold":
        # This variant's hold model takes only the first statistics and no side.
        return ["Tremors", *names[:9]]
    if variant == "three_second" and table == "latency":
        return ["Tremors", *sided, *names[:18]]
    return ["Tremors", *sided, *names]
