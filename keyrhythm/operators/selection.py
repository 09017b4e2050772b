"""Univariate scores, k best, and recursive elimination."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from keyrhythm.functions.numeric import equal_width_bin, share
from keyrhythm.operators.scaling import assemble


def unfold_features(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Rows (kept columns, feature, value)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("_f")).select(*keep, "_f.feature", "_f.value")


def anova_f(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """One-way ANOVA F of each feature: spread between class means over spread inside classes.

    One partial aggregation per class over the wide rows; only (classes x features) rows are
    unfolded afterwards.
    """
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.var_pop(c).alias(f"v{i}")]
    per_class = df.where(F.col(label).isNotNull()).groupBy(label).agg(*aggs)
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("m"),
                 F.col(f"v{i}").alias("v"))
        for i, c in enumerate(columns)
    ])
    long = per_class.select(F.explode(cells).alias("_c")).select("_c.*")
    summed = long.groupBy("feature").agg(
        F.count("*").alias("_k"), F.sum("n").alias("_n"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_mean"),
        F.sum(F.col("n") * F.col("v")).alias("_within"),
        F.collect_list(F.struct("n", "m")).alias("_classes"),
    )
    between = F.aggregate(
        "_classes", F.lit(0.0),
        lambda total, c: total + c["n"] * (c["m"] - F.col("_mean")) * (c["m"] - F.col("_mean")),
    )
    inside = F.col("_within") / (F.col("_n") - F.col("_k"))
    return summed.select("feature", F.when(inside > 0, between / (F.col("_k") - 1) / inside).alias("f_score"))


def ranked(scores: DataFrame, score: str, k: int | None = None) -> DataFrame:
    """Best first, names break ties. One row per feature, so the order is small."""
    out = scores.orderBy(F.desc_nulls_last(score), "feature")
    return out if k is None else out.limit(k)


def k_best(df: DataFrame, columns: Sequence[str], label: str, k: int = 10) -> list[str]:
    """Names of the k features with the highest F (at most one row per feature is collected)."""
    return [row["feature"] for row in ranked(anova_f(df, columns, label), "f_score", k).collect()]


def ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest value of each column."""
    aggs = [F.min(c).alias(f"l{i}") for i, c in enumerate(columns)]
    aggs += [F.max(c).alias(f"h{i}") for i, c in enumerate(columns)]
    row = df.agg(*aggs).first()
    return {c: (row[f"l{i}"], row[f"h{i}"]) for i, c in enumerate(columns)}


def binned(column: str, bounds: tuple[float, float], bins: int) -> Column:
    low, high = (F.lit(float(b)) if b is not None else F.lit(0.0) for b in bounds)
    return equal_width_bin(F.col(column).cast("double"), low, high, bins)


def gini_scores(df: DataFrame, columns: Sequence[str], label: str, bins: int = 4) -> DataFrame:
    """Decrease of the Gini impurity of the label when a feature's equal-width bin is known."""
    bounds = ranges(df, columns)
    coded = df.where(F.col(label).isNotNull()).select(
        label, *[binned(c, bounds[c], bins).alias(c) for c in columns]
    )
    cells = (
        unfold_features(coded, columns, [label]).where(F.col("value").isNotNull())
        .groupBy("feature", "value", label).agg(F.count("*").alias("n"))
    )
    by_bin = cells.groupBy("feature", "value").agg(
        F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("n")).alias("_sq")
    )
    after = by_bin.groupBy("feature").agg(
        F.sum("_n").alias("_total"), F.sum(F.col("_n") - share(F.col("_sq"), F.col("_n"))).alias("_impure")
    )
    by_class = cells.groupBy("feature", label).agg(F.sum("n").alias("_c"))
    before = by_class.groupBy("feature").agg(
        F.sum(F.col("_c").cast("double") * F.col("_c")).alias("_csq"), F.sum("_c").alias("_all")
    )
    prior = 1.0 - F.col("_csq") / (F.col("_all").cast("double") * F.col("_all"))
    return after.join(before, "feature").select(
        "feature", (prior - F.col("_impure") / F.col("_total")).alias("gini_score")
    )


def importances(model, names: Sequence[str]) -> dict[str, float]:
    """Feature name -> importance of a fitted tree, forest, boosting or linear model."""
    if hasattr(model, "featureImportances"):
        return {n: float(v) for n, v in zip(names, model.featureImportances.toArray())}
    return {n: abs(float(v)) for n, v in zip(names, model.coefficients.toArray())}


def importance_table(df: DataFrame, model, names: Sequence[str]) -> DataFrame:
    """The importances as rows, largest first."""
    rows = sorted(importances(model, names).items(), key=lambda item: (-item[1], item[0]))
    return df.sparkSession.createDataFrame(
        [(i + 1, name, value) for i, (name, value) in enumerate(rows)],
        "rank int, feature string, importance double",
    )


def recursive_elimination(df: DataFrame, columns: Sequence[str], label: str,
                          fit: Callable[[DataFrame], object], keep: int = 1) -> dict[str, int]:
    """Drop the least important feature, refit, repeat; returns feature -> rank.

    Rank 1 is given to the ``keep`` features left at the end, rank 2 to the last one dropped, and
    so on. With ``keep=1`` the ranks hold every smaller selection: the best k are those ranked
    1..k. Equal importances drop the later name first. ``df`` is read once per round: settle it first.
    """
    left = list(columns)
    ranks: dict[str, int] = {}
    while len(left) > keep:
        weights = importances(fit(assemble(df, left, [label])), left)
        worst = max(left, key=lambda name: (-weights[name], name))
        ranks[worst] = len(left) - keep + 1
        left.remove(worst)
    return {**{name: 1 for name in left}, **ranks}
