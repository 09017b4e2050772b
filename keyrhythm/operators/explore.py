"""The numbers behind exploration plots, as tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import DataFrame, functions as F

from keyrhythm.operators.profile import profile
from keyrhythm.operators.selection import anova_f, binned, ranges, unfold_features


def feature_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, median, dispersion (std / mean), min, max and missing count of each column."""
    long = unfold_features(df, columns, [])
    missing = df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in columns])
    gaps = unfold_features(missing, columns, []).select("feature", F.col("value").cast("bigint").alias("missing"))
    stats = profile(long, ["feature"])
    return gaps.join(stats, "feature", "left").select(
        "feature", "mean", "median", (F.col("std") / F.col("mean")).alias("dispersion"),
        F.col("amin").alias("min"), F.col("amax").alias("max"), "missing",
    )


def box_summary(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Quartiles, extremes and mean by class, with the feature's F across the classes."""
    stats = profile(unfold_features(df, columns, [label]), ["feature", label])
    return stats.join(anova_f(df, columns, label), "feature").select(
        "feature", label, "count", F.col("amin").alias("min"), "q1", "median", "q3",
        F.col("amax").alias("max"), "mean", "f_score",
    )


def histogram(df: DataFrame, column: str, label: str, bins: int = 10) -> DataFrame:
    """Counts per equal-width bin and class."""
    low_high = ranges(df, [column])[column]
    return df.where(F.col(column).isNotNull()).groupBy(
        binned(column, low_high, bins).alias("bin"), label
    ).agg(F.count("*").alias("n"))


def sieve(df: DataFrame, first: str, second: str) -> DataFrame:
    """Observed and expected counts of two categories, and each cell's part of chi-squared."""
    cells = df.where(F.col(first).isNotNull() & F.col(second).isNotNull()).groupBy(first, second).agg(
        F.count("*").alias("observed")
    )
    rows = cells.groupBy(first).agg(F.sum("observed").alias("_row"))
    columns = cells.groupBy(second).agg(F.sum("observed").alias("_column"))
    total = cells.agg(F.sum("observed")).scalar()
    expected = F.col("_row").cast("double") * F.col("_column") / total
    observed = F.coalesce(F.col("observed"), F.lit(0)).cast("bigint")
    # Every pair of levels is a row of the answer, the empty ones too.
    full = rows.crossJoin(columns).join(cells, [first, second], "left")
    return full.select(
        first, second, observed.alias("observed"), expected.alias("expected"),
        ((observed - expected) * (observed - expected) / expected).alias("chi2_part"),
    )


def chi2_scores(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Rows (feature, chi2, freedom, p): independence of each categorical column from the label.

    Rows with a NULL in the label or any of the columns are left out.
    """
    names = [*columns, label]
    known = df.select(*[F.col(c).cast("string").alias(c) for c in names]).dropna()
    coded = [f"_{c}" for c in names]
    indexed = StringIndexer(inputCols=names, outputCols=coded).fit(known).transform(known)
    rows = VectorAssembler(inputCols=coded[:-1], outputCol="_x").transform(indexed)
    found = ChiSquareTest.test(rows, "_x", coded[-1], flatten=True)
    feature = F.get(F.array(*[F.lit(c) for c in columns]), F.col("featureIndex"))
    return found.select(
        feature.alias("feature"), F.col("statistic").alias("chi2"), F.col("degreesOfFreedom").alias("freedom"),
        F.col("pValue").alias("p"),
    )


def mosaic(df: DataFrame, first: str, second: str, label: str, bins: int = 4) -> DataFrame:
    """Share of each (bin of first, bin of second, class) in all rows with both values."""
    bounds = ranges(df, [first, second])
    known = df.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    cells = known.groupBy(
        binned(first, bounds[first], bins).alias(f"{first}_bin"),
        binned(second, bounds[second], bins).alias(f"{second}_bin"),
        label,
    ).agg(F.count("*").alias("n"))
    return cells.withColumn("share", F.col("n") / cells.agg(F.sum("n")).scalar())


def linear_projection(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Plane coordinates: features scaled to 0..1, summed along anchors spread over a circle."""
    bounds = ranges(df, columns)
    x, y = F.lit(0.0), F.lit(0.0)
    for i, c in enumerate(columns):
        low, high = bounds[c]
        scaled = (F.col(c) - F.lit(low)) / F.lit(high - low) if high != low else F.lit(0.0)
        angle = 2.0 * math.pi * i / len(columns)
        x, y = x + scaled * F.lit(math.cos(angle)), y + scaled * F.lit(math.sin(angle))
    return df.select(*keep, x.alias("x"), y.alias("y"))


def tree_nodes(spark, model, names: Sequence[str]) -> DataFrame:
    """A fitted tree's nodes as rows, in depth-first order; a model is as small as its tree."""
    rows: list[tuple] = []

    def visit(node, parent: int | None, depth: int) -> None:
        me = len(rows)
        feature = threshold = None
        if node.numDescendants() > 0:
            split = node.split()
            feature, threshold = names[split.featureIndex()], float(split.threshold())
        rows.append((me, parent, depth, feature, threshold, float(node.prediction()), float(node.impurity())))
        if node.numDescendants() > 0:
            visit(node.leftChild(), me, depth + 1)
            visit(node.rightChild(), me, depth + 1)

    visit(model._java_obj.rootNode(), None, 0)
    return spark.createDataFrame(
        rows, "node int, parent int, depth int, feature string, threshold double, prediction double, impurity double"
    )


def nomogram(df: DataFrame, model, columns: Sequence[str], top: int = 10) -> DataFrame:
    """The strongest effects of a linear model: coefficient times the feature's range."""
    bounds = ranges(df, columns)
    effects = []
    for name, weight in zip(columns, model.coefficients.toArray()):
        low, high = bounds[name]
        effects.append((name, float(weight), float(low), float(high), float(weight) * float(high - low)))
    effects.sort(key=lambda e: (-abs(e[4]), e[0]))
    return df.sparkSession.createDataFrame(
        effects[:top], "feature string, coefficient double, low double, high double, effect double"
    )
