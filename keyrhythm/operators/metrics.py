"""Classification metrics as aggregations over prediction rows (label, prediction[, score])."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from keyrhythm.functions.numeric import share
from keyrhythm.operators.prefix import running_totals
from keyrhythm.operators.ranges import with_range


def class_balance(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def _cells(predictions: DataFrame, groups: Sequence[str]) -> DataFrame:
    return predictions.groupBy(*groups, "label", "prediction").agg(F.count("*").alias("n"))


def confusion(predictions: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Counts of every (label, prediction) pair of known classes, zeros included."""
    cells = _cells(predictions, groups)
    classes = cells.groupBy(*groups).agg(
        F.array_distinct(F.concat(F.collect_set("label"), F.collect_set("prediction"))).alias("_classes")
    )
    grid = (
        classes.select(*groups, "_classes", F.explode("_classes").alias("label"))
        .select(*groups, "label", F.explode("_classes").alias("prediction"), F.lit(0).cast("bigint").alias("n"))
    )
    return cells.unionByName(grid).groupBy(*groups, "label", "prediction").agg(F.sum("n").alias("n"))


def per_class(predictions: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each class; 0 where the quotient is undefined."""
    hit = F.col("label") == F.col("prediction")
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(hit, F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")),
    )
    totals = (
        _cells(predictions, groups)
        .select(*groups, F.explode(sides).alias("_s"))
        .groupBy(*groups, F.col("_s.class").alias("class"))
        .agg(F.sum("_s.support").alias("support"), F.sum("_s.predicted").alias("predicted"),
             F.sum("_s.hits").alias("hits"))
    )
    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    return totals.select(
        *groups, "class",
        share(hits, predicted).alias("precision"),
        share(hits, support).alias("recall"),
        share(2.0 * hits, support + predicted).alias("f1"),
        "support", "hits",
    )


def class_report(predictions: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Per-class scores with accuracy, macro and weighted averages as further rows."""
    classes = per_class(predictions, groups)
    scores = ["precision", "recall", "f1"]
    total = F.sum("support").alias("support")
    parts = [classes.select(*groups, F.col("class").cast("string").alias("class"), *scores, "support")]
    accuracy = F.sum("hits") / F.sum("support")
    averages: dict[str, list[Column]] = {
        "accuracy": [accuracy.alias(s) for s in scores],
        "macro avg": [F.avg(s).alias(s) for s in scores],
        "weighted avg": [(F.sum(F.col(s) * F.col("support")) / F.sum("support")).alias(s) for s in scores],
    }
    for name, columns in averages.items():
        row = classes.groupBy(*groups).agg(*columns, total)
        parts.append(row.select(*groups, F.lit(name).alias("class"), *scores, "support"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def score_steps(predictions: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score, highest first, with running counts of both classes.

    Equal scores are merged before anything is ordered, and the running counts are taken per
    range of scores, cut at sampled borders, so no task sees all rows.
    """
    positive = (F.col("label") == 1).cast("bigint")
    merged = predictions.groupBy(*groups, "score").agg(
        F.sum(positive).alias("positives"), F.sum(1 - positive).alias("negatives"),
        F.max(F.col("score").isNotNull() & ~F.isnan("score")).alias("_known"),
    )
    steps = with_range(merged.where("_known").drop("_known"), "_range", ["score"], [*groups, "score"])
    # Asked of the steps, and with a range that is never NULL, these tests stay off the scan of raw rows.
    return running_totals(
        steps, list(groups), ["score"], F.coalesce("_range", F.lit(0)),
        {"tp": F.col("positives"), "fp": F.col("negatives")}, descending=True,
    ).drop("_range")


def roc_points(predictions: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Rows (threshold, fpr, tpr), one per distinct score, and the start (infinity, 0, 0)."""
    def point(threshold: Column, fp: Column, tp: Column) -> Column:
        return F.struct(threshold.cast("double").alias("threshold"), fp.alias("fpr"), tp.alias("tpr"))

    own = point(F.col("score"), share(F.col("fp"), F.col("fp_total")), share(F.col("tp"), F.col("tp_total")))
    start = point(F.lit(float("inf")), F.lit(0.0), F.lit(0.0))
    highest = F.col("tp") + F.col("fp") == F.col("positives") + F.col("negatives")
    points = F.explode(F.when(highest, F.array(start, own)).otherwise(F.array(own))).alias("_p")
    return score_steps(predictions, groups).select(*groups, points).select(*groups, "_p.*")


def ranking_scores(predictions: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve (trapezoids) and average precision (steps).

    Both need only a step's own counts and its running counts: the previous point is the running
    count minus the step's own.
    """
    trapezoid = F.col("negatives") * (F.col("tp") - F.col("positives") / 2.0)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    summed = score_steps(predictions, groups).groupBy(*groups).agg(
        F.sum(trapezoid).alias("_area"),
        F.sum(F.col("positives") * precision).alias("_steps"),
        F.max("tp_total").alias("_p"),
        F.max("fp_total").alias("_n"),
    )
    return summed.select(
        *groups,
        share(F.col("_area"), F.col("_p").cast("double") * F.col("_n")).alias("auc"),
        share(F.col("_steps"), F.col("_p")).alias("average_precision"),
    )


def class_aucs(predictions: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Rows (class, auc) of predictions with ``scores`` (a probability per class): each class against all others, in one pass.

    Classes without rows in a group are left out.
    """
    unfolded = predictions.select(*groups, F.col("label").alias("_own"), F.posexplode("scores").alias("class", "score"))
    against = unfolded.select(*groups, "class", "score", (F.col("_own") == F.col("class")).cast("int").alias("label"))
    ranks = ranking_scores(against, [*groups, "class"]).select(*groups, "class", "auc")
    held = predictions.select(*groups, F.col("label").cast("int").alias("class")).distinct()
    return ranks.join(held, [*groups, "class"], "left_semi")


def label_ranking(predictions: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """Rows (model, metric, value): AUC and average precision of the predicted labels, taken as scores."""
    bare = predictions.withColumn("score", F.col("prediction").cast("double"))
    told = F.create_map(F.lit("label_auc"), F.col("auc"), F.lit("label_average_precision"), F.col("average_precision"))
    return ranking_scores(bare, list(groups)).select(*groups, F.explode(told).alias("metric", "value"))


def accuracy(predictions: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    hit = (F.col("label") == F.col("prediction")).cast("double")
    return predictions.groupBy(*groups).agg(F.avg(hit).alias("accuracy"))


def cross_validated(predictions: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Mean and population spread of the accuracy over folds."""
    by_fold = accuracy(predictions, [*groups, "fold"])
    return by_fold.groupBy(*groups).agg(
        F.avg("accuracy").alias("cv_mean"), F.stddev_pop("accuracy").alias("cv_std")
    )


def model_metrics(predictions: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """Rows (model, metric, value): accuracy, macro averages, AUC and average precision."""
    groups = list(groups)
    report = class_report(predictions, groups).where(F.col("class").isin("accuracy", "macro avg"))
    macro = report.where(F.col("class") == "macro avg").select(
        *groups,
        F.explode(F.create_map(F.lit("precision"), F.col("precision"), F.lit("recall"), F.col("recall"),
                               F.lit("f1"), F.col("f1"))).alias("metric", "value"),
    )
    hits = report.where(F.col("class") == "accuracy").select(
        *groups, F.lit("accuracy").alias("metric"), F.col("f1").alias("value")
    )
    ranks = ranking_scores(predictions, groups).select(
        *groups,
        F.explode(F.create_map(F.lit("auc"), F.col("auc"), F.lit("average_precision"),
                               F.col("average_precision"))).alias("metric", "value"),
    )
    return hits.unionByName(macro).unionByName(ranks)


def misclassified(predictions: DataFrame) -> DataFrame:
    return predictions.where(F.col("label") != F.col("prediction"))


def mark_misclassified(rows: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Add a 0/1 ``misclassified`` flag to every row of a table."""
    wrong = misclassified(predictions).select(key, F.lit(1).alias("_wrong")).distinct()
    return rows.join(wrong, key, "left").withColumn(
        "misclassified", F.coalesce(F.col("_wrong"), F.lit(0))
    ).drop("_wrong")
