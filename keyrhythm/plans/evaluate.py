"""Fitting, cross-validation, sweeps and searches that end in metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, Window, functions as F

from keyrhythm.operators.metrics import accuracy, class_aucs, cross_validated, label_ranking, model_metrics, per_class
from keyrhythm.operators.scaling import assemble, fit_scaling
from keyrhythm.operators.selection import anova_f, ranked, recursive_elimination
from keyrhythm.operators.splits import contiguous_folds, stratified_folds, stratified_split
from keyrhythm.plans.classifiers import class_scores, predictions
from keyrhythm.plans.pool import fitted
from keyrhythm.session import cut_lineage, settled


def _stack(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _told(model: Model, rows: DataFrame, key: str, marks: dict, scores: bool) -> DataFrame:
    out = class_scores(model, rows, key) if scores else predictions(model, rows, key)
    return out.select(*[F.lit(v).alias(n) for n, v in marks.items()], *out.columns)


def fold_predictions(df: DataFrame, models: dict[str, Estimator], key: str = "key", scores: bool = False) -> DataFrame:
    """Every row predicted by models that did not see its ``fold``: (model, fold, key, label, ...).

    All fits share the one table of folds, which should be settled. The predictions are written once,
    so that every score made of them reads rows and does not predict again. ``scores`` gives
    the probabilities of all classes instead of that of class 1.
    """
    folds = sorted(r["fold"] for r in df.select("fold").distinct().collect())
    asked = [(name, model, fold) for fold in folds for name, model in models.items()]
    done = fitted([(model, df.where(F.col("fold") != fold)) for _, model, fold in asked])
    parts = [
        _told(model, df.where(F.col("fold") == fold), key, {"model": name, "fold": fold}, scores)
        for (name, _, fold), model in zip(asked, done)
    ]
    return cut_lineage(_stack(parts))


def test_predictions(train: DataFrame, test: DataFrame, models: dict[str, Estimator], key: str = "key") -> DataFrame:
    done = fitted([(model, train) for model in models.values()])
    return cut_lineage(_stack([_told(model, test, key, {"model": name}, False) for name, model in zip(models, done)]))


def cross_validate(df: DataFrame, models: dict[str, Estimator], key: str = "key", folds: int = 10,
                   stratified: bool = False) -> DataFrame:
    """Rows (model, cv_mean, cv_std) of the accuracy. Blocks in key order unless ``stratified``."""
    split = stratified_folds(df, key, "label", folds) if stratified else contiguous_folds(df, key, folds)
    split = settled(split)
    try:
        return cross_validated(fold_predictions(split, models, key), ["model"])
    finally:
        split.unpersist()


def test_and_score(df: DataFrame, models: dict[str, Estimator], key: str = "key", folds: int = 5) -> DataFrame:
    """Rows (model, fold, metric, value) over stratified folds, for any number of classes.

    Accuracy, and AUC, precision, recall and F1 averaged over the classes; a class's AUC is that of its
    probability against all other classes. Classes that a fold does not hold are left out of its averages.
    """
    split = settled(stratified_folds(df, key, "label", folds))
    try:
        told = fold_predictions(split, models, key, scores=True)
    finally:
        split.unpersist()
    groups = ["model", "fold"]
    classes = per_class(told, groups).where("support > 0").groupBy(*groups).agg(*[F.avg(m).alias(m) for m in ("precision", "recall", "f1")])
    ranks = class_aucs(told, groups).groupBy(*groups).agg(F.avg("auc").alias("auc"))
    wide = accuracy(told, groups).join(classes, groups).join(ranks, groups)
    metrics = ("accuracy", "auc", "f1", "precision", "recall")
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return wide.select(*groups, F.explode(pairs).alias("_m")).select(*groups, "_m.*")


def split_and_scale(df: DataFrame, columns: Sequence[str], label: str, key: str, test_share: float = 0.4,
                    seed: int = 0, scale: bool = True) -> tuple[DataFrame, DataFrame]:
    """Train and test rows (key, label, features); the scaling is learned on the train part only."""
    split = stratified_split(df.select(key, label, *columns), key, label, test_share, seed)
    split = settled(split)
    train, test = split.where("is_test = 0"), split.where("is_test = 1")
    if scale:
        scaling = fit_scaling(train, columns)
        train, test = scaling.apply(train), scaling.apply(test)
    keep = [F.col(key).alias("key"), F.col(label).alias("label")]
    return assemble(train, columns, keep), assemble(test, columns, keep)


def evaluate_models(df: DataFrame, columns: Sequence[str], label: str, key: str, models: dict[str, Estimator],
                    test_share: float = 0.4, folds: int = 5, scale: bool = True, cv_on: str = "test",
                    by_label: bool = False) -> DataFrame:
    """Rows (model, metric, value): test metrics and cross-validated accuracy of each model.

    AUC and average precision are those of the scores; ``by_label`` adds those of the bare predictions.

    ``cv_on="test"`` cross-validates with stratified folds on the test part; ``"all"`` with
    contiguous folds on all rows, unscaled.
    """
    train, test = split_and_scale(df, columns, label, key, test_share, scale=scale)
    told = test_predictions(train, test, models)
    scores = model_metrics(told)
    if by_label:
        scores = scores.unionByName(label_ranking(told))
    if cv_on == "test":
        spread = cross_validate(test, models, folds=folds, stratified=True)
    else:
        every = assemble(df, columns, [F.col(key).alias("key"), F.col(label).alias("label")])
        spread = cross_validate(every, models, folds=folds)
    pairs = F.create_map(F.lit("cv_mean"), F.col("cv_mean"), F.lit("cv_std"), F.col("cv_std"))
    return scores.unionByName(spread.select("model", F.explode(pairs).alias("metric", "value")))


def best_model(report: DataFrame, metric: str = "accuracy") -> DataFrame:
    """The model with the highest value of a metric; the first name wins a tie."""
    rows = report.where(F.col("metric") == metric)
    return rows.orderBy(F.desc("value"), "model").limit(1).select("model", "metric", "value")


def sweep(df: DataFrame, ordered: Sequence[str], counts: Sequence[int], label: str, key: str,
          models: dict[str, Estimator], test_share: float = 0.4, folds: int = 0) -> DataFrame:
    """Rows (step, features, model, accuracy, cv_accuracy, best): each model on the first k of an ordered feature list.

    ``step`` numbers the fits in the order of ``counts``; ``best`` is the highest accuracy of the model up
    to it. ``cv_accuracy`` is the mean over ``folds`` contiguous folds of all rows, unscaled, or NULL
    without folds. Rows are split once and columns are scaled once, since neither depends on k, and
    all fits of all k share one pool.
    """
    if max(counts) > len(ordered):
        raise ValueError(f"cannot choose {max(counts)} of {len(ordered)} features")
    split = settled(stratified_split(df.select(key, label, *ordered), key, label, test_share))
    train, test = split.where("is_test = 0"), split.where("is_test = 1")
    scaling = fit_scaling(train, ordered)
    train, test = settled(scaling.apply(train)), settled(scaling.apply(test))
    keep = [F.col(key).alias("key"), F.col(label).alias("label")]
    asked = [(step, k, name) for step, (k, name) in enumerate((k, name) for k in counts for name in models)]
    held = [split, train, test]
    try:
        done = fitted([(models[name], assemble(train, ordered[:k], keep)) for _, k, name in asked])
        told = cut_lineage(_stack([
            _told(model, assemble(test, ordered[:k], keep), "key", {"step": step, "features": int(k), "model": name}, False)
            for (step, k, name), model in zip(asked, done)
        ]))
        groups = ["step", "features", "model"]
        out = accuracy(told, groups)
        if folds:
            folded = settled(contiguous_folds(df.select(key, label, *ordered), key, folds))
            held.append(folded)
            each = [(step, k, name, fold) for step, k, name in asked for fold in range(folds)]
            done = fitted([(models[name], assemble(folded.where(F.col("fold") != fold), ordered[:k], keep)) for _, k, name, fold in each])
            unseen = cut_lineage(_stack([
                _told(model, assemble(folded.where(F.col("fold") == fold), ordered[:k], keep), "key",
                      {"step": step, "features": int(k), "model": name, "fold": fold}, False)
                for (step, k, name, fold), model in zip(each, done)
            ]))
            out = out.join(cross_validated(unseen, groups).select(*groups, F.col("cv_mean").alias("cv_accuracy")), groups)
        else:
            out = out.withColumn("cv_accuracy", F.lit(None).cast("double"))
    finally:
        for table in held:
            table.unpersist()
    # One row per fit.
    so_far = Window.partitionBy("model").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("best", F.max("accuracy").over(so_far))


def elimination_sweep(df: DataFrame, columns: Sequence[str], label: str, key: str, ranker: Estimator,
                      models: dict[str, Estimator], counts: Sequence[int], folds: int = 0) -> DataFrame:
    """One elimination gives the whole ranking, of which every k is a prefix."""
    ranks = recursive_elimination(df, columns, label, ranker.copy().fit)
    return sweep(df, sorted(columns, key=lambda c: (ranks[c], c)), counts, label, key, models, folds=folds)


def k_best_sweep(df: DataFrame, columns: Sequence[str], label: str, key: str, models: dict[str, Estimator],
                 counts: Sequence[int] = tuple(range(15, 1, -1)), test_share: float = 0.3, folds: int = 0) -> DataFrame:
    order = [r["feature"] for r in ranked(anova_f(df, columns, label), "f_score").collect()]
    return sweep(df, order, counts, label, key, models, test_share, folds)


def grid_search(df: DataFrame, estimator: Estimator, grid: list[dict], key: str = "key", folds: int = 5) -> DataFrame:
    """Rows (setting, accuracy) over stratified folds for each parameter map."""
    split = stratified_folds(df, key, "label", folds)
    split = settled(split)
    search = CrossValidator(
        estimator=estimator, estimatorParamMaps=grid, numFolds=folds, foldCol="fold", parallelism=2,
        evaluator=MulticlassClassificationEvaluator(metricName="accuracy"),
    ).fit(split)
    rows = [
        (", ".join(f"{p.name}={v}" for p, v in sorted(setting.items(), key=lambda item: item[0].name)), float(score))
        for setting, score in zip(grid, search.avgMetrics)
    ]
    return df.sparkSession.createDataFrame(rows, "setting string, accuracy double")
