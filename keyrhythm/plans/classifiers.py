"""The classifiers and their settings, as Spark ML estimators over ``features`` and ``label``."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.sql import DataFrame, functions as F

from keyrhythm.operators.boosting import AdaBoost
from keyrhythm.operators.gaussian import QuadraticDiscriminant
from keyrhythm.operators.neighbours import NearestNeighbours
from keyrhythm.operators.stored import Stored
from keyrhythm.operators.voting import Voting
from keyrhythm.plans.pool import fitted


class LinearMargin(Estimator, HasFeaturesCol, HasLabelCol, Stored):
    """Linear support vector machine with probabilities.

    The machine's margin is too sure on the rows that it was fitted on, so the logistic curve from
    margin to probability is fitted on margins of rows that their machine has not seen: the rows are
    dealt into ``folds`` by a hash of their features (equal rows stay together), and each fold is
    told by a machine of the others. The machine that is kept is fitted on all rows.
    """

    def __init__(self, folds: int = 3, featuresCol: str = "features", labelCol: str = "label", **settings):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol)
        self.folds, self.settings = folds, settings

    def plain(self) -> dict:
        return {"folds": self.folds, **self.settings}

    def _fit(self, dataset: DataFrame) -> "LinearMarginModel":
        features, label = self.getFeaturesCol(), self.getLabelCol()
        machine = LinearSVC(featuresCol=features, labelCol=label, **self.settings)
        fold = F.pmod(F.xxhash64(vector_to_array(features)), F.lit(self.folds))
        rows = dataset.select(features, F.col(label).cast("double").alias(label), fold.alias("_fold")).persist()
        try:
            parts = [self._others(rows, i, label) for i in range(self.folds)]
            # Its own machine for each fold and the one of all rows, at the same time.
            *machines, kept = fitted([(machine, part) for part in (*parts, rows)], self.folds + 1)
            told = [m.transform(rows.where(F.col("_fold") == i)).select(label, "rawPrediction") for i, m in enumerate(machines)]
            unseen = told[0]
            for part in told[1:]:
                unseen = unseen.unionByName(part)
            curve = LogisticRegression(
                featuresCol="rawPrediction", rawPredictionCol="_raw", labelCol=label, regParam=1e-6
            ).fit(unseen)
            return LinearMarginModel(kept, curve)
        finally:
            rows.unpersist()

    def _others(self, rows: DataFrame, fold: int, label: str) -> DataFrame:
        """The rows of the other folds; all rows if those lack a class."""
        others = rows.where(F.col("_fold") != fold)
        known = others.agg(F.min(label).alias("low"), F.max(label).alias("high")).first()
        return others if known["low"] != known["high"] else rows


class LinearMarginModel(Model, Stored):
    def __init__(self, machine, curve):
        super().__init__()
        self.machine, self.curve = machine, curve

    def parts(self) -> dict[str, Model]:
        return {"machine": self.machine, "curve": self.curve}

    @classmethod
    def restored(cls, plain: dict, tables: dict, parts: dict) -> "LinearMarginModel":
        return cls(**parts)

    @property
    def coefficients(self):
        return self.machine.coefficients

    def _transform(self, dataset: DataFrame) -> DataFrame:
        told = self.machine.transform(dataset).withColumnRenamed("prediction", "_side")
        out = self.curve.transform(told)
        return out.select(*dataset.columns, "probability", F.col("_side").alias("prediction"))


def weight_of_penalty(rows: int, c: float = 1.0) -> float:
    """A penalty stated per data set (1/C) as Spark's penalty per row."""
    return 1.0 / (c * max(rows, 1))


def logistic(rows: int) -> LogisticRegression:
    return LogisticRegression(regParam=weight_of_penalty(rows), standardization=False, maxIter=100, tol=1e-4)


def tree(depth: int = 30, min_rows: int = 1, seed: int = 0) -> DecisionTreeClassifier:
    """Entropy tree; Spark's deepest tree has 30 levels."""
    return DecisionTreeClassifier(impurity="entropy", maxDepth=depth, minInstancesPerNode=min_rows, seed=seed)


def forest(trees: int = 200, depth: int = 30, seed: int = 0) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed)


def boosted(rounds: int = 200, depth: int = 5, rate: float = 1.0, seed: int = 0) -> GBTClassifier:
    return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed)


def linear_margin(rows: int, probability: bool = True):
    settings = dict(regParam=weight_of_penalty(rows), standardization=False, maxIter=100, tol=1e-3)
    return LinearMargin(**settings) if probability else LinearSVC(**settings)


def perceptron(inputs: int, hidden: tuple[int, ...] = (5, 5), classes: int = 2, rounds: int = 100, seed: int = 0):
    """Spark's hidden units are sigmoids and its solver is L-BFGS."""
    return MultilayerPerceptronClassifier(layers=[inputs, *hidden, classes], maxIter=rounds, tol=1e-4, seed=seed)


def naive_bayes() -> NaiveBayes:
    return NaiveBayes(modelType="gaussian")


def line_up(rows: int, inputs: int, key: str = "key", k: int = 5, trees: int = 200, rounds: int = 200,
            depth: int = 30, boosted_depth: int = 5, perceptron_rounds: int = 100) -> dict[str, Estimator]:
    """All classifiers by name."""
    return {
        "logistic": logistic(rows),
        "neighbours": NearestNeighbours(k=k, keyCol=key),
        "tree": tree(depth),
        "forest": forest(trees, 5),
        "naive_bayes": naive_bayes(),
        "boosted": boosted(rounds, boosted_depth),
        "margin": linear_margin(rows),
        "perceptron": perceptron(inputs, rounds=perceptron_rounds),
        "discriminant": QuadraticDiscriminant(),
        "adaboost": AdaBoost(rounds=rounds, rate=0.5),
    }


def hard_vote(members: dict[str, Estimator]) -> Voting:
    return Voting(members, "hard")


def soft_vote(members: dict[str, Estimator]) -> Voting:
    return Voting(members, "soft")


def predictions(model: Model, df: DataFrame, key: str = "key", label: str = "label") -> DataFrame:
    """Rows (key, label, prediction, score); the score is the probability of class 1 if there is one."""
    told = model.transform(df)
    if "probability" in told.columns:
        score = F.get(vector_to_array("probability"), F.lit(1))
    elif "rawPrediction" in told.columns:
        score = F.get(vector_to_array("rawPrediction"), F.lit(1))
    else:
        score = F.col("prediction")
    return told.select(
        F.col(key), F.col(label).cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"),
        score.cast("double").alias("score"),
    )


def class_scores(model: Model, df: DataFrame, key: str = "key", label: str = "label") -> DataFrame:
    """Rows (key, label, prediction, scores) with a probability for each class.

    A model without probabilities gives 1 to the class that it predicts and 0 to class 0 or 1 otherwise.
    """
    told = model.transform(df)
    if "probability" in told.columns:
        scores = vector_to_array("probability")
    else:
        scores = F.array((F.col("prediction") != 1).cast("double"), (F.col("prediction") == 1).cast("double"))
    return told.select(
        F.col(key), F.col(label).cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"),
        scores.alias("scores"),
    )
