"""Class-wise Gaussian statistics and quadratic discriminant analysis."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.sql import DataFrame, SparkSession, functions as F

from keyrhythm.operators.stored import Stored
from keyrhythm.operators.voting import most_likely


def class_moments(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Rows (label, feature, n, mean, var) with the population variance of each class."""
    aggs = [F.count("*").alias("_n")]
    for i, c in enumerate(columns):
        aggs += [F.avg(c).alias(f"m{i}"), F.var_pop(c).alias(f"v{i}")]
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col("_n").alias("n"), F.col(f"m{i}").alias("mean"),
                 F.col(f"v{i}").alias("var"))
        for i, c in enumerate(columns)
    ])
    return df.groupBy(label).agg(*aggs).select(label, F.explode(cells).alias("_c")).select(label, "_c.*")


def class_covariances(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Rows (label, i, j, n, covariance): the sample covariance of every feature pair, per class.

    Every task sums its rows' outer products around the overall mean (d x d numbers per class);
    the sums are merged by (label, i, j). ``vector`` is an array column.
    """
    d, overall = _overall_mean(df, vector)
    centre = np.array(overall)

    def partial(batches):
        sums: dict = {}
        for pdf in batches:
            for value, part in pdf.groupby("label"):
                x = np.stack(part["x"].to_numpy()).astype(float) - centre
                n, s, p = sums.get(value, (0, np.zeros(d), np.zeros((d, d))))
                sums[value] = (n + len(x), s + x.sum(axis=0), p + x.T @ x)
        i, j = np.triu_indices(d)
        for value, (n, s, p) in sums.items():
            yield pd.DataFrame({"label": value, "i": i, "j": j, "n": n, "si": s[i], "sj": s[j], "p": p[i, j]})

    kind = dict(df.dtypes)[label]
    sums = df.select(F.col(label).alias("label"), F.col(vector).alias("x")).mapInPandas(
        partial, f"label {kind}, i int, j int, n bigint, si double, sj double, p double"
    )
    total = sums.groupBy("label", "i", "j").agg(
        F.sum("n").alias("n"), F.sum("si").alias("si"), F.sum("sj").alias("sj"), F.sum("p").alias("p")
    )
    covariance = (F.col("p") - F.col("si") * F.col("sj") / F.col("n")) / F.greatest(F.col("n") - 1, F.lit(1))
    return total.select(F.col("label").alias(label), "i", "j", "n", covariance.alias("covariance"),
                        (F.col("si") / F.col("n") + F.get(F.array(*map(F.lit, overall)), F.col("i"))).alias("mean_i"))


def _overall_mean(df: DataFrame, vector: str) -> tuple[int, list[float]]:
    unfolded = df.select(F.posexplode(vector).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"))
    means = [row["m"] for row in unfolded.orderBy("i").collect()]
    return len(means), means


class QuadraticDiscriminant(Estimator, HasFeaturesCol, HasLabelCol, Stored):
    """One full Gaussian per class; ``ridge`` is added to the diagonal of a singular covariance."""

    def __init__(self, featuresCol: str = "features", labelCol: str = "label", ridge: float = 1e-6):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol)
        self.ridge = ridge

    def plain(self) -> dict:
        return {"ridge": self.ridge}

    def _fit(self, dataset: DataFrame) -> "QuadraticDiscriminantModel":
        label = self.getLabelCol()
        rows = dataset.select(label, vector_to_array(self.getFeaturesCol()).alias("_x"))
        # The model itself: (classes x features x features) numbers, whatever the row count.
        cells = class_covariances(rows, "_x", label).toPandas()
        d = int(cells["j"].max()) + 1
        total = cells[(cells["i"] == 0) & (cells["j"] == 0)]["n"].sum()
        classes = {}
        for value, part in cells.groupby(label):
            matrix = np.zeros((d, d))
            matrix[part["i"], part["j"]] = part["covariance"]
            matrix = np.triu(matrix) + np.triu(matrix, 1).T
            diagonal = part[part["i"] == part["j"]].sort_values("i")
            if np.linalg.matrix_rank(matrix) < d:
                matrix = matrix + np.eye(d) * self.ridge * max(1.0, np.trace(matrix) / d)
            classes[int(value)] = (
                diagonal["mean_i"].to_numpy(), np.linalg.inv(matrix), np.linalg.slogdet(matrix)[1],
                np.log(diagonal["n"].iloc[0] / total),
            )
        return QuadraticDiscriminantModel(classes, self.getFeaturesCol())


class QuadraticDiscriminantModel(Model, HasFeaturesCol, Stored):
    """``classes``: label -> (mean, inverse covariance, log determinant, log prior)."""

    def __init__(self, classes: dict, features: str = "features"):
        super().__init__()
        self._set(featuresCol=features)
        self.classes = classes

    def tables(self) -> dict[str, DataFrame]:
        rows = [
            (label, [float(v) for v in mean], [float(v) for v in inverse.ravel()], float(logdet), float(prior))
            for label, (mean, inverse, logdet, prior) in self.classes.items()
        ]
        kind = "label int, mean array<double>, inverse array<double>, logdet double, prior double"
        return {"classes": SparkSession.active().createDataFrame(rows, kind)}

    @classmethod
    def restored(cls, plain: dict, tables: dict[str, DataFrame], parts: dict) -> "QuadraticDiscriminantModel":
        return cls({
            r["label"]: (np.array(r["mean"]), np.array(r["inverse"]).reshape(len(r["mean"]), -1), r["logdet"], r["prior"])
            for r in tables["classes"].collect()
        })

    def _transform(self, dataset: DataFrame) -> DataFrame:
        classes = self.classes
        width = max(classes) + 1

        @F.pandas_udf("array<double>")
        def posterior(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()).astype(float)
            logs = np.full((len(rows), width), -np.inf)
            for value, (mean, inverse, logdet, prior) in classes.items():
                away = rows - mean
                logs[:, value] = prior - 0.5 * logdet - 0.5 * np.einsum("ni,ij,nj->n", away, inverse, away)
            scaled = np.exp(logs - logs.max(axis=1, keepdims=True))
            return pd.Series(list(scaled / scaled.sum(axis=1, keepdims=True)))

        told = dataset.withColumn("_p", posterior(vector_to_array(self.getFeaturesCol())))
        return told.select(
            *dataset.columns, array_to_vector("_p").alias("probability"), most_likely(F.col("_p")).alias("prediction")
        )
