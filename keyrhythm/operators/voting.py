"""Combining the answers of several models, row by row and without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.sql import Column, DataFrame, functions as F

from keyrhythm.operators.stored import Stored


def majority(votes: Column) -> Column:
    """Most frequent value of an array column; the smallest value wins a tie."""
    tally = F.transform(
        F.array_distinct(votes),
        lambda c: F.struct(F.size(F.filter(votes, lambda v: v == c)).alias("n"), (-c).alias("minus")),
    )
    return -F.array_max(tally)["minus"]


def mean_probabilities(members: Sequence[Column]) -> Column:
    """Element-wise mean of probability arrays."""
    total = members[0]
    for other in members[1:]:
        total = F.zip_with(total, other, lambda a, b: a + b)
    return F.transform(total, lambda p: p / len(members))


def most_likely(probabilities: Column) -> Column:
    """Index of the largest entry; the smallest index wins a tie."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("double")


class Voting(Estimator, HasFeaturesCol, HasLabelCol, Stored):
    """Fits every member and lets them vote: ``hard`` by label, ``soft`` by mean probability."""

    def __init__(self, members: dict[str, Estimator], how: str = "hard"):
        super().__init__()
        if how not in ("hard", "soft"):
            raise ValueError(f"votes are hard or soft, not {how}")
        self.members, self.how = members, how

    def plain(self) -> dict:
        return {"how": self.how}

    def parts(self) -> dict[str, Estimator]:
        return self.members

    @classmethod
    def restored(cls, plain: dict, tables: dict, parts: dict) -> "Voting":
        return cls(parts, **plain)

    def _fit(self, dataset: DataFrame) -> "VotingModel":
        return VotingModel({name: member.fit(dataset) for name, member in self.members.items()}, self.how)


class VotingModel(Model, Stored):
    def __init__(self, members: dict[str, Model], how: str):
        super().__init__()
        self.members, self.how = members, how

    def plain(self) -> dict:
        return {"how": self.how}

    def parts(self) -> dict[str, Model]:
        return self.members

    @classmethod
    def restored(cls, plain: dict, tables: dict, parts: dict) -> "VotingModel":
        return cls(parts, **plain)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        columns = list(dataset.columns)
        out, answers = dataset, []
        for i, model in enumerate(self.members.values()):
            wanted = "prediction" if self.how == "hard" else "probability"
            told = model.transform(out)
            answer = F.col(wanted) if self.how == "hard" else vector_to_array(F.col(wanted))
            # Members may be votes themselves.
            answers.append(f"_{self.uid}_{i}")
            out = told.select(*columns, *answers[:-1], answer.alias(answers[-1]))
        if self.how == "hard":
            return out.select(*columns, majority(F.array(*answers)).alias("prediction"))
        mean = f"_{self.uid}_mean"
        return out.withColumn(mean, mean_probabilities([F.col(a) for a in answers])).select(
            *columns, array_to_vector(mean).alias("probability"), most_likely(F.col(mean)).alias("prediction")
        )
