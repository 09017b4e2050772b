"""Saving and loading of fitted Spark ML models."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame


def fit_pipeline(df: DataFrame, columns: list[str], classifier) -> PipelineModel:
    """Assembler and classifier as one model, so that a saved model names its input columns."""
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), classifier]).fit(df)


def save_model(model: Model, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
