"""Writing and reading of this library's own estimators and models, alone or inside a Spark ML pipeline.

A stage is written as Spark ML's metadata with its plain settings, one Parquet table for each table
that it holds (a model may hold its training rows), and its member models in folders of their own.
"""

from __future__ import annotations

import os

from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame


class Stored(MLWritable, MLReadable):
    """A stage that tells what it consists of. ``restored`` gets the same three things back."""

    def plain(self) -> dict:
        """Settings that JSON can hold."""
        return {}

    def tables(self) -> dict[str, DataFrame]:
        return {}

    def parts(self) -> dict[str, object]:
        """Members by name; their order is kept."""
        return {}

    @classmethod
    def restored(cls, plain: dict, tables: dict[str, DataFrame], parts: dict[str, object]):
        return cls(**plain)

    def write(self) -> "StoredWriter":
        return StoredWriter(self)

    @classmethod
    def read(cls) -> "StoredReader":
        return StoredReader(cls)


class StoredWriter(MLWriter):
    def __init__(self, stage: Stored):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        tables, parts = self.stage.tables(), self.stage.parts()
        told = {"plain": self.stage.plain(), "tables": list(tables), "parts": list(parts)}
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession, extraMetadata=told)
        for name, rows in tables.items():
            rows.write.parquet(os.path.join(path, "tables", name))
        for place, part in enumerate(parts.values()):
            part.write().save(os.path.join(path, "parts", str(place)))


class StoredReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        spark = self.sparkSession
        told = DefaultParamsReader.loadMetadata(path, spark, f"{self.kind.__module__}.{self.kind.__name__}")
        tables = {name: spark.read.parquet(os.path.join(path, "tables", name)) for name in told["tables"]}
        parts = {
            name: DefaultParamsReader.loadParamsInstance(os.path.join(path, "parts", str(place)), spark)
            for place, name in enumerate(told["parts"])
        }
        stage = self.kind.restored(told["plain"], tables, parts)
        stage._resetUid(told["uid"])
        DefaultParamsReader.getAndSetParams(stage, told)
        return stage
