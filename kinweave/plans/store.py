"""Decision logs and whole results, kept between runs as tables on any file system that Spark can write."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.adjudicate import LINK
from kinweave.operators.crosswalk import latest_per_key
from kinweave.sources.files import below, exists, read_document, write_document


class DecisionLog:
    """Records of one run, keyed by the run's content hash, so that other runs' records never have to be moved away."""

    def __init__(self, spark: SparkSession, folder: str | Path, run_id: str, name: str, schema: str) -> None:
        self.spark, self.folder, self.schema = spark, below(folder, name), schema
        self.path = below(self.folder, f"run_id={run_id}")

    def read(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def append(self, rows: DataFrame) -> DataFrame:
        """Write rows, then give the log as it is: what was decided is never decided again by a later action."""
        rows.write.mode("append").parquet(self.path)
        if not exists(self.spark, below(self.path, "_SUCCESS")) and not exists(self.spark, self.path):
            raise OSError(f"the log just written to {self.path} can't be read")
        return self.read()

    def restore(self, rows: DataFrame) -> None:
        """The log holds these rows and no others."""
        rows.write.mode("overwrite").parquet(self.path)

    def done(self, key: str, order: list[str]) -> DataFrame:
        """Keys whose last record is ok."""
        last = latest_per_key(self.read(), [key], order, ["status"])
        return last.where("status = 'ok'").select(key)

    def runs(self) -> DataFrame:
        """The run ids that have records here."""
        if not exists(self.spark, self.folder):
            return self.spark.createDataFrame([], "run_id string")
        whole = self.spark.read.option("basePath", self.folder).parquet(below(self.folder, "run_id=*"))
        return whole.select(F.col("run_id").cast("string")).distinct()


class ReplayStore:
    """Whole results by replay key: crosswalk, review queue, logs and manifest."""

    def __init__(self, spark: SparkSession, folder: str | Path) -> None:
        self.spark, self.folder = spark, str(folder)

    def load(self, key: str) -> tuple[dict[str, DataFrame], dict[str, Any]] | None:
        """The tables of the bundle by name; None where there is nothing; ValueError where a part is missing or can't be read."""
        manifest = below(self.folder, key, "replay_manifest.json")
        if not exists(self.spark, manifest):
            return None
        try:
            document = read_document(self.spark, manifest)
        except ValueError as error:
            raise ValueError(f"replay manifest can't be read: {error}") from error
        tables = {}
        for name in document["tables"]:
            path = below(self.folder, key, f"{name}.parquet")
            if not exists(self.spark, path):
                raise ValueError(f"replay bundle lacks its {name}")
            tables[name] = self.spark.read.parquet(path)
        return tables, document

    def publish(self, key: str, tables: dict[str, DataFrame], manifest: dict[str, Any]) -> None:
        """The manifest comes last, so that a bundle with a manifest is whole."""
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(below(self.folder, key, f"{name}.parquet"))
        write_document(self.spark, below(self.folder, key, "replay_manifest.json"), manifest | {"tables": sorted(tables)})


class AnswerCache:
    """Answers of adjudicators by the content of what was asked; appended, the latest counts."""

    def __init__(self, spark: SparkSession, folder: str | Path) -> None:
        self.spark, self.path = spark, below(folder, "answers.parquet")

    def read(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], f"key string, links array<{LINK}>, logged_at string")
        return self.spark.read.parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)
