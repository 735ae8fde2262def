"""Sessions, and tables that cut lineage in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that are still there, the latest last.
_TABLES: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the one given to the context.

    Only a local master gets a folder of its own where none is named; elsewhere executors would each write to a disk
    that the others can't read, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not given.isDefined() and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = given.get() if given.isDefined() else tempfile.mkdtemp(prefix="kinweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back.

    It does what checkpoint() does for lineage and for lost executors, but stays columnar and compressed, is pruned by
    column and partition on later reads, and has exact sizes for the planner. The table is dropped when the driver
    ends, or at the end of the innermost temporary_tables().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kinweave-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    if not _TABLES:
        atexit.register(_drop_from, spark, 0)
    _TABLES.append(path)
    table = spark.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])
    table.kept_at = path
    return table


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Drop at the end what materialize() wrote within, but for the tables that were appended to the list it gives."""
    before, kept = len(_TABLES), []
    try:
        yield kept
    finally:
        paths = [p for p in _TABLES[before:] if p in {table.kept_at for table in kept}]
        _TABLES[before:] = [p for p in _TABLES[before:] if p not in paths]
        _drop_from(spark, before)
        _TABLES.extend(paths)


def _drop_from(spark: SparkSession, first: int) -> None:
    while len(_TABLES) > first:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(_TABLES.pop())
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone already; the shared folder is cleaned with the application
            pass


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings this library counts on: runtime re-planning with skew handling, UTC, Arrow batches of bounded size."""
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    )
