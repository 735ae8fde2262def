"""Tables in and out: CSV, Parquet, JSON lines, a loader of one's own, and documents of metadata."""

from __future__ import annotations

import importlib
import json
import sys
from contextlib import contextmanager
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("csv", "parquet", "jsonl")


def resolve(path: str | Path, base: str | Path | None = None) -> str:
    """Absolute paths and URLs as they are, others from the configuration's folder or the current one."""
    text = str(path)
    return text if "://" in text or Path(text).is_absolute() else str((Path(base) if base else Path.cwd()) / text)


def _at(spark: SparkSession, path: str | Path):
    """The Hadoop file system of a path, and the path in it; any of its schemes will do."""
    target = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def below(folder: str | Path, *parts: str) -> str:
    return "/".join((str(folder).rstrip("/"), *parts))


def exists(spark: SparkSession, path: str | Path) -> bool:
    fs, target = _at(spark, path)
    return fs.exists(target)


def remove(spark: SparkSession, path: str | Path) -> None:
    fs, target = _at(spark, path)
    fs.delete(target, True)


def write_text(spark: SparkSession, path: str | Path, text: str) -> None:
    fs, target = _at(spark, path)
    stream = fs.create(target, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str | Path) -> str:
    fs, target = _at(spark, path)
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted value of a CSV file goes on in the next line: then some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_table(spark: SparkSession, path: str | Path, base: str | Path | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A .csv (with header, types inferred unless a schema is given), .parquet or .pq file or folder.

    A CSV file is split between tasks unless one of its values spans lines, which is looked up first.
    """
    where, suffix = resolve(path, base), Path(str(path)).suffix.lower()
    if suffix == ".csv":
        reader = spark.read.option("header", True).option("multiLine", spans_lines(spark, where)).option("escape", '"')
        return reader.schema(schema).csv(where) if schema else reader.option("inferSchema", True).csv(where)
    if suffix in (".parquet", ".pq"):
        return spark.read.parquet(where)
    raise ValueError(f"Unsupported file format: {suffix!r}")


def read_jsonl(spark: SparkSession, path: str | Path, schema: T.StructType | str) -> DataFrame:
    """JSON lines; a missing file has no rows, blank lines are skipped."""
    return spark.read.schema(schema).json(str(path)) if exists(spark, path) else spark.createDataFrame([], schema)


@contextmanager
def _importable(folder: str | None):
    if folder:
        sys.path.insert(0, folder)
    try:
        yield
    finally:
        if folder and folder in sys.path:
            sys.path.remove(folder)


def _named(hook: str, base: str | Path | None):
    module, _, name = hook.partition(":")
    if not module or not name:
        raise ValueError("a loader is named module:function")
    with _importable(str(base) if base else None):
        return getattr(importlib.import_module(module), name)


def load_by_hook(spark: SparkSession, hook: str, params: dict[str, Any], base: str | Path | None = None) -> tuple[DataFrame, DataFrame]:
    """module:function called with (spark, params), giving the earlier and the later table."""
    result = _named(hook, base)(spark, params)
    if not isinstance(result, tuple) or len(result) != 2:
        raise ValueError("a loader returns the pair (df_from, df_to)")
    return result


def load_adjudicator(hook: str, params: dict[str, Any], base: str | Path | None = None) -> Any:
    """module:function called with (params), giving an adjudicator."""
    return _named(hook, base)(params)


def flat(df: DataFrame) -> DataFrame:
    """df with maps, arrays and structs as JSON text, as CSV needs it."""
    return df.select(*[F.to_json(c).alias(c) if isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType)) else F.col(f"`{c}`") for c, f in ((f.name, f) for f in df.schema.fields)])


def write_table(df: DataFrame, path: str | Path, fmt: str, *, mode: str = "overwrite", single: bool = False) -> None:
    """A folder of csv (with header), parquet or jsonl files."""
    if fmt not in FORMATS:
        raise ValueError(f"output_format must be one of: {', '.join(FORMATS)}")
    df = df.coalesce(1) if single else df
    if fmt == "csv":
        flat(df).write.mode(mode).option("header", True).option("escape", '"').csv(str(path))
    elif fmt == "parquet":
        df.write.mode(mode).parquet(str(path))
    else:
        df.write.mode(mode).json(str(path))


def export_crosswalk(spark: SparkSession, input_path: str | Path, output_format: str, output_path: str | Path | None = None) -> str:
    """Convert a crosswalk; the default name is <stem>_export.<format> beside it."""
    source = Path(str(input_path))
    if source.suffix.lower() not in (".csv", ".parquet", ".pq"):
        raise ValueError("Unsupported input format; expected csv or parquet")
    fmt = output_format.lower()
    if fmt not in FORMATS:
        raise ValueError(f"output_format must be one of: {', '.join(FORMATS)}")
    target = str(output_path or f"{str(input_path)[: -len(source.suffix)]}_export.{fmt}")
    write_table(read_table(spark, input_path), target, fmt)
    return target


def write_document(spark: SparkSession, path: str | Path, payload: dict[str, Any]) -> None:
    """JSON with sorted keys, ASCII only, indented."""
    write_text(spark, path, json.dumps(payload, sort_keys=True, indent=2, ensure_ascii=True, default=str))


def read_document(spark: SparkSession, path: str | Path) -> dict[str, Any] | None:
    return json.loads(read_text(spark, path)) if exists(spark, path) else None
