"""kinweave run | preview | validate CONFIG, and export INPUT FORMAT [OUTPUT]."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from kinweave import api
from kinweave.config import load_config, load_env, load_frames
from kinweave.session import tuned


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kinweave")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("run", "preview", "validate"):
        commands.add_parser(name).add_argument("--config", required=True)
    export = commands.add_parser("export")
    export.add_argument("--input", required=True)
    export.add_argument("--format", required=True, choices=("csv", "parquet", "jsonl"))
    export.add_argument("--output")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if all went well, 2 if the inputs aren't valid."""
    args = parser().parse_args(argv)
    spark = spark or tuned(SparkSession.builder.appName("kinweave")).getOrCreate()
    if args.command == "export":
        print(api.export_crosswalk(spark, args.input, args.format, args.output))
        return 0
    load_env(Path(args.config).parent)
    config = load_config(args.config)
    df_from, df_to, _ = load_frames(spark, config)
    checked = api.validate_inputs(df_from, df_to, **config.options())
    if args.command == "validate" or not checked["valid"]:
        print(json.dumps(checked, indent=2, default=str))
        return 0 if checked["valid"] else 2
    print(json.dumps(api.preview_plan(df_from, df_to, **config.options()) if args.command == "preview" else api.load_and_run(spark, args.config), indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
