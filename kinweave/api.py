"""Entry points."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from kinweave.operators.crosswalk import base_columns
from kinweave.plans import pipeline
from kinweave.plans.spec import LINK_TYPES, MERGES, OUTPUT_VERSION, RELATIONSHIPS
from kinweave.plans.validate import validate
from kinweave.sources.files import export_crosswalk

__all__ = ["build_evolution_key", "export_crosswalk", "output_schema", "preview_plan", "validate_inputs"]

_RUN = ("adjudicator", "hints", "output_dir", "review_score_threshold", "write_csv", "write_parquet", "replay_dir", "cache_dir", "retry", "callers", "loader_metadata")


def build_evolution_key(df_from: DataFrame, df_to: DataFrame, **options: Any) -> tuple[DataFrame, dict[str, Any]]:
    """The crosswalk of two tables and the run's metadata. Options are those of Spec and of pipeline.run."""
    own = {k: options.pop(k) for k in _RUN if k in options}
    result = pipeline.run(df_from, df_to, options, **own)
    return result.crosswalk, result.metadata


def preview_plan(df_from: DataFrame, df_to: DataFrame, **options: Any) -> dict[str, Any]:
    return pipeline.preview(df_from, df_to, options)


def validate_inputs(df_from: DataFrame, df_to: DataFrame, **options: Any) -> dict[str, Any]:
    return validate(df_from, df_to, options)


def output_schema(*, evidence: bool = False) -> dict[str, Any]:
    """The crosswalk's columns in order, its enumerations and its version."""
    columns = base_columns(evidence)
    optional = ("to_name", "to_canonical_name", "to_id", "to_key")
    return {
        "schema_version": OUTPUT_VERSION, "crosswalk_columns": columns, "link_type_enum": list(LINK_TYPES), "relationship_enum": list(RELATIONSHIPS), "merge_enum": list(MERGES), "required_output_columns": [c for c in columns if c not in optional],
        "conditional_columns": {"evidence": "there if the request asks for evidence", "reason": "always there, with a text if the request asks for reasons"},
        "notes": {"exact_match_columns": "appended after the base columns", "constraints_passed": "a map of names to booleans, JSON text in CSV", "merge": "both, only_in_from, or only_in_to for later units without a match", "lineage_hint": "the name that the second stage searched for"},
    }


def load_and_run(spark, path: str | Path) -> dict[str, Any]:
    """Run a configuration file and give its metadata."""
    from kinweave.config import load_config, load_frames

    config = load_config(path)
    df_from, df_to, loaded = load_frames(spark, config)
    return pipeline.run(df_from, df_to, config.options(), loader_metadata=loaded, **config.run_options()).metadata
