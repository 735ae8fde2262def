"""Hashes that identify tables, requests and runs; slugs for folders."""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.plans.spec import OUTPUT_VERSION, Spec


def stable_hash(payload: Any) -> str:
    return hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=True, default=str).encode("utf-8")).hexdigest()


def run_id(request: dict[str, Any], seed: int) -> str:
    return stable_hash({"request": request, "seed": seed})[:16]


def slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.lower().strip()).strip("-") or "run"


def run_folder(spec: Spec) -> str:
    return "_".join(slug(str(x)) for x in (spec.country, spec.year_from, spec.year_to, spec.map_col_from))


def row_hashes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Column h: SHA-256 of each row's values as JSON; a column that is missing counts as null."""
    values = [(F.col(c) if c in df.columns else F.lit(None).cast("string")).cast("string").alias(c) for c in columns]
    return df.select(F.sha2(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}), 256).alias("h"))


def fingerprint(df: DataFrame, columns: list[str]) -> str:
    """A hash of the rows whatever their order: sums of the hashes' four words, computed where the rows are.

    Sums of 64-bit words over a multiset don't need the rows sorted or gathered; the driver gets five numbers.
    """
    words = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"w{i}") for i in range(4)]
    totals = row_hashes(df, columns).agg(F.count("*").alias("n"), *words).first()
    return stable_hash({"columns": columns, "rows": totals["n"], "words": [str(totals[f"w{i}"]) for i in range(4)]})


def side_columns(spec: Spec, side: str) -> list[str]:
    return list(dict.fromkeys(c for c in (spec.name(side), *spec.exact_match, spec.id_column(side), *spec.extra_context_cols) if c))


def replay_identity(spec: Spec, df_from: DataFrame, df_to: DataFrame, backend: str) -> dict[str, Any]:
    columns = {side: side_columns(spec, side) for side in ("from", "to")}
    identity = {
        "request": spec.request(), "llm_backend": backend, "output_schema_version": OUTPUT_VERSION, "extra_context_cols": list(spec.extra_context_cols), "from_columns": columns["from"], "to_columns": columns["to"],
        "from_fingerprint": fingerprint(df_from, columns["from"]), "to_fingerprint": fingerprint(df_to, columns["to"]),
    }
    return identity | {"replay_key": stable_hash(identity)[:24]}
