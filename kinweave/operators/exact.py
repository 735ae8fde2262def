"""Exact names within a scope, and what is left after them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.prepare import scope_columns
from kinweave.plans.spec import Spec


def same_scope(left: DataFrame, right: DataFrame, spec: Spec) -> Column:
    """Equality of all scope columns; null equals null."""
    return reduce(Column.__and__, [left[c].eqNullSafe(right[c]) for c in scope_columns(spec)], F.lit(True))


def exact_matches(frame_from: DataFrame, frame_to: DataFrame, spec: Spec) -> DataFrame:
    """Columns from_key, to_key: rows of equal scope and canonical name; of several to-rows the last one."""
    by = [*scope_columns(spec), "canonical"]
    last = frame_to.groupBy(*by).agg(F.max_by("key", "ord").alias("to_key"))
    condition = same_scope(frame_from, last, spec) & (frame_from["canonical"] == last["canonical"])
    return frame_from.join(last, condition).select(frame_from["key"].alias("from_key"), "to_key")


def prune(frame_from: DataFrame, frame_to: DataFrame, exact: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """The frames that go on to the shortlist: matched rows leave the from side, and the to side if so asked."""
    if spec.string_exact_match_prune == "none":
        return frame_from, frame_to
    rest_from = frame_from.join(exact.select(F.col("from_key").alias("key")), "key", "left_anti")
    if spec.string_exact_match_prune == "from":
        return rest_from, frame_to
    return rest_from, frame_to.join(exact.select(F.col("to_key").alias("key")), "key", "left_anti")
