"""Input tables as work frames: copies collapsed, keys and canonical names given.

A work frame has ord, key, id, name, canonical, s0.. (normalized scope), x0.. (scope as given), c0.. (context): its
names are ours, so that columns of the input can have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.names import canonical, match_value
from kinweave.operators.order import with_position
from kinweave.plans.spec import Spec


def keyed(df: DataFrame, side: str, spec: Spec) -> DataFrame:
    """The narrow frame of one side before collapsing: order columns o0.., match key k (null names stay null)."""
    order = [F.col(c) for c in spec.order(side)] or [F.monotonically_increasing_id()]
    given = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    id_column, name = spec.id_column(side), spec.name(side)
    scope = lambda c: match_value(df, c, compose=spec.compose) if c in df.columns else F.lit(None).cast("string")
    columns = [o.alias(f"o{i}") for i, o in enumerate(order)]
    columns += [F.col(name).cast("string").alias("name"), canonical(F.col(name).cast("string"), compose=spec.compose).alias("canonical"), match_value(df, name, compose=spec.compose).alias("k")]
    columns += [(F.col(id_column).cast("string") if id_column else F.lit(None).cast("string")).alias("id")]
    columns += [scope(c).alias(f"s{i}") for i, c in enumerate(spec.exact_match)] + [given(c).alias(f"x{i}") for i, c in enumerate(spec.exact_match)]
    columns += [given(c).alias(f"c{i}") for i, c in enumerate(spec.extra_context_cols)]
    return df.select(*columns)


def collapse(rows: DataFrame, scopes: int) -> DataFrame:
    """The first row in order of each normalized (scope, name); null matches null.

    Every partition hands on one row per key, so that a key with a third of all rows is no burden.
    """
    by = [f"s{i}" for i in range(scopes)] + ["k"]
    order = sorted((c for c in rows.columns if c[0] == "o" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    rest = [c for c in rows.columns if c not in (*by, *order)]
    return rows.groupBy(*by).agg(F.min(F.struct(*order, *rest)).alias("first")).select(*by, "first.*")


def work_frame(df: DataFrame, side: str, spec: Spec) -> DataFrame:
    rows = collapse(keyed(df, side, spec), len(spec.exact_match))
    order = [c for c in rows.columns if c[0] == "o" and c[1:].isdigit()]
    placed = with_position(rows, sorted(order, key=lambda c: int(c[1:])), "ord").withColumn("key", F.concat(F.lit(f"{side}_"), F.col("ord").cast("string")))
    rest = [c for c in rows.columns if c[0] in "sxc" and c[1:].isdigit()]
    return placed.select("ord", "key", (F.col("id") if spec.id_column(side) else F.col("key")).alias("id"), "name", "canonical", *rest)


def scope_columns(spec: Spec) -> list[str]:
    return [f"s{i}" for i in range(len(spec.exact_match))]
