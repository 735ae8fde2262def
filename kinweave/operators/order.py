"""Positions of rows in an order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.session import materialize


def with_position(df: DataFrame, order_by: list, name: str) -> DataFrame:
    """df with a column `name`: 0 for the first row in the order, and so on without gaps.

    Rows are range-partitioned and sorted, then the sizes of the partitions before each are added. The table of sizes
    has a row per partition. Rows equal in the order get positions in any order; no rows give none.
    """
    placed = materialize(df.repartitionByRange(*order_by).sortWithinPartitions(*order_by).withColumn("_mono", F.monotonically_increasing_id()))
    part, row = F.shiftright("_mono", 33), F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    known = df.sparkSession.createDataFrame(starts, "_p long, _start long")
    return placed.withColumn("_p", part).join(F.broadcast(known), "_p").withColumn(name, F.col("_start") + row).drop("_p", "_start", "_mono")
