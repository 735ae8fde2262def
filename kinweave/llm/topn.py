"""The N best items of every group, by bands of descending score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.session import materialize

#: Shares of all rows above the lower end of each band but the last, which takes the rest.
BAND_SHARES = (1 / 32, 1 / 8, 1 / 2)


def banded_pairs(items: DataFrame, group: str, item: str, score: str, shares: tuple[float, ...]) -> tuple[DataFrame, int]:
    """Columns g, i, s, band: each item of a group with its highest score, partitioned by band on disk; and the number of bands.

    The lower ends of bands are percentiles of the rows' scores, read from the score column alone.
    """
    value = F.col(score).cast("double")
    scored = items.where(value.isNotNull() & ~F.isnan(value))
    cuts = sorted({c for c in scored.agg(F.percentile_approx(value, [1 - x for x in shares], 2000)).first()[0] or []}, reverse=True) if shares else []
    rows = scored.select(F.col(group).alias("g"), F.col(item).alias("i"), value.alias("s")).where("g IS NOT NULL AND i IS NOT NULL")
    band = reduce(lambda rest, c: F.when(F.col("s") >= F.lit(c[1]), F.lit(c[0])).otherwise(rest), reversed(list(enumerate(cuts))), F.lit(len(cuts)))
    return materialize(rows.groupBy("g", "i").agg(F.max("s").alias("s")).withColumn("band", band), partition_by=["band"]), len(cuts) + 1


def top_n(items: DataFrame, group: str, item: str, score: str, n: int, *, shares: tuple[float, ...] = BAND_SHARES) -> DataFrame:
    """Columns group, item, score, place: up to n items of each group, higher score first, then the smaller item.

    An item's score is the highest of its rows; null and NaN scores, null groups and null items don't count, so a group
    without any other row has no result. Repeated rows count once, ties are broken by the item, no rows give no rows,
    further columns are ignored. Bands are read from the top, each as its own partition of a table. Groups that have n
    items leave by anti-join; a group whose items of a band all fit is taken as it is; only where a band has more than
    fit is it ranked, with n rows of a group kept before rows move, so that a group with a third of all rows, all of
    one score, is no more to any task than others. `place` costs a ranking of the result only if it is asked for.
    """
    pairs, bands = banded_pairs(items, group, item, score, shares)
    best_first = Window.partitionBy("g").orderBy(F.desc("s"), F.asc("i"))
    found: list[DataFrame] = []
    have: DataFrame | None = None  # g, had: groups seen so far
    for b in range(bands):
        rows = pairs.where(F.col("band") == b).select("g", "i", "s")
        if have is None:
            counts = rows.groupBy("g").agg(F.count("*").alias("here")).withColumn("had", F.lit(0).cast("long"))
        else:
            rows = rows.join(have.where(F.col("had") >= n), "g", "left_anti")
            counts = rows.groupBy("g").agg(F.count("*").alias("here")).join(have, "g", "left").withColumn("had", F.coalesce("had", F.lit(0)))
        counts = materialize(counts)
        boundary = counts.where(F.col("had") + F.col("here") > n).select("g", (F.lit(n) - F.col("had")).alias("room"))
        found.append(rows.join(boundary, "g", "left_anti"))
        first = rows.join(boundary.select("g"), "g", "left_semi").withColumn("r", F.row_number().over(best_first)).where(F.col("r") <= n)
        found.append(materialize(first.join(boundary, "g").where(F.col("r") <= F.col("room")).select("g", "i", "s")))
        if b + 1 < bands:
            now = counts.select("g", F.least(F.col("had") + F.col("here"), F.lit(n)).alias("had"))
            have = materialize(now if have is None else now.unionByName(have.join(now.select("g"), "g", "left_anti")))
    chosen = reduce(DataFrame.unionByName, found).withColumn("place", F.row_number().over(best_first))
    return chosen.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "place")
