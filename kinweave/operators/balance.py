"""Per-key work without a few tasks doing most of it: loads are estimated, keys are packed to tasks, large keys are split.

A key that needs more than one task's share is cut into proportionate shards; all other keys go to virtual bins by
hash. Shards and bins are packed to tasks, largest first. A matching side is replicated only to the shards of its key.
What reaches the driver is bounded by the number of tasks: at most one row per large key and one per virtual bin.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.session import materialize

BINS_PER_TASK = 16


@dataclass(frozen=True)
class Plan:
    """Where the rows of each key go. heavy: key, shards and the first of its places; places: the task of every place.

    Virtual bins are the places from 0, shards those after them.
    """

    tasks: int
    bins: int
    share: int
    heavy: DataFrame
    places: DataFrame
    task_load: list[int]


def plan(loads: DataFrame, key: str, load: str, *, tasks: int) -> Plan:
    """Pack keys to tasks by their loads (one row per key that isn't null).

    Heavy keys are those above half a task's share, at most 2 * tasks of them; the rest is known by bin only.
    """
    spark = loads.sparkSession
    total = loads.agg(F.coalesce(F.sum(load), F.lit(0))).first()[0]
    share = max(1, -(-total // tasks))
    bins = tasks * BINS_PER_TASK
    large = F.col(load) * 2 > share
    heavy = [(k, n) for k, n in loads.where(large).select(key, load).collect()]
    light = dict(loads.where(~large).groupBy(F.pmod(F.xxhash64(key), F.lit(bins)).alias("bin")).agg(F.sum(load).alias("n")).collect())
    sizes = [float(light.get(b, 0)) for b in range(bins)]
    rows = []
    for k, n in heavy:
        shards = -(-n // share)
        rows.append((k, shards, len(sizes)))
        sizes += [n / shards] * shards
    tasks_of, queue = [0] * len(sizes), [(0.0, t) for t in range(tasks)]
    for at in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        held, task = heapq.heappop(queue)
        tasks_of[at] = task
        heapq.heappush(queue, (held + sizes[at], task))
    schema = T.StructType([T.StructField(key, loads.schema[key].dataType), T.StructField("_shards", T.IntegerType()), T.StructField("_first", T.IntegerType())])
    places = spark.createDataFrame(list(enumerate(tasks_of)), "_at int, _task int")
    task_load = [round(n) for n, _ in sorted(queue, key=lambda x: x[1])]
    return Plan(tasks, bins, share, spark.createDataFrame(rows, schema), places, task_load)


def place(rows: DataFrame, key: str, spread: list[str], by: Plan) -> DataFrame:
    """rows with _task and _shard; the rows of a large key are spread over its shards by a hash of `spread`.

    The joined tables have at most 2 * tasks rows and one per bin and shard, whatever the data, so they are broadcast.
    """
    shard = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_shards")), F.lit(0)).cast("int")
    placed = rows.join(F.broadcast(by.heavy), key, "left").withColumn("_shard", shard)
    return _at_its_task(placed, key, by).drop("_shards", "_first")


def _at_its_task(rows: DataFrame, key: str, by: Plan) -> DataFrame:
    """rows(key, _first, _shard, ..) with _task."""
    at = F.when(F.col("_first").isNull(), F.pmod(F.xxhash64(key), F.lit(by.bins))).otherwise(F.col("_first") + F.col("_shard")).cast("int")
    return rows.withColumn("_at", at).join(F.broadcast(by.places), "_at").drop("_at")


def fragment_replicate_sides(left: DataFrame, right: DataFrame, key: str, spread: list[str], by: Plan) -> tuple[DataFrame, DataFrame]:
    """Both sides with _task and _shard, partitioned by the task that the plan gave each bin and shard: the left rows of a
    large key go to its shards, its right rows to each of these shards. What is joined on _task, key, _shard and more is
    joined where it is.
    """
    left_side = place(left, key, spread, by).repartitionById(by.tasks, F.col("_task"))
    shards = F.explode(F.sequence(F.lit(0), F.coalesce("_shards", F.lit(1)) - 1)).alias("_shard")
    copies = right.join(F.broadcast(by.heavy), key, "left").select(*right.columns, "_first", shards)
    return left_side, _at_its_task(copies, key, by).select(*right.columns, "_shard", "_task").repartitionById(by.tasks, F.col("_task"))


def fragment_replicate_join(left: DataFrame, right: DataFrame, key: str, spread: list[str], by: Plan) -> DataFrame:
    """Inner join on key: the left rows of a large key go to its shards, its right rows to each of these shards.

    Both sides are partitioned by the task that the plan gave each bin and shard, and joined where they are.
    """
    left_side, right_side = fragment_replicate_sides(left, right, key, spread, by)
    return left_side.join(right_side, ["_task", key, "_shard"]).drop("_task", "_shard")


def _stats_in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial results per key and shard. Every row is a pair of key and target, and a shard's targets are its own."""
    held = pd.DataFrame()
    for batch in batches:
        part = batch.groupby("key", sort=False).agg(rows=("rows", "sum"), targets=("target", "count"), score_sum=("score_sum", "sum"), scores=("scores", "sum"))
        held = part if held.empty else pd.concat([held, part]).groupby(level=0, sort=False).sum()
    if len(held):
        yield held.reset_index()


def key_results(rows: DataFrame, key: F.Column, target: F.Column, score: F.Column | None, *, tasks: int) -> tuple[DataFrame, Plan]:
    """Per key: rows, distinct targets, number, sum and mean of scores (null and NaN don't count); and the plan that balanced it.

    Rows with a null key are left out; null targets aren't counted as targets; a key whose scores are all missing has
    a null mean; no rows give no keys. Columns of the input may have any names, only the three expressions are used.
    Equal pairs of key and target are counted before any row moves; then whole pairs are packed to tasks.
    """
    score = F.lit(None).cast("double") if score is None else score.cast("double")
    value = F.when(score.isNull() | F.isnan(score), None).otherwise(score)
    pairs = rows.select(key.alias("key"), target.alias("target"), value.alias("score")).where("key IS NOT NULL").groupBy("key", "target").agg(F.count("*").alias("rows"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("score_sum"), F.count("score").alias("scores"))
    pairs = materialize(pairs)
    by = plan(pairs.groupBy("key").agg(F.count("*").alias("load")), "key", "load", tasks=tasks)
    parts = place(pairs, "key", ["target"], by).repartitionById(tasks, F.col("_task")).drop("_task", "_shard").mapInPandas(_stats_in_task, pairs.select("key").schema.simpleString()[7:-1] + ", rows long, targets long, score_sum double, scores long")
    merged = parts.groupBy("key").agg(F.sum("rows").alias("rows"), F.sum("targets").alias("targets"), F.sum("score_sum").alias("s"), F.sum("scores").alias("c"))
    return merged.select("key", "rows", "targets", F.col("c").alias("scores"), F.col("s").alias("score_sum"), F.when(F.col("c") > 0, F.col("s") / F.col("c")).alias("mean_score")), by


def hot_keys(results: DataFrame, *, least_share: float) -> DataFrame:
    """Keys with at least the given share of all rows that have a key; at most 1 / least_share of them."""
    results = materialize(results)
    total = results.agg(F.sum("rows")).first()[0] or 0
    return results.where(F.col("rows") >= F.lit(least_share) * F.lit(total)).select("key", "rows")
