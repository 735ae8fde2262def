"""Results per key without imbalance, over the crosswalk and the later units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.balance import fragment_replicate_join, hot_keys, key_results, plan

HOT_SHARE = 0.03


def _tasks(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def state_key() -> F.Column:
    return F.regexp_replace(F.lower("state"), r"[^\p{L}\p{N}]", "")


def _by_from_key(spark: SparkSession, folder: str) -> DataFrame:
    return key_results(spark.read.parquet(f"{folder}/crosswalk.parquet"), F.col("from_key"), F.col("to_key"), F.col("score"), tasks=_tasks(spark))[0]


def _by_state(spark: SparkSession, folder: str) -> DataFrame:
    return key_results(spark.read.parquet(f"{folder}/to_units.parquet"), state_key(), F.col("district"), None, tasks=_tasks(spark))[0]


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    both = [hot_keys(results, least_share=HOT_SHARE).select(F.lit(field).alias("field"), F.col("key").alias("hot_key")) for field, results in (("from_key", _by_from_key(spark, folder)), ("state", _by_state(spark, folder)))]
    return both[0].unionByName(both[1])


def p6_from_keys(spark: SparkSession, folder: str) -> DataFrame:
    return _by_from_key(spark, folder).select(F.col("key").alias("from_key"), "rows", "targets", F.when(F.col("scores") > 0, F.round("score_sum", 6) / F.col("scores")).alias("mean_score"))


def p6_states(spark: SparkSession, folder: str) -> DataFrame:
    return _by_state(spark, folder).select(F.col("key").alias("state_key"), "rows", F.col("targets").alias("districts"))


def p6_earlier_state(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the crosswalk by the state of their earlier unit: the units are replicated to the shards of their key."""
    rows = spark.read.parquet(f"{folder}/crosswalk.parquet").select("ord", "from_key").where("from_key IS NOT NULL")
    units = spark.read.parquet(f"{folder}/from_units.parquet").select(F.concat(F.lit("from_"), F.col("ord").cast("string")).alias("from_key"), F.col("state").alias("unit_state"))
    by = plan(rows.groupBy("from_key").agg(F.count("*").alias("load")), "from_key", "load", tasks=_tasks(spark))
    joined = fragment_replicate_join(rows, units, "from_key", ["ord"], by)
    return joined.groupBy("unit_state").agg(F.count("*").alias("rows"), F.countDistinct("from_key").alias("from_keys"))


QUERIES = {f.__name__: f for f in (p6_found, p6_from_keys, p6_states, p6_earlier_state)}

_STATE = "lower(regexp_replace(lower(state), '[^\\p{L}\\p{N}]', '', 'g'))"

ORACLE = {
    "p6_found": f"""
        SELECT 'from_key' AS field, from_key AS hot_key FROM crosswalk WHERE from_key IS NOT NULL GROUP BY from_key
        HAVING count(*) >= 0.03 * (SELECT count(from_key) FROM crosswalk)
        UNION ALL
        SELECT 'state' AS field, {_STATE} AS hot_key FROM to_units WHERE state IS NOT NULL GROUP BY {_STATE}
        HAVING count(*) >= 0.03 * (SELECT count(state) FROM to_units)""",
    "p6_from_keys": """
        SELECT from_key, count(*) AS rows, count(DISTINCT to_key) AS targets, CASE WHEN count(score) FILTER (NOT isnan(score)) > 0 THEN round(sum(score) FILTER (NOT isnan(score)), 6) / count(score) FILTER (NOT isnan(score)) END AS mean_score
        FROM crosswalk WHERE from_key IS NOT NULL GROUP BY from_key""",
    "p6_states": f"SELECT {_STATE} AS state_key, count(*) AS rows, count(DISTINCT district) AS districts FROM to_units WHERE state IS NOT NULL GROUP BY {_STATE}",
    "p6_earlier_state": """
        SELECT u.state AS unit_state, count(*) AS rows, count(DISTINCT c.from_key) AS from_keys
        FROM crosswalk c JOIN from_units u ON c.from_key = 'from_' || u.ord GROUP BY u.state""",
}
