from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kinweave.operators.balance import fragment_replicate_join, hot_keys, key_results, place, plan

SCHEMA = "key string, target string, score double, _task string"


def skewed():
    rows = [("hot", f"t{i % 700}", i / 10, "x") for i in range(3000)] + [("pair", "same", 1.0, None)] * 2000
    rows += [(f"k{i % 400}", f"t{i}", None if i % 7 == 0 else float("nan") if i % 7 == 1 else 2.0, None) for i in range(2000)]
    return rows + [(None, "t", 1.0, None)] * 50 + [("void", None, None, None)] * 3


def test_results_equal_brute_force(spark):
    rows = skewed()
    table = spark.createDataFrame(rows, SCHEMA)
    got, by = key_results(table, F.col("key"), F.col("target"), F.col("score"), tasks=6)
    want = defaultdict(lambda: [0, set(), []])
    for k, t, s, _ in rows:
        if k is not None:
            want[k][0] += 1
            want[k][1] |= {t} - {None}
            want[k][2] += [s] if s is not None and s == s else []
    found = {r["key"]: r for r in got.collect()}
    assert found.keys() == want.keys()
    for k, (n, targets, scores) in want.items():
        assert (found[k]["rows"], found[k]["targets"], found[k]["scores"]) == (n, len(targets), len(scores))
        assert found[k]["mean_score"] == (pytest.approx(sum(scores) / len(scores)) if scores else None)
    assert max(by.task_load) <= 1.6 * sum(by.task_load) / len(by.task_load)
    assert {(r["key"], r["rows"]) for r in hot_keys(got, least_share=0.2).collect()} == {("hot", 3000), ("pair", 2000)}


def test_empty(spark):
    got, _ = key_results(spark.createDataFrame([], SCHEMA), F.col("key"), F.col("target"), F.col("score"), tasks=3)
    assert got.collect() == [] and hot_keys(got, least_share=0.1).collect() == []


def test_large_keys_are_split_and_their_side_replicated(spark):
    left = spark.createDataFrame([("hot", i) for i in range(6000)] + [(f"k{i % 50}", i) for i in range(3000)] + [(None, 1)], "key string, n long")
    right = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("k1", "c"), ("none", "d"), (None, "e")], "key string, v string")
    by = plan(left.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("load")), "key", "load", tasks=9)
    per_task = {r["_task"]: r["count"] for r in place(left.where("key IS NOT NULL"), "key", ["n"], by).groupBy("_task").count().collect()}
    assert max(per_task.values()) <= 1.5 * 1000 and by.heavy.where("key = 'hot'").first()["_shards"] == 6
    joined = fragment_replicate_join(left, right, "key", ["n"], by)
    assert joined.columns == ["key", "n", "v"] and joined.groupBy("v").count().orderBy("v").collect() == [("a", 6000), ("b", 6000), ("c", 60)]


def test_the_join_keeps_the_packing(spark):
    left = spark.createDataFrame([("hot", i) for i in range(6000)] + [(f"k{i % 50}", i) for i in range(3000)], "key string, n long")
    right = spark.createDataFrame([(k, k) for k in ["hot", *(f"k{i}" for i in range(50))]], "key string, v string")
    by = plan(left.groupBy("key").agg(F.count("*").alias("load")), "key", "load", tasks=9)
    joined = fragment_replicate_join(left.hint("merge"), right, "key", ["n"], by)
    plan_text = joined._jdf.queryExecution().executedPlan().toString()
    assert plan_text.count("shufflepartitionidpassthrough") == 2 and "hashpartitioning" not in plan_text
    loads = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(loads) == 9 and sum(loads) == 9000 and max(loads) <= 1.2 * max(by.task_load)
