"""Groups of keys that are linked directly or through others, from pairs.

Union-find runs inside each partition of the pairs and keeps a spanning forest (every node with the root of its local
tree). A forest larger than one bounded partition is contracted: each node follows its best root and only links
between roots remain, again reduced by union-find per partition, until what is left fits one partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.session import materialize

#: Pairs that one task holds at once; also the largest forest that is finished in one partition.
FOREST_BOUND = 1_000_000

LINKING_TYPES = ("rename", "split", "merge", "transfer")


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Union by smaller rank with path halving, over whole arrays: the root of each of n nodes."""
    parent = np.arange(n)
    while len(a):
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(parent, up := parent[parent]):
            parent = up
    return parent


def _forest(a: pd.Series, b: pd.Series, level: int) -> pd.DataFrame:
    """Every node of the pairs with its root; roots are chosen by a hash that differs for each level."""
    codes, names = pd.factorize(pd.concat([a, b], ignore_index=True))
    names = np.asarray(names, dtype=object)
    rank = np.empty(len(names), dtype=np.int64)
    order = np.lexsort((np.arange(len(names)), pd.util.hash_array(names, hash_key=f"{level:016d}")))
    rank[order] = np.arange(len(names))
    codes = rank[codes]
    roots = _roots(codes[: len(a)], codes[len(a) :], len(names))
    by_rank = names[order]
    return pd.DataFrame({"node": by_rank, "root": by_rank[roots]})


def _local_forests(level: int, bound: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for batch in batches:
            held.append(batch.set_axis(["node", "root"], axis=1))
            rows += len(batch)
            if rows >= bound:
                both = pd.concat(held, ignore_index=True)
                forest = _forest(both["node"], both["root"], level)
                if len(forest) > bound // 2:  # hardly anything merged: hand it on and start anew
                    yield forest
                    held, rows = [], 0
                else:
                    held, rows = [forest], len(forest)
        if held:
            both = pd.concat(held, ignore_index=True)
            yield _forest(both["node"], both["root"], level)

    return run


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = list(batches)
    if held:
        both = pd.concat(held, ignore_index=True)
        forest = _forest(both["node"], both["root"], 0)
        yield forest.assign(group=forest.groupby("root")["node"].transform("min"))


def link_groups(pairs: DataFrame, left: str, right: str, *, bound: int = FOREST_BOUND) -> DataFrame:
    """Columns unit_key and group_id: each key of the pairs with the smallest key, as a string, of its component.

    Pairs with a null on either side link nothing and are left out; a key paired with itself is a group of its own;
    repeated pairs count once; no pairs give no rows. Other columns of the input, whatever their names, are ignored.
    The union-find keeps at most `bound` pairs in a task, the levels shrink geometrically since roots are drawn by hash.
    """
    edges = pairs.select(F.col(left).cast("string").alias("a"), F.col(right).cast("string").alias("b"))
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    schema = "node string, root string"
    forest = materialize(edges.mapInPandas(_local_forests(0, bound), schema))
    levels: list[DataFrame] = []
    while forest.count() > bound:
        best = materialize(forest.groupBy("node").agg(F.min_by("root", F.struct(F.xxhash64(F.col("root"), F.lit(len(levels))), "root")).alias("up")))
        among = forest.join(best, "node").where("root <> up").select("root", "up")
        moved = best.where("node <> up").join(forest.select(F.col("root").alias("node")).distinct(), "node", "left_semi")
        rest = among.union(moved.select("node", "up"))
        levels.append(best)
        forest = materialize(rest.mapInPandas(_local_forests(len(levels), bound), schema))
    ends = forest.repartition(1).mapInPandas(_finish, "node string, root string, group string")
    if not levels:
        return ends.select(F.col("node").alias("unit_key"), F.col("group").alias("group_id"))
    found = ends.select("node", "root")
    for best in reversed(levels):
        found = best.join(found.select(F.col("node").alias("up"), F.col("root").alias("top")), "up", "left").select("node", F.coalesce("top", "up").alias("root"))
    found = materialize(found)
    smallest = found.groupBy("root").agg(F.min("node").alias("group_id"))
    return found.join(smallest, "root").select(F.col("node").alias("unit_key"), "group_id")


def linking_rows(crosswalk: DataFrame) -> DataFrame:
    """Rows with both keys and one of the four linking types, white space at its ends and letter case ignored."""
    kind = F.lower(F.regexp_replace("link_type", r"(?U)^\s+|\s+$", ""))
    return crosswalk.where(kind.isin(*LINKING_TYPES) & F.col("from_key").isNotNull() & F.col("to_key").isNotNull())
