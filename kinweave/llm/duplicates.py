"""Records that differ in layout only: one of each, with the number of its copies.

Canonical bytes are cut into buckets by radix: a bucket with too many records is split by its next distinguishing
bytes, again and again, until each fits. Every bucket is counted in a trie whose terminals hold counter and first row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from kinweave.operators.balance import fragment_replicate_join, plan
from kinweave.session import materialize

#: Records that one bucket may hold.
BUCKET_LIMIT = 100_000


def letters_and_digits(text: F.Column) -> F.Column:
    """The letters and digits (Unicode L and N) in lower case; null stays null."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def record_key(ordered: list[str], exchangeable: list[str]) -> F.Column:
    """Canonical bytes of a record: letters and digits of each field; fields that may have changed places are sorted.

    Null is kept apart from the empty string, so null equals only null.
    """
    field = lambda c: F.coalesce(F.concat(F.lit("\x02"), letters_and_digits(F.col(c))), F.lit("\x01"))
    parts = [F.array_join(F.array_sort(F.array(*map(field, exchangeable))), "")] if exchangeable else []
    return F.encode(F.concat(*parts, *map(field, ordered)), "UTF-8")


class Trie:
    """A trie with compressed edges; a terminal counts its copies and keeps the smallest ord."""

    __slots__ = ("count", "edges", "keep")

    def __init__(self) -> None:
        self.edges: dict[int, tuple[bytes, Trie]] = {}
        self.count, self.keep = 0, None

    def add(self, key: bytes, count: int, keep: int) -> None:
        node, at = self, 0
        while at < len(key):
            edge = node.edges.get(key[at])
            if edge is None:
                leaf = Trie()
                node.edges[key[at]] = (key[at:], leaf)
                node, at = leaf, len(key)
                continue
            label, below = edge
            same = len(label) if key.startswith(label, at) else _common(label, key[at : at + len(label)])
            if same < len(label):
                middle = Trie()
                middle.edges[label[same]] = (label[same:], below)
                node.edges[key[at]] = (label[:same], middle)
                below = middle
            node, at = below, at + same
        node.count += count
        node.keep = keep if node.keep is None else min(node.keep, keep)

    def terminals(self) -> Iterator[tuple[bytes, int, int]]:
        stack = [(b"", self)]
        while stack:
            prefix, node = stack.pop()
            if node.count:
                yield prefix, node.count, node.keep
            stack += [(prefix + label, below) for label, below in node.edges.values()]


def _common(a: bytes, b: bytes) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["k", "n", "keep"]).astype({"n": "int64", "keep": "int64"})


def _count_locally(limit: int):
    """Copies within a partition become one row with their number before any row moves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, list[int]] = {}
        for batch in batches:
            for k, ord_ in zip(batch["k"], batch["ord"]):
                entry = held.get(k)
                if entry is None:
                    held[k] = [1, ord_]
                else:
                    entry[0] += 1
                    if ord_ < entry[1]:
                        entry[1] = ord_
            if len(held) >= limit:
                yield _frame([(k, *v) for k, v in held.items()])
                held = {}
        if held:
            yield _frame([(k, *v) for k, v in held.items()])

    return run


@F.pandas_udf(IntegerType())
def _split_depth(lo: pd.Series, hi: pd.Series) -> pd.Series:
    """Bytes up to the first one in which the smallest and the largest key of a bucket differ, and one more."""
    return pd.Series([_common(bytes(a), bytes(b)) + 2 for a, b in zip(lo, hi)], dtype="int32")


def radix_buckets(records: DataFrame, limit: int) -> list[DataFrame]:
    """records(k, ..) with their bucket, a prefix of k, in tables of one level each; a bucket has at most `limit` rows
    unless all of them are one key.

    On every level the buckets that are too large are split at the first byte that tells their keys apart, and the one
    after it; only their rows go on. Sizes are counted before rows move and stay in the cluster: the driver learns whether there is a next
    level. Buckets of one prefix length differ from those of another, since a prefix is settled once.
    """
    live, settled = records.withColumn("bucket", F.lit(b"")), []
    while True:
        sizes = live.groupBy("bucket").agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"))
        large = materialize(sizes.where((F.col("n") > limit) & (F.col("lo") != F.col("hi"))).select("bucket", _split_depth("lo", "hi").alias("depth")))
        if large.isEmpty():
            return [*settled, live]
        settled.append(live.join(large, "bucket", "left_anti").select(live.columns))
        deeper = live.join(large, "bucket").withColumn("bucket", F.substring("k", F.lit(1), F.col("depth")))
        live = materialize(deeper.select(live.columns))


def _count_in_tries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tries: dict[tuple[int, bytes], Trie] = {}
    for batch in batches:
        for k, n, keep, level, bucket in zip(batch["k"], batch["n"], batch["keep"], batch["level"], batch["bucket"]):
            trie = tries.get((level, bucket))
            if trie is None:
                trie = tries[level, bucket] = Trie()
            trie.add(k, n, keep)
    for trie in tries.values():
        yield _frame(list(trie.terminals()))


def count_records(rows: DataFrame, *, limit: int = BUCKET_LIMIT) -> DataFrame:
    """Columns k, n, keep: each distinct key (binary) of rows(k, ord) with its number of rows and its smallest ord.

    A key of any length, the empty one included, is a record; no rows give no records. However many rows a record
    has, at most one per partition of the input is moved. Buckets of a level are spread over as many tasks as they need.
    """
    schema = "k binary, n long, keep long"
    local = materialize(rows.select("k", "ord").mapInPandas(_count_locally(limit), schema))
    tasks = max(1, -(-local.count() * 2 // limit))
    levels = [level.withColumn("level", F.lit(i)) for i, level in enumerate(radix_buckets(local, limit))]
    placed = reduce(DataFrame.unionByName, levels).repartition(tasks, "level", "bucket")
    return placed.mapInPandas(_count_in_tries, schema)


def find_copies(table: DataFrame, ord_: str, ordered: list[str], exchangeable: list[str], *, limit: int = BUCKET_LIMIT) -> DataFrame:
    """Columns keep_ord, copy_ord: every row that isn't the first of its record, with the record's first row.

    Fields that are null match only null; fields without a letter or digit match each other; other columns, whatever
    their names, don't matter. Rows of a record with more than `limit` copies are spread over several tasks.
    """
    rows = table.select(F.col(ord_).cast("long").alias("ord"), record_key(ordered, exchangeable).alias("k"))
    several = materialize(count_records(rows, limit=limit).where("n > 1"))
    total = several.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    by = plan(several, "k", "n", tasks=max(1, -(-total // limit)))
    joined = fragment_replicate_join(rows, several.select("k", "keep"), "k", ["ord"], by)
    return joined.where("ord <> keep").select(F.col("keep").alias("keep_ord"), F.col("ord").alias("copy_ord"))


def collapse(table: DataFrame, ord_: str, ordered: list[str], exchangeable: list[str], *, limit: int = BUCKET_LIMIT) -> DataFrame:
    """Columns keep_ord, copies: one row per record with its first row and the number of rows it stands for."""
    rows = table.select(F.col(ord_).cast("long").alias("ord"), record_key(ordered, exchangeable).alias("k"))
    return count_records(rows, limit=limit).select(F.col("keep").alias("keep_ord"), F.col("n").alias("copies"))
