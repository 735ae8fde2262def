"""Similarity of names over whole blocks of both sides, by posting lists as arrays.

Without a scope nearly all names share a trigram, and a join would have a row for each one that two names share. Here a
task holds one block of names with the posting lists of their features and adds up, for one name after the other, what
it shares with the whole block; only what can be among the k best leaves the task, as sums that Spark scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.names import NGRAM_WEIGHT, TOKEN_WEIGHT

#: Names of a block that is searched, names that are searched for by one task, and comparisons that are worth a task.
BLOCK, ASKED, LEAST_WORK = 1 << 16, 1 << 15, 5_000_000
#: Neighbours in a block of which only the best score bounds the k-th one.
_RUN = 64
_MARGIN = 2e-6  # scores are rounded to six decimals
SUMS = "lid long, rid long, dot long, shared long, norms double, words long, r_words long"


def _features(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams of all names: the name each belongs to, the trigram as a number, and how often the name has it."""
    padded = [f"  {n} " if n else "" for n in names]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    signs = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    of = np.repeat(np.arange(len(names)), sizes)
    if len(signs) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams = (signs[:-2] << 42 | signs[1:-1] << 21 | signs[2:])[whole := of[:-2] == of[2:]]
    order = np.lexsort((grams, of := of[:-2][whole]))
    of, grams = of[order], grams[order]
    first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (grams[1:] != grams[:-1])]))
    return of[first], grams[first], np.diff([*first, len(of)])


def _words(names: list[str]) -> list[list[str]]:
    return [[w for w in dict.fromkeys(n.split(" ")) if w] for n in names]


class Block:
    """Posting lists of the distinct names of one block; of names that score alike, earlier ones come first."""

    def __init__(self, names: list[str]):
        n = len(names)
        of, grams, counts = _features(names)
        self.norms = np.sqrt(np.bincount(of, counts * counts, n))
        order = np.lexsort((of, grams))
        self.grams, starts = np.unique(grams[order], return_index=True)
        self.starts, self.of = np.append(starts, len(order)), of[order]
        self.parts = (counts / self.norms[of])[order]
        words = _words(names)
        self.words = np.fromiter(map(len, words), np.int64, n)
        codes, found = pd.factorize(np.array([w for ws in words for w in ws], dtype=object))
        order = np.argsort(codes, kind="stable")
        self.word_of = np.repeat(np.arange(n), self.words)[order]
        self.word_starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(found)))]).astype(np.int64)
        self.word_no = {w: i for i, w in enumerate(found)}
        self.empty = [i for i, name in enumerate(names) if not name]
        self.n = n

    def best(self, names: list[str], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
        """For each name that shares anything its number, and of all that can be among its k best: their places in the
        block, dot, shared words, product of norms; and the number of its words.
        """
        of, grams, counts = _features(names)
        bounds = np.searchsorted(of, np.arange(len(names) + 1))
        squares = np.bincount(of, counts * counts, len(names))
        at = np.minimum(np.searchsorted(self.grams, grams), max(0, len(self.grams) - 1))
        known = self.grams[at] == grams if len(self.grams) else np.zeros(len(grams), bool)
        padded = np.zeros(-(-self.n // _RUN) * _RUN)
        for i, words in enumerate(_words(names)):
            if not names[i]:
                if self.empty:
                    yield i, np.array(self.empty), np.array([1]), np.array([0]), np.array([0.0]), 0
                continue
            which = np.arange(bounds[i], bounds[i + 1])[known[bounds[i] : bounds[i + 1]]]
            if not len(which):
                continue  # a shared word is a shared trigram
            slices = [slice(self.starts[a], self.starts[a + 1]) for a in at[which]]
            sums = np.bincount(np.concatenate([self.of[s] for s in slices]), np.concatenate([self.parts[s] * c if c > 1 else self.parts[s] for s, c in zip(slices, counts[which])]), self.n)
            norm = np.sqrt(squares[i])
            score = padded[: self.n]
            np.multiply(sums, NGRAM_WEIGHT / norm, out=score)
            lists = [self.word_of[self.word_starts[c] : self.word_starts[c + 1]] for w in words if (c := self.word_no.get(w)) is not None]
            holders, times = (lists[0], np.ones(len(lists[0]), np.int64)) if len(lists) == 1 else np.unique(np.concatenate(lists), return_counts=True) if lists else (np.empty(0, np.int64), np.empty(0, np.int64))
            score[holders] += TOKEN_WEIGHT * times / (len(words) + self.words[holders] - times)
            least = 0.0
            if len(padded) // _RUN > k:
                tops = padded.reshape(-1, _RUN).max(axis=1)
                least = np.partition(tops, len(tops) - k)[len(tops) - k]
            near = np.flatnonzero(score >= least - _MARGIN) if least > _MARGIN else np.flatnonzero(score > 0)
            of_near = score[near]
            if len(near) > k:
                near = near[of_near >= np.partition(of_near, len(near) - k)[len(near) - k] - _MARGIN]
            shared = np.zeros(len(near), np.int64)
            if len(holders):
                there = np.minimum(np.searchsorted(holders, near), len(holders) - 1)
                shared = np.where(holders[there] == near, times[there], 0)
            dot, norms = np.rint(sums[near] * self.norms[near]).astype(np.int64), norm * self.norms[near]
            if len(near) > 4 * k:  # of those with the very same sums the k first are enough
                same = pd.DataFrame({"d": dot, "s": shared, "n": norms, "w": self.words[near]}).groupby(["d", "s", "n", "w"]).cumcount().to_numpy() < k
                near, dot, shared, norms = near[same], dot[same], shared[same], norms[same]
            yield i, near, dot, shared, norms, len(words)


def searched(names: DataFrame, others: DataFrame, k: int) -> DataFrame:
    """SUMS of every name (lid, canonical) with those of others (rid, canonical, first) that can be among its k best.

    Both are distinct. Every task has a block of others and a block of names, both of bounded size; each is sent to as
    many tasks as the other side has blocks. Of equal scores those with the smaller first count.
    """
    asked, there = names.count(), others.count()
    blocks = max(1, -(-there // BLOCK))
    spark = names.sparkSession
    wanted = min(2 * spark.sparkContext.defaultParallelism, asked * there // LEAST_WORK + 1)
    groups = max(1, -(-asked // ASKED), -(-wanted // blocks))
    spread = lambda n: F.pmod(F.xxhash64("canonical"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = names.select(F.col("lid").alias("no"), "canonical", F.lit(None).cast("long").alias("first"), spread(groups).alias("g"), every(blocks).alias("b"))
    right = others.select(F.col("rid").alias("no"), "canonical", F.col("first").cast("long").alias("first"), spread(blocks).alias("b"), every(groups).alias("g")).select("no", "canonical", "first", "g", "b")
    both = left.unionByName(right).select("no", "canonical", "first", (F.col("g") * blocks + F.col("b")).cast("int").alias("task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_batches = list(batches)
        if not held_batches:
            return
        for _, part in pa.Table.from_batches(held_batches).to_pandas(integer_object_nulls=True).groupby("task"):
            asks = part["first"].isna()
            ask, have = part[asks], part[~asks].sort_values("first")
            if not len(ask) or not len(have):
                continue
            block, lids, rids = Block(have["canonical"].tolist()), ask["no"].to_numpy(), have["no"].to_numpy()
            held: list[tuple] = []
            for found in block.best(ask["canonical"].tolist(), k):
                held.append(found)
                if len(held) == 4096:
                    yield _batch(held, lids, rids, block)
                    held = []
            if held:
                yield _batch(held, lids, rids, block)

    return both.repartitionById(groups * blocks, "task").mapInArrow(run, SUMS)


def _batch(held: list[tuple], lids: np.ndarray, rids: np.ndarray, block: Block) -> pa.RecordBatch:
    sizes = [len(x[1]) for x in held]
    near, dot, shared, norms = (np.concatenate([x[j] for x in held]) for j in (1, 2, 3, 4))
    columns = [np.repeat(lids[[x[0] for x in held]], sizes), rids[near], dot, shared, norms, np.repeat([x[5] for x in held], sizes), block.words[near]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in SUMS.split(", ")])
