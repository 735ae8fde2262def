"""A mixture of sources with target shares of all tokens: copies of documents by pivotal dependent rounding.

Each document of a source gets the same expected number of copies. Its whole part is certain; the fractions are paired
and mass moves at random from one to the other, weighed by tokens, until one of them is 0 or 1, so that the source's
tokens stay as they were. What is left of each bucket is paired on the next level of a tree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.tokens import TOKENIZERS, count_tokens
from kinweave.session import materialize

#: Documents that one task pairs.
BUCKET_ROWS = 100_000
_EPS = 1e-9


@dataclass(frozen=True)
class Rate:
    source: str
    target_share: float
    max_repeats: int
    tokens: int
    copies: float


def rates(available: dict[str, int], targets: list[tuple[str, float, int]], total: float | None = None) -> list[Rate]:
    """Expected copies of each source's documents.

    Shares of sources without tokens are spread over the others in proportion. Without a total, the mixture is as large
    as all targets can be met exactly within max_repeats; with a larger total, capped sources give what they can.
    """
    live = {s: w for s, w, _ in targets if available.get(s) and w > 0}
    scale = sum(live.values())
    caps = {s: r for s, _, r in targets}
    if total is None:
        total = min((caps[s] * available[s] * scale / w for s, w in live.items()), default=0.0)
    return [Rate(s, w, r, available.get(s) or 0, min(float(r), total * w / scale / available[s]) if s in live else 0.0) for s, w, r in targets]


def _pairing(seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return settle(rows, seed)

    return run


def settle(rows: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Settle all but at most one fraction, keeping the sum of fraction times tokens.

    Long documents are paired first, so that the fraction left over is a short one's and moves the shares little.
    """
    rows = rows.sort_values(["tokens", "mix", "doc_id", "part"], ascending=[False, True, True, True], kind="stable")
    p, size = rows["fraction"].to_numpy(float).copy(), np.maximum(rows["tokens"].to_numpy(float), _EPS)
    draw = np.random.RandomState((int(rows["mix"].iloc[0]) ^ seed) & 0x7FFFFFFF).random_sample(len(p))
    held = -1
    for i in range(len(p)):
        if p[i] <= _EPS or p[i] >= 1 - _EPS:
            continue
        if held < 0:
            held = i
            continue
        up = min((1 - p[held]) * size[held], p[i] * size[i])
        down = min(p[held] * size[held], (1 - p[i]) * size[i])
        move = up if draw[i] < down / (up + down) else -down
        p[held] += move / size[held]
        p[i] -= move / size[i]
        if _EPS < p[i] < 1 - _EPS:
            held = i
        elif not _EPS < p[held] < 1 - _EPS:
            held = -1
    return rows.assign(fraction=np.where(p <= _EPS, 0.0, np.where(p >= 1 - _EPS, 1.0, p)))


def round_fractions(rows: DataFrame, *, bucket_rows: int = BUCKET_ROWS, seed: int = 1) -> DataFrame:
    """rows(source, doc_id, part, tokens, base, fraction) with copies: base plus 0 or 1, the fractions by pivotal rounding.

    A source's fractions are paired within buckets drawn by hash; the one fraction that may be left in each bucket goes
    to the next level, until one bucket per source is left; its last fraction is drawn by its own probability.
    """
    schema = "source string, doc_id long, part long, tokens long, base long, fraction double, mix long, bucket long"
    settled: list[DataFrame] = []
    level = 0
    live = rows.withColumn("mix", F.xxhash64("source", "doc_id", "part", F.lit(seed)))
    per_source = {r["source"]: r["n"] for r in live.groupBy("source").agg(F.count("*").alias("n")).collect()}
    while True:
        buckets = {s: max(1, -(-n // bucket_rows)) for s, n in per_source.items()}
        number = F.coalesce(*[F.when(F.col("source") == F.lit(s), F.lit(b)) for s, b in buckets.items()], F.lit(1)) if buckets else F.lit(1)
        live = live.withColumn("bucket", F.pmod(F.col("mix") + level, number))
        done = materialize(live.groupBy("source", "bucket").applyInPandas(_pairing(seed + level), schema))
        open_ = F.col("fraction").between(_EPS, 1 - _EPS)
        if max(buckets.values(), default=1) == 1:
            last = F.when(open_, F.when(F.pmod(F.xxhash64("mix", F.lit(seed)), F.lit(1_000_003)) / 1_000_003 < F.col("fraction"), 1.0).otherwise(0.0)).otherwise(F.col("fraction"))
            settled.append(done.withColumn("fraction", last))
            break
        settled.append(done.where(~open_))
        live = done.where(open_).drop("bucket")
        per_source = {s: b for s, b in buckets.items()}
        level += 1
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.withColumn("copies", (F.col("base") + F.col("fraction")).cast("long")).drop("mix", "bucket", "fraction")


def mix(documents: DataFrame, targets: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", total: float | None = None, folder: str = TOKENIZERS, seed: int = 1, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, tokens, copies) and its report (source, target_share, max_repeats, tokens_available, tokens_mixed, actual_share).

    Documents of sources without a target, of no source, and texts without a token (null, empty) aren't in the mixture;
    a target without documents is reported with no tokens. No document has more than max_repeats copies. Rows of equal
    id are documents of their own; targets are a table of one row per source, of which the driver holds the totals.
    """
    wanted = [(r["source"], float(r["target_share"]), int(r["max_repeats"])) for r in targets.where("source IS NOT NULL").collect()]
    sized = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")).where(F.col("source").isin([s for s, _, _ in wanted]))
    counted = sized.groupBy("source", "doc_id", "text").agg(F.count("*").alias("times")).withColumn("tokens", count_tokens(folder)("text").cast("long"))
    counted = materialize(counted.drop("text").groupBy("source", "doc_id", "tokens").agg(F.sum("times").alias("times")).where("tokens > 0"))
    available = {r["source"]: r["n"] for r in counted.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("n")).collect()}
    plan = rates(available, wanted, total)
    copies = F.coalesce(*[F.when(F.col("source") == F.lit(r.source), F.lit(r.copies)) for r in plan], F.lit(0.0)) if plan else F.lit(0.0)
    each = counted.select("source", "doc_id", "tokens", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("part"))
    parts = each.withColumn("base", F.floor(copies + F.lit(_EPS)).cast("long")).withColumn("fraction", F.greatest(F.lit(0.0), copies - F.col("base")))
    mixed = materialize(round_fractions(parts.select("source", "doc_id", "part", "tokens", "base", "fraction"), bucket_rows=bucket_rows, seed=seed).where("copies > 0"))
    mixture = mixed.select("doc_id", "source", "tokens", "copies")
    reached = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens_mixed"), F.max("copies").alias("most_copies"))
    whole = mixed.agg(F.coalesce(F.sum(F.col("tokens") * F.col("copies")), F.lit(0)).alias("n")).first()["n"]
    schema = "source string, target_share double, max_repeats int, tokens_available long"
    asked = documents.sparkSession.createDataFrame([(r.source, r.target_share, r.max_repeats, r.tokens) for r in plan], schema)
    report = asked.join(reached, "source", "left").withColumns({"tokens_mixed": F.coalesce("tokens_mixed", F.lit(0)), "most_copies": F.coalesce("most_copies", F.lit(0))})
    return mixture, report.withColumn("actual_share", F.col("tokens_mixed") / F.lit(float(whole)) if whole else F.lit(0.0))
