"""Probabilistic linkage of rows without a shared key: blocking in passes, agreement levels, EM, posterior as confidence.

A unit is named by a name and two places (state and district, which may have changed places). Places are linked first,
so that units are compared only within places that can be the same and only if their names share a positional segment.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.duplicates import letters_and_digits
from kinweave.llm.names import closing_words, first_shared, folded, parsed, probing_segments, reference_segments, with_words
from kinweave.operators.balance import fragment_replicate_sides, plan
from kinweave.session import materialize

#: Edits within which names and places can be the same.
MAX_EDITS = 2
#: Posterior from which a pair is a match.
LEAST_CONFIDENCE = 0.5
#: Levels of each compared field. name: equal, 1 edit, 2 edits, another (further, or of another closing word or number);
#: direction, number: same, other; place: equal, close, missing.
LEVELS = {"name": 4, "direction": 2, "number": 2, "place_a": 3, "place_b": 3}
#: Level of the name that is another one. Such pairs are counted for the model, not kept.
OTHER_NAME = 3
#: Levels that mean that a field isn't known.
MISSING = {"place_a": 2, "place_b": 2}

# Words added to the name of a place that don't belong to it.
ADDED = r"\\b(prov|province|dist|district|state|old|new name|erstwhile)\\b"


@dataclass(frozen=True)
class Model:
    """What EM found: share of matches among the compared pairs, and level probabilities of matches and others."""

    share: float
    m: dict[str, list[float]]
    u: dict[str, list[float]]
    iterations: int


def fit(patterns: list[tuple[tuple[int, ...], int]], *, rounds: int = 100, prior: float = 20.0) -> Model:
    """EM over pattern counts (at most one per combination of levels), fields independent within either class.

    A missing place says nothing for or against a match, so it has no part in the estimates. EM starts from agreement
    being likely among matches only; `prior` pseudo-pairs of the start keep levels that never occur from reaching zero.
    No patterns give the start itself.
    """
    sizes = list(LEVELS.values())
    start_m = [np.array([0.9] + [0.1 / (n - 1)] * (n - 1)) for n in sizes]
    start_u = [np.array([0.3] + [0.7 / (n - 1)] * (n - 1)) for n in sizes]
    start_m[0] = np.array([0.6, 0.25, 0.149, 0.001])
    start_u[0] = np.array([0.01, 0.02, 0.05, 0.92])
    start_m[3:] = start_u[3:] = [np.array([0.7, 0.2, 0.1])] * 2  # all pairs come from places that are alike
    m, u, share, i = start_m, start_u, 0.5, 0
    if patterns:
        levels, counts = np.array([p for p, _ in patterns]), np.array([n for _, n in patterns], dtype=float)
        known = np.array([levels[:, f] != MISSING.get(field, -1) for f, field in enumerate(LEVELS)])
        likely = lambda x: np.prod([np.where(known[f], x[f][levels[:, f]], 1.0) for f in range(len(sizes))], axis=0)
        told = lambda w, f, start: (np.bincount(levels[:, f], w * known[f], sizes[f]) + prior * start[f]) / ((w * known[f]).sum() + prior)
        for i in range(1, rounds + 1):
            lm, lu = share * likely(m), (1 - share) * likely(u)
            post = lm / (lm + lu)
            wm, wu = counts * post, counts * (1 - post)
            new_share = (wm.sum() + prior) / (counts.sum() + 2 * prior)
            m, u = [told(wm, f, start_m) for f in range(len(sizes))], [told(wu, f, start_u) for f in range(len(sizes))]
            if abs(new_share - share) < 1e-7:
                break
            share = new_share
    name = lambda x: dict(zip(LEVELS, (a.tolist() for a in x)))
    return Model(float(share), name(m), name(u), i)


def match_odds(model: Model) -> F.Column:
    """Logarithm of the odds of a match by the levels; a missing place doesn't count."""
    odds = F.lit(np.log(model.share / (1 - model.share)))
    for field in LEVELS:
        weights = [0.0 if level == MISSING.get(field) else float(np.log(a / b)) for level, (a, b) in enumerate(zip(model.m[field], model.u[field]))]
        odds = odds + F.element_at(F.array(*map(F.lit, weights)), F.col(field) + 1)
    return odds


def _places(spark, table: DataFrame) -> DataFrame:
    """table with a, b: its two places in plain letters, and their words; null or without a letter is null."""
    words = lambda c: f"filter(split(regexp_replace({folded(c)}, '{ADDED}', ' '), '[^\\\\p{{{{L}}}}\\\\p{{{{N}}}}]+'), x -> x <> '')"
    wide = materialize(spark.sql(f"SELECT *, {words('state')} AS aw, {words('district')} AS bw FROM {{t}}", t=table))
    return wide.withColumns({"a": F.nullif(F.array_join("aw", ""), F.lit("")), "b": F.nullif(F.array_join("bw", ""), F.lit(""))})


def _similar_places(spark, left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns p, q, level: places of left that can be those of right; 0 equal, 1 within the edits or abbreviated."""
    parts = lambda t: t.select(F.explode(F.array(F.struct(F.col("a").alias("p"), F.col("aw").alias("w")), F.struct(F.col("b").alias("p"), F.col("bw").alias("w")))).alias("x")).select("x.*").where("p IS NOT NULL").groupBy("p").agg(F.min("w").alias("w"))
    p, q = materialize(parts(left)), materialize(parts(right))
    return materialize(
        spark.sql(
            f"""
            WITH piece AS ({reference_segments("{q}", "p", MAX_EDITS)}), probe AS ({probing_segments("{p}", "p", MAX_EDITS)}),
            near AS (
              SELECT DISTINCT l.p, r.p AS q, levenshtein(l.p, r.p, {MAX_EDITS}) AS edits
              FROM probe l JOIN piece r ON l._n = r._n AND l._i = r._i AND l._seg = r._seg
              WHERE levenshtein(l.p, r.p, {MAX_EDITS}) >= 0 AND (l.p = r.p OR levenshtein(l.p, r.p, {MAX_EDITS}) * 4 <= length(r.p))),
            short AS (
              SELECT l.p, r.p AS q, 1 AS edits
              FROM {{p}} l JOIN {{q}} r ON l.w[size(l.w) - 1] = r.w[size(r.w) - 1] AND size(l.w) = size(r.w) AND left(l.w[0], 1) = left(r.w[0], 1)
              WHERE size(l.w) > 1 AND l.p <> r.p AND forall(zip_with(l.w, r.w, (x, y) -> startswith(y, x)), x -> x))
            SELECT p, q, min(least(edits, 1)) AS level FROM (SELECT * FROM near UNION ALL SELECT * FROM short) GROUP BY p, q
            """,
            p=p,
            q=q,
        )
    )


def _same_places(spark, lost: DataFrame, units: DataFrame, similar: DataFrame) -> DataFrame:
    """Columns a, b, place, place_a, place_b, near: places (a, b) of lost and the keys of those of units they can be.

    Both places have to be alike, in either order; one may be missing on one side, then the other has to be alike.
    Where it is missing in lost, the key is that of one place (_one_place), however many pairs it is in; near then has
    the levels of all places that are alike.
    """
    return materialize(
        spark.sql(
            f"""
            WITH one AS (SELECT DISTINCT a, b FROM {{lost}}), two AS (SELECT DISTINCT x, y FROM {{units}}),
            half AS (SELECT a, b, near FROM one JOIN (SELECT p, map_from_entries(collect_list(struct(q, level))) AS near FROM {{similar}} GROUP BY p) ON p = coalesce(a, b) WHERE a IS NULL OR b IS NULL)
            SELECT a, b, {_both_places("x", "y")} AS place, min(place_a) AS place_a, min(place_b) AS place_b, CAST(NULL AS MAP<STRING, INT>) AS near FROM (
              SELECT o.a, o.b, t.x, t.y, s.level AS place_a, r.level AS place_b
              FROM one o JOIN {{similar}} s ON o.a = s.p JOIN {{similar}} r ON o.b = r.p
              JOIN two t ON t.x = least(s.q, r.q) AND t.y = greatest(s.q, r.q)
              UNION ALL
              SELECT o.a, o.b, t.x, t.y, s.level, 2 FROM one o JOIN {{similar}} s ON o.a = s.p JOIN two t ON t.x = s.q AND t.y IS NULL
              UNION ALL
              SELECT o.a, o.b, t.x, t.y, 2, s.level FROM one o JOIN {{similar}} s ON o.b = s.p JOIN two t ON t.x = s.q AND t.y IS NULL)
            GROUP BY a, b, x, y
            UNION ALL
            SELECT a, b, {_one_place("q")}, if(a IS NULL, 2, 0), if(b IS NULL, 2, 0), near FROM (SELECT *, explode(map_keys(near)) AS q FROM half)
            """,
            lost=lost,
            units=units,
            similar=similar,
        )
    )


def _both_places(x: str, y: str) -> str:
    """The key of two places, the second of which may be missing; places are letters and digits."""
    return f"concat_ws('|', {x}, coalesce({y}, ''))"


def _one_place(p: str) -> str:
    """The key of one place of a unit that has two."""
    return f"concat('|', {p})"


def _compared(spark, placed: DataFrame, unit: DataFrame) -> DataFrame:
    """Columns id, to_ord, the levels and spelling (null for another name) of every pair whose place has the same key and
    whose names share a segment, once each.

    Rows are moved by the key of their place only, packed to tasks by load, and meet by segments where they are. Of a
    place with many units the rows go to several tasks and the lost rows without the other place to each of them; of
    units without another place, which are few, to each task of the lost rows. No pair moves.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = placed.where("near IS NOT NULL").select("place").distinct()
    single = spark.sql(f"SELECT {_one_place('p')} AS place, if(p = x, y, x) AS other, to_ord, stem, dirs, nums, spelled FROM (SELECT *, explode(array_distinct(array(x, y))) AS p FROM {{u}} WHERE y IS NOT NULL)", u=unit)
    single = materialize(single.join(asked, "place", "left_semi"))
    double = spark.sql(f"SELECT {_both_places('x', 'y')} AS place, CAST(NULL AS STRING) AS other, to_ord, stem, dirs, nums, spelled FROM {{u}}", u=unit)

    def pairs(lost: DataFrame, units: DataFrame, spread_units: bool) -> DataFrame:
        count = lambda t, c: t.groupBy("place").agg(F.count("*").alias(c))
        loads = materialize(count(lost, "l").join(count(units, "u"), "place").select("place", F.expr("19 * l + 3 * u + l * u DIV 200").alias("load")))
        by = plan(loads, "place", "load", tasks=tasks)
        if spread_units:
            units, lost = fragment_replicate_sides(units, lost, "place", ["to_ord"], by)
        else:
            lost, units = fragment_replicate_sides(lost, units, "place", ["id"], by)
        return spark.sql(
            f"""
            WITH piece AS ({reference_segments("{units}", "stem", MAX_EDITS)}), probe AS ({probing_segments("{lost}", "stem", MAX_EDITS)}),
            met AS (
              SELECT l.id, r.to_ord, levenshtein(l.stem, r.stem, {MAX_EDITS}) AS edits, l.stem RLIKE '[^a-z]' AS other_script, length(r.stem) AS stem_length,
                CASE WHEN size(l.dirs) = 0 AND size(r.dirs) = 0 OR arrays_overlap(l.dirs, r.dirs) THEN 0 ELSE 1 END AS direction,
                CASE WHEN l.nums = r.nums THEN 0 ELSE 1 END AS number,
                l.place_a, l.place_b, least(l.near[substring(l.place, 2)], l.near[r.other]) AS alike, l.spelled AS typed, r.spelled AS printed
              FROM (SELECT *, xxhash64(place, _shard, _n, _i, _seg) AS at FROM probe) l JOIN (SELECT _task, place, _shard, to_ord, stem, dirs, nums, spelled, other, xxhash64(place, _shard, _n, _i, _seg) AS at FROM piece) r
                ON l.at = r.at AND l._task = r._task AND l.place = r.place AND l._shard = r._shard
              WHERE {first_shared("l.stem", "r.stem", MAX_EDITS)} AND (l.near IS NULL OR l.near[r.other] IS NULL OR substring(l.place, 2) <= r.other)),
            named AS (SELECT *, CAST(CASE WHEN edits < 0 OR direction = 1 OR number = 1 OR other_script AND edits * 3 > stem_length THEN {OTHER_NAME} ELSE edits END AS INT) AS name FROM met)
            SELECT id, to_ord, name, direction, number, CAST(if(place_a = 2, 2, coalesce(alike, place_a)) AS INT) AS place_a, CAST(if(place_b = 2, 2, coalesce(alike, place_b)) AS INT) AS place_b,
              CASE WHEN name < {OTHER_NAME} THEN levenshtein(typed, printed) END AS spelling, typed, printed
            FROM named
            """,
            units=units,
            lost=lost,
        )

    return pairs(placed.where("near IS NULL"), double, False).unionByName(pairs(placed.where("near IS NOT NULL"), single, True))


def link(lost: DataFrame, units: DataFrame) -> tuple[DataFrame, Model]:
    """Columns ord, to_ord, confidence: each row of lost(ord, name, state, district) and the row of units with the same
    columns that is the same place, if there is one; and the fitted model.

    A row has one match or none: the most probable, then the nearest spelling, then the smallest to_ord; copies of a
    unit count once. A null or empty name, or no place at all, has no match; a single missing place is a level of its
    own. The posterior alone decides; a name with another closing word or number is compared as another name. Names may
    be in any script; outside Latin, where few characters make a name, one edit counts as near for three of them. Equal
    places in other units are no evidence, since a unit of the same name elsewhere is another place: pairs are made in
    passes by both places, in either order, and by each of them alone where the other is missing. Equal rows are compared once; empty tables
    give no rows; other columns don't matter. Pairs are made only of names that share a positional segment in places
    that can be the same. The driver gets one count per combination of levels, at most 144.
    """
    spark = lost.sparkSession
    rows = lost.select(F.col("ord").alias("lost_ord"), "name", "state", "district")
    distinct = materialize(rows.where(F.col("name").rlike(r"(?U)\S")).groupBy("name", "state", "district").agg(F.min("lost_ord").alias("id")))
    named = units.where("name IS NOT NULL").select("ord", "name", "state", "district")
    named = materialize(spark.sql(with_words("{t}", "name"), t=named))
    closing = closing_words(named, "name")
    left = _places(spark, spark.sql(parsed("{t}", "name", closing), t=distinct))
    right = _places(spark, spark.sql(parsed("{t}", None, closing), t=named))
    right = right.withColumns({"x": F.least("a", "b"), "y": F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.greatest("a", "b"))}).where("stem <> ''")
    similar = _similar_places(spark, left, right)
    same = _same_places(spark, left, right, similar)
    spelled = letters_and_digits(F.col("name"))
    unit = materialize(right.withColumn("spelled", spelled).groupBy("x", "y", "stem", "dirs", "nums", "spelled").agg(F.min("ord").alias("to_ord")))
    keyed = left.where("stem <> ''").withColumn("spelled", spelled).select("id", "stem", "dirs", "nums", "spelled", F.coalesce("a", F.lit("")).alias("ka"), F.coalesce("b", F.lit("")).alias("kb"))
    placed = keyed.join(same.select(F.coalesce("a", F.lit("")).alias("ka"), F.coalesce("b", F.lit("")).alias("kb"), "place", "place_a", "place_b", "near"), ["ka", "kb"]).drop("ka", "kb")
    compared = _compared(spark, materialize(placed), unit)
    known = F.col("name") < OTHER_NAME
    counted = materialize(compared.groupBy(*LEVELS, *[F.when(known, F.col(c)).alias(c) for c in ("id", "to_ord", "spelling")]).agg(F.count("*").alias("n")))
    patterns = [(tuple(r[f] for f in LEVELS), r["n"]) for r in counted.groupBy(*LEVELS).agg(F.sum("n").alias("n")).collect()]
    model = fit(patterns)
    agrees = F.col("odds") >= np.log(LEAST_CONFIDENCE / (1 - LEAST_CONFIDENCE))
    agreed = counted.where(known).withColumn("odds", match_odds(model)).where(agrees).select("id", "to_ord", "spelling", "odds")
    if not counted.where(~known).withColumn("odds", match_odds(model)).where(agrees).isEmpty():
        others = compared.where(~known).withColumn("odds", match_odds(model)).where(agrees)
        agreed = agreed.union(others.select("id", "to_ord", F.levenshtein("typed", "printed"), "odds"))
    best = agreed.groupBy("id").agg(F.min(F.struct((-F.col("odds")).alias("c"), "spelling", "to_ord")).alias("best")).select("id", "best.to_ord", (1 / (1 + F.exp("best.c"))).alias("confidence"))
    matched = distinct.join(best, "id").select(F.col("name").alias("n"), F.col("state").alias("s"), F.col("district").alias("d"), "to_ord", "confidence")
    found = rows.join(matched, F.col("name").eqNullSafe(F.col("n")) & F.col("state").eqNullSafe(F.col("s")) & F.col("district").eqNullSafe(F.col("d")))
    return found.select(F.col("lost_ord").alias("ord"), "to_ord", "confidence"), model


def lost_rows(crosswalk: DataFrame) -> DataFrame:
    """Rows of the crosswalk without to_id, as (ord, name, state, district); to_name names the unit, else from_name."""
    return crosswalk.where("to_id IS NULL").select("ord", F.coalesce("to_name", "from_name").alias("name"), "state", "district")
