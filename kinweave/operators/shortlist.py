"""The k most similar names of the same scope for every row, from posting lists.

Two names have a similarity above zero only if they share a trigram (a shared word is one, with the spaces around it).
So pairs come from an equi-join on scope and trigram or word; where a row has fewer than k of them, the first names of
the scope fill up with zero, as a ranking of all pairs would.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.names import combined, cosine, jaccard, tokens, trigrams
from kinweave.operators.exact import same_scope
from kinweave.operators.order import with_position
from kinweave.operators.prepare import scope_columns
from kinweave.operators.search import searched
from kinweave.plans.spec import Spec
from kinweave.session import materialize


def entries(name: str) -> str:
    """Trigrams of a canonical name as an array of (value, n), counted after sorting once."""
    return f"aggregate(array_sort({name}), CAST(array() AS ARRAY<STRUCT<value: STRING, n: INT>>), (acc, g) -> CASE WHEN size(acc) > 0 AND acc[size(acc) - 1].value = g THEN concat(slice(acc, 1, size(acc) - 1), array(struct(g AS value, acc[size(acc) - 1].n + 1 AS n))) ELSE concat(acc, array(struct(g AS value, 1 AS n))) END)"


def postings(frame: DataFrame, row: str, scopes: list[str]) -> DataFrame:
    """Rows (row, scopes, feature, n, norm, words): trigrams, words marked by \\x01, and \\x02 for the empty name.

    Features are made once per distinct name, however many rows have it.
    """
    names = frame.select("canonical").distinct().withColumns({"_g": trigrams(F.col("canonical")), "_t": tokens(F.col("canonical"))})
    names = names.withColumn("_e", F.expr(entries("_g"))).withColumns({"norm": F.sqrt(F.expr("aggregate(_e, 0L, (a, e) -> a + e.n * e.n)").cast("double")), "words": F.size("_t")})
    marks = F.when(F.col("canonical") == "", F.array(F.struct(F.lit("\x02").alias("value"), F.lit(1).alias("n")))).otherwise(F.concat("_e", F.transform("_t", lambda t: F.struct(F.concat(F.lit("\x01"), t).alias("value"), F.lit(1).alias("n")))))
    features = names.select("canonical", "norm", "words", F.explode(marks).alias("f"))
    return frame.select("canonical", F.col(row), *scopes).join(features, "canonical").select(row, *scopes, "norm", "words", F.col("f.value").alias("feature"), F.col("f.n").alias("n"))


def similar_pairs(left: DataFrame, right: DataFrame, row_left: str, row_right: str, scopes: list[str]) -> DataFrame:
    """Pairs of rows of one scope with a similarity above zero: score, token_jaccard, ngram_cosine, six decimals each."""
    a, b = postings(left, row_left, scopes), postings(right, row_right, scopes)
    b = b.select(row_right, *[F.col(s).alias(f"r_{s}") for s in scopes], F.col("norm").alias("r_norm"), F.col("words").alias("r_words"), F.col("feature").alias("r_feature"), F.col("n").alias("r_n"))
    condition = F.col("feature") == F.col("r_feature")
    for s in scopes:
        condition = condition & F.col(s).eqNullSafe(F.col(f"r_{s}"))
    is_word = F.col("feature").startswith("\x01")
    # what is the same for all rows of a pair travels as two maxima: the product of norms, both word counts in one long
    sums = a.join(b, condition).groupBy(row_left, row_right).agg(
        F.sum(F.when(is_word, 0).otherwise(F.col("n") * F.col("r_n"))).alias("dot"), F.sum(is_word.cast("int")).alias("shared"), F.max(F.col("norm") * F.col("r_norm")).alias("norms"), F.max(F.shiftleft(F.col("words").cast("long"), 32) + F.col("r_words")).alias("words")
    )
    words, r_words = F.shiftright("words", 32), F.col("words").bitwiseAND(F.lit((1 << 32) - 1))
    token_score = jaccard(F.col("shared"), words, r_words)
    ngram_score = cosine(F.col("dot"), F.col("norms"))
    return sums.select(row_left, row_right, F.round(combined(token_score, ngram_score), 6).alias("score"), F.round(token_score, 6).alias("token_jaccard"), F.round(ngram_score, 6).alias("ngram_cosine"))


#: Score that a name may reach by its most frequent features alone, for these to be left out at first.
SKIP = 0.25
_MARGIN = 2e-6  # scores are rounded to six decimals


def _pair_sums(a: DataFrame, b: DataFrame, scopes: list[str], *more: Column) -> DataFrame:
    """(lid, rid, dot, shared, norms, words, r_words) over the features of a and b, with the given aggregates."""
    b = b.select("rid", *[F.col(s).alias(f"r_{s}") for s in scopes], F.col("norm").alias("r_norm"), F.col("words").alias("r_words"), F.col("feature").alias("r_feature"), F.col("n").alias("r_n"))
    condition = F.col("feature") == F.col("r_feature")
    for s in scopes:
        condition = condition & F.col(s).eqNullSafe(F.col(f"r_{s}"))
    is_word = F.col("feature").startswith("\x01")
    sums = a.join(b, condition).groupBy("lid", "rid").agg(F.sum(F.when(is_word, 0).otherwise(F.col("n") * F.col("r_n"))).alias("dot"), F.sum(is_word.cast("int")).alias("shared"), F.max(F.col("norm") * F.col("r_norm")).alias("norms"), F.max(F.shiftleft(F.col("words").cast("long"), 32) + F.col("r_words")).alias("both"), *more)
    return sums.withColumns({"words": F.shiftright("both", 32), "r_words": F.col("both").bitwiseAND(F.lit((1 << 32) - 1))}).drop("both")


def _scored(sums: DataFrame) -> DataFrame:
    token_score, ngram_score = jaccard(F.col("shared"), F.col("words"), F.col("r_words")), cosine(F.col("dot"), F.col("norms"))
    return sums.select("lid", "rid", F.round(combined(token_score, ngram_score), 6).alias("score"), F.round(token_score, 6).alias("token_jaccard"), F.round(ngram_score, 6).alias("ngram_cosine"))


def top_pairs(left: DataFrame, right: DataFrame, row_left: str, row_right: str, scopes: list[str], k: int) -> DataFrame:
    """For each row of left its k most similar rows of right with a similarity above zero: score, token_jaccard, ngram_cosine.

    Ties go to the smaller row_right, which has to grow with canonical. Names are compared once, however many rows have
    them. The most frequent features of a name, as many as can't reach SKIP together, make no pairs at first; bounds on
    what they add tell which pairs can be among the k best, and only these are scored in full. A name whose k-th score
    isn't above SKIP then meets all names that share any feature, so that the result is that of all pairs. Without scopes
    nearly all names share one, so blocks of both sides are searched instead (search.py), with the same result.
    """
    names = materialize(left.select(*scopes, "canonical").distinct().withColumn("lid", F.monotonically_increasing_id()))
    others = materialize(right.groupBy(*scopes, "canonical").agg(F.min(row_right).alias("first")).withColumn("rid", F.monotonically_increasing_id()))
    sums = _sums_of_best(names, others, scopes, k) if scopes else searched(names, others, k)
    best = Window.partitionBy("lid").orderBy(F.desc("score"), "first")
    scored = _scored(sums).join(others.select("rid", "first"), "rid").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
    same = lambda x, y: reduce(Column.__and__, [x[s].eqNullSafe(y[s]) for s in scopes], x["canonical"] == y["canonical"])
    rows_l, rows_r = left.select(row_left, *scopes, "canonical"), right.select(row_right, *scopes, "canonical")
    rows_l = rows_l.join(names, same(rows_l, names)).select(row_left, "lid")
    rows_r = rows_r.join(others, same(rows_r, others)).select(row_right, "rid").withColumn("m", F.row_number().over(Window.partitionBy("rid").orderBy(row_right))).where(F.col("m") <= k)
    of_rows = scored.drop("n").join(rows_r.drop("m"), "rid").withColumn("n", F.row_number().over(Window.partitionBy("lid").orderBy(F.desc("score"), row_right))).where(F.col("n") <= k)
    return rows_l.join(of_rows, "lid").select(row_left, row_right, "score", "token_jaccard", "ngram_cosine")


def _sums_of_best(names: DataFrame, others: DataFrame, scopes: list[str], k: int) -> DataFrame:
    """The sums of each name (lid, scopes, canonical) with those others (rid, ..) that can be among its k best."""
    b = materialize(postings(others, "rid", scopes))
    spread = b.groupBy(*[F.col(s).alias(f"d_{s}") for s in scopes], F.col("feature").alias("d_feature")).agg(F.count("*").alias("df"))
    a = postings(names, "lid", scopes)
    condition = a["feature"] == spread["d_feature"]
    for s in scopes:
        condition = condition & a[s].eqNullSafe(spread[f"d_{s}"])
    frequent_first = Window.partitionBy("lid").orderBy(F.desc("df"), "feature")
    word = F.col("feature").startswith("\x01")
    a = a.join(spread, condition).withColumns({"sq": F.sum(F.when(word, 0).otherwise(F.col("n") * F.col("n"))).over(frequent_first), "cw": F.sum(word.cast("int")).over(frequent_first)})
    reach = F.when(F.col("feature") == "\x02", 1.0).otherwise(combined(F.col("cw") / F.col("words"), F.sqrt(F.col("sq").cast("double")) / F.col("norm")))
    a = a.withColumn("skipped", reach <= SKIP)
    whole = Window.partitionBy("lid")
    a = a.withColumns({"skip_cos": F.coalesce(F.max(F.when(F.col("skipped"), F.sqrt(F.col("sq").cast("double")) / F.col("norm"))).over(whole), F.lit(0.0)), "skip_words": F.coalesce(F.max(F.when(F.col("skipped"), F.col("cw"))).over(whole), F.lit(0))})
    a = materialize(a.select("lid", *scopes, "norm", "words", "feature", "n", "skipped", "skip_cos", "skip_words"))

    part = _pair_sums(a.where("NOT skipped"), b, scopes, F.max("skip_cos").alias("skip_cos"), F.max("skip_words").alias("skip_words"))
    cos, most_shared = cosine(F.col("dot"), F.col("norms")), F.least(F.col("shared") + F.col("skip_words"), "words", "r_words")
    part = part.select("lid", "rid", combined(jaccard(F.col("shared"), F.col("words"), F.col("r_words")), cos).alias("low"), combined(jaccard(most_shared, F.col("words"), F.col("r_words")), cos + F.col("skip_cos")).alias("high"))
    part = part.withColumn("n", F.row_number().over(whole.orderBy(F.desc("low")))).withColumn("kth", F.max(F.when(F.col("n") == k, F.col("low"))).over(whole))
    part = materialize(part.where((F.col("n") <= k) | (F.col("high") >= F.col("kth") - _MARGIN)).select("lid", "rid", F.coalesce(F.col("kth") > SKIP + _MARGIN, F.lit(False)).alias("done")))
    done = part.where("done").select("lid", "rid")
    features = b.select("rid", "norm", "words", "feature", "n")
    exact = _pair_sums_of(done, a, features)
    rest = _pair_sums(a.join(done.select("lid").distinct(), "lid", "left_anti"), b, scopes)
    return exact.unionByName(rest)


def _pair_sums_of(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """The sums of given pairs (lid, rid) over all their features."""
    word = F.col("feature").startswith("\x01")
    b = b.select("rid", F.col("norm").alias("r_norm"), F.col("words").alias("r_words"), F.col("feature").alias("r_feature"), F.col("n").alias("r_n"))
    wide = pairs.join(a.select("lid", "norm", "words", "feature", "n"), "lid").join(b, (pairs["rid"] == b["rid"]) & (F.col("feature") == F.col("r_feature"))).select("lid", pairs["rid"], "norm", "words", "feature", "n", "r_norm", "r_words", "r_n")
    return wide.groupBy("lid", "rid").agg(F.sum(F.when(word, 0).otherwise(F.col("n") * F.col("r_n"))).alias("dot"), F.sum(word.cast("int")).alias("shared"), F.max(F.col("norm") * F.col("r_norm")).alias("norms"), F.max("words").cast("long").alias("words"), F.max("r_words").cast("long").alias("r_words"))


def first_places(k: int, ranked: DataFrame) -> Column:
    """The places 0, 1, .. of the first k rows of a frame with dense places, as an array."""
    return F.array(*map(F.lit, range(min(k, ranked.count())))).cast("array<bigint>")


def shortlist(frame_from: DataFrame, frame_to: DataFrame, spec: Spec) -> DataFrame:
    """Columns from_ord, from_key, to_key, to_name, to_canonical, score, token_jaccard, ngram_cosine, rank (from 1).

    Higher rounded score first, then canonical name, then key as a string. A scope without to-rows has no candidates;
    two empty names are equal; null scopes match null scopes. Without a scope all rows are one.
    """
    scopes, k = scope_columns(spec), spec.max_candidates
    ranked_to = with_position(frame_to, ["canonical", "key"], "place")
    pairs = materialize(top_pairs(frame_from, ranked_to, "ord", "place", scopes, k))
    best = Window.partitionBy("ord").orderBy(F.desc("score"), "place")
    top = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    full = top.groupBy("ord").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("ord")
    short = frame_from.select("ord", *scopes).join(full, "ord", "left_anti")
    if scopes:
        in_scope = ranked_to.select("place", *scopes).withColumn("_n", F.row_number().over(Window.partitionBy(*scopes).orderBy("place"))).where(F.col("_n") <= k)
        zero = short.join(in_scope, same_scope(short, in_scope, spec)).select("ord", "place")
    else:  # the first names of all are the first places
        zero = short.select("ord", F.explode(first_places(k, ranked_to)).alias("place"))
    zero = zero.join(top.select("ord", "place"), ["ord", "place"], "left_anti").select("ord", "place", *[F.lit(0.0).alias(c) for c in ("score", "token_jaccard", "ngram_cosine")])
    both = top.drop("rank").unionByName(zero).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    named = both.join(ranked_to.select("place", F.col("key").alias("to_key"), F.col("name").alias("to_name"), F.col("canonical").alias("to_canonical")), "place")
    return named.join(frame_from.select("ord", F.col("key").alias("from_key")), "ord").select(F.col("ord").alias("from_ord"), "from_key", "to_key", "to_name", "to_canonical", "score", "token_jaccard", "ngram_cosine", "rank")
