"""Columns for names: one canonical form, tokens, trigrams, and their similarities. All of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN_WEIGHT, NGRAM_WEIGHT = 0.55, 0.45


def nfkc(text: Column) -> Column:
    """Unicode NFKC by the ICU library that comes with Spark; null is the empty string.

    ASCII text is its own NFKC, so only other text pays for the reflected call. Spark takes that for non-deterministic,
    so it belongs into a select, not into a join or grouping.
    """
    given = F.coalesce(text, F.lit(""))
    return F.when(given.rlike(r"[^\x00-\x7F]"), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), given, F.lit(True))).otherwise(given)


def canonical(text: Column, *, compose: bool = True) -> Column:
    """NFKC, small letters, everything but letters, digits and underscore as single spaces, none at the ends.

    Combining marks separate, since they are no letters. compose=False leaves NFKC out, for text known to be ASCII.
    """
    return F.trim(F.regexp_replace(F.lower(nfkc(text) if compose else F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def match_value(df: DataFrame, column: str, *, compose: bool = True) -> Column:
    """A column as key: strings in canonical form, other types as they are, null stays null."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return F.when(F.col(column).isNotNull(), canonical(F.col(column), compose=compose))
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return F.nanvl(F.col(column), F.lit(None).cast(df.schema[column].dataType))
    return F.col(column)


def tokens(name: Column) -> Column:
    """The distinct words of a canonical name; none of the empty one."""
    return F.array_distinct(F.filter(F.split(name, " "), lambda t: t != ""))


def trigrams(name: Column) -> Column:
    """All trigrams of a canonical name padded with two spaces before and one after; none of the empty one."""
    padded = F.concat(F.lit("  "), name, F.lit(" "))
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def jaccard(shared: Column, left: Column, right: Column) -> Column:
    """Of set sizes: 1 if both are empty, 0 if one is."""
    return F.when((left == 0) & (right == 0), 1.0).when((left == 0) | (right == 0), 0.0).otherwise(shared / (left + right - shared))


def cosine(dot: Column, norms: Column) -> Column:
    """Of two vectors that share something, or are both empty (norms, the product of their lengths, is 0 then: 1)."""
    return F.when(norms == 0, 1.0).otherwise(dot / norms)


def combined(token_score: Column, ngram_score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(TOKEN_WEIGHT) * token_score + F.lit(NGRAM_WEIGHT) * ngram_score))
