"""Names as stem, closing word and numbers, in SQL expressions; and the positional segments of a pigeonhole join.

The words that tell units of one stem apart (closing words) and their short forms come from the list of names itself:
words that end a share of its names. Typed names may have such a word first or last, shortened or misspelled.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import DataFrame

from kinweave.llm.visual import folding

#: Share of all names of several words that a closing word ends; so there are at most 200 of them.
CLOSING_SHARE = 0.005
# Small numbers as they are written in names.
NUMERALS = {
    "ii": "2", "2nd": "2", "two": "2", "second": "2", "iii": "3", "3rd": "3", "three": "3", "third": "3", "iv": "4", "4th": "4", "four": "4", "fourth": "4", "five": "5", "5th": "5", "fifth": "5",
    "vi": "6", "six": "6", "6th": "6", "sixth": "6", "vii": "7", "seven": "7", "7th": "7", "seventh": "7", "viii": "8", "eight": "8", "8th": "8", "eighth": "8", "ix": "9", "nine": "9", "9th": "9", "ninth": "9",
}
# Words for the kind of unit, that aren't part of its name.
KIND = r"\\b(sub[- ]?district|sub[- ]?dist|s/d|district|dist)\\b"
# Digits typed or read in a letter's place.
DIGITS, LETTERS = "014569", "olasbg"
# The characters of words, in any script.
LETTERS_OF_WORDS = r"\\p{{L}}\\p{{M}}\\p{{N}}"


def _text(s: str) -> str:
    """A literal for spark.sql with arguments, where braces are doubled."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("{", "{{").replace("}", "}}") + "'"


def folded(column: str) -> str:
    """Small letters without accents; look-alikes, widths and invisible characters resolved."""
    f, t = folding()
    return f"replace(lower(translate({column}, {_text(f)}, {_text(t)})), 'ⅱ', 'ii')"


def _digits(column: str) -> str:
    """The column with decimal digits of all scripts as 0 to 9."""
    other = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    return f"translate({column}, {_text(''.join(other))}, '{''.join(str(unicodedata.decimal(c)) for c in other)}')"


def _words(column: str) -> str:
    """The words of a name, numerals as digits, without words for the kind of unit and a leading article."""
    split = f"filter(split(regexp_replace({_digits(folded(column))}, '{KIND}', ' '), '[^{LETTERS_OF_WORDS}]+'), x -> x <> '')"
    numbers = " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in NUMERALS.items())
    return f"transform(filter(coalesce({split}, array()), (x, i) -> NOT (i = 0 AND x = 'the')), x -> CASE x {numbers} ELSE x END)"


_NUMBER = "x RLIKE '^[0-9]+$'"


def with_words(source: str, column: str) -> str:
    """SELECT all columns of source and _a, the words of a name, for closing_words and parsed."""
    return f"SELECT *, {_words(column)} AS _a FROM {source}"


def closing_words(names: DataFrame, column: str) -> list[str]:
    """The words of letters that end a share of all names and occur with several stems, or with one that goes without
    them or with others too; in order. A list of any size has at most 200, so the driver can hold them. Names that have
    their words already (_a) aren't read again.
    """
    words = "_a" if "_a" in names.columns else _words(column)
    found = names.sparkSession.sql(
        f"""
        WITH word AS (SELECT DISTINCT filter(w, x -> NOT ({_NUMBER})) AS w FROM (SELECT {words} AS w FROM {{names}})),
        name AS (SELECT DISTINCT CASE WHEN size(w) > 1 THEN element_at(w, -1) END AS last, array_join(CASE WHEN size(w) > 1 THEN slice(w, 1, size(w) - 1) ELSE w END, '') AS stem FROM word WHERE size(w) > 0),
        several AS (SELECT stem FROM name GROUP BY stem HAVING count(*) > 1),
        ends AS (SELECT last, count(*) AS n, count(s.stem) AS shared FROM name LEFT JOIN several s ON name.stem = s.stem WHERE last RLIKE '^\\\\p{{{{L}}}}+$' GROUP BY last)
        SELECT last FROM ends WHERE n >= {CLOSING_SHARE} * (SELECT count(last) FROM name) AND (n > 1 OR shared > 0) ORDER BY last
        """,
        names=names,
    )
    return [r["last"] for r in found.collect()]


def _closing_of(word: str, closing: list[str], shortened: bool) -> str:
    """The closing words that a word can mean: itself; else those it shortens (their first letter and some others in
    order); else those within an edit.
    """
    listed = lambda words: f"array({', '.join(map(_text, words))})" if words else "CAST(array() AS ARRAY<STRING>)"
    if not closing:
        return listed([])
    exact = f"filter({listed(closing)}, d -> d = {word})"
    if not shortened:
        return f"CASE WHEN {word} IS NULL THEN {listed([])} ELSE {exact} END"
    by_first: dict[str, list[str]] = {}
    for d in closing:
        by_first.setdefault(d[0], []).append(d)
    one = lambda d: f"CASE WHEN {word} RLIKE '^{d[0]}{''.join(f'({x})?' for x in d[1:])}$' THEN {listed([d])} ELSE {listed([])} END"
    short = f"CASE substring({word}, 1, 1) " + " ".join(f"WHEN {_text(k)} THEN concat({', '.join(map(one, v))})" for k, v in by_first.items()) + f" ELSE {listed([])} END"
    near = f"filter({listed(closing)}, d -> length({word}) >= 3 AND levenshtein({word}, d, 1) >= 0)"
    return f"CASE WHEN {word} IS NULL THEN {listed([])} WHEN array_contains({listed(closing)}, {word}) THEN {exact} WHEN size({short}) > 0 THEN {short} ELSE {near} END"


def parsed(source: str, column: str | None, closing: list[str], *, shortened: bool = True) -> str:
    """SELECT all columns of source and stem, dirs, nums of a name; without a column of a source that has its words (_a).

    dirs holds the closing words its last or first word can mean (none, mostly one); nums the numbers in it. A null
    name has the stem of an empty one. Characters that are no letter, mark or number of any script part words.
    """
    return f"""
      SELECT * EXCEPT (_w, _n, _last, _first), array_join(transform(
               CASE WHEN size(_last) > 0 THEN slice(_w, 1, size(_w) - 1) WHEN size(_first) > 0 THEN slice(_w, 2, size(_w) - 1) ELSE _w END,
               x -> translate(x, '{DIGITS}', '{LETTERS}')), '') AS stem,
             CASE WHEN size(_last) > 0 THEN _last ELSE _first END AS dirs, _n AS nums
      FROM (SELECT *, {_closing_of("CASE WHEN size(_w) > 1 THEN _w[size(_w) - 1] END", closing, shortened)} AS _last, {_closing_of("CASE WHEN size(_w) > 1 THEN _w[0] END", closing, shortened)} AS _first
            FROM (SELECT * EXCEPT (_a), filter(_a, x -> {_NUMBER}) AS _n, filter(_a, x -> NOT ({_NUMBER})) AS _w
                  FROM ({with_words(source, column) if column else source})))"""


def _segment(n: str, i: str, k: int) -> tuple[str, str]:
    """Start (from 1) and length of segment i (from 0) of k + 1 in a string of length n; later segments are longer."""
    size, rest = f"({n} DIV {k + 1})", f"({n} % {k + 1})"
    return f"(1 + {i} * {size} + greatest(0, {i} - ({k + 1} - {rest})))", f"({size} + CASE WHEN {i} >= {k + 1} - {rest} THEN 1 ELSE 0 END)"


def reference_segments(source: str, column: str, k: int) -> str:
    """SELECT all columns of source and _n, _i, _seg: the k + 1 segments of each string, by its length and their index."""
    start, length = _segment(f"length({column})", "_i", k)
    return f"SELECT *, length({column}) AS _n, substring({column}, {start}, {length}) AS _seg FROM (SELECT *, explode(sequence(0, {k})) AS _i FROM {source})"


def probing_segments(source: str, column: str, k: int) -> str:
    """SELECT all columns of source and _n, _i, _shift, _seg: substrings that equal a segment of any string within k edits.

    Of strings within k edits at least one segment is unchanged, shifted by at most the edits before it and after it.
    """
    start, length = _segment("_n", "_i", k)
    delta = f"(length({column}) - _n)"
    low = f"greatest(-_i, {delta} - ({k} - _i))"
    high = f"least(_i, {delta} + ({k} - _i))"
    return f"""
      SELECT *, substring({column}, {start} + _shift, {length}) AS _seg
      FROM (SELECT *, explode(CASE WHEN {low} <= {high} THEN sequence({low}, {high}) ELSE array() END) AS _shift
            FROM (SELECT *, explode(sequence(0, {k})) AS _i
                  FROM (SELECT *, explode(sequence(greatest(0, length({column}) - {k}), length({column}) + {k})) AS _n FROM {source})))
      WHERE {start} + _shift >= 1 AND {start} + _shift + {length} - 1 <= length({column})"""


def first_shared(probe: str, reference: str, k: int) -> str:
    """Whether _i and _shift are those of the first segment that two strings share, so that of all rows of a pair that
    share a segment one is kept, without gathering them.
    """
    delta = f"(length({probe}) - length({reference}))"
    cases = []
    for i in range(k + 1):
        start, length = _segment(f"length({reference})", str(i), k)
        for shift in range(-i, i + 1):
            near = f"{shift} BETWEEN {delta} - {k - i} AND {delta} + {k - i} AND {start} + {shift} >= 1"
            cases.append(f"WHEN {near} AND substring({probe}, {start} + {shift}, {length}) = substring({reference}, {start}, {length}) THEN _i = {i} AND _shift = {shift}")
    return f"CASE {' '.join(cases)} ELSE false END"
