"""Freely typed values mapped to the closest entry of a reference list, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kinweave.llm.names import closing_words, parsed, probing_segments, reference_segments
from kinweave.session import materialize

#: Edits (insert, delete, replace a letter) that the stem of a typed name may be away from its entry's.
MAX_EDITS = 2


def matching_sql(k: int = MAX_EDITS) -> str:
    """Columns typed_name, canon_id over {name} and {entry}, both parsed: the entry meant, for names that have one."""
    return f"""
    WITH piece AS ({reference_segments("(SELECT * FROM {entry} WHERE stem <> '')", "stem", k)}),
    probe AS ({probing_segments("(SELECT * FROM {name} WHERE stem <> '')", "stem", k)}),
    pair AS (
      SELECT DISTINCT p.typed_name, e.canon_id, e.unit_name, levenshtein(p.stem, e.stem, {k}) AS edits
      FROM probe p JOIN piece e ON p._n = e._n AND p._i = e._i AND p._seg = e._seg
      WHERE levenshtein(p.stem, e.stem, {k}) BETWEEN 0 AND length(e.stem) DIV 3 AND p.nums = e.nums
        AND CASE WHEN size(e.dirs) = 0 THEN size(p.dirs) = 0 ELSE array_contains(p.dirs, e.dirs[0]) END)
    SELECT typed_name, min_by(canon_id, struct(edits, levenshtein(lower(typed_name), lower(unit_name)), canon_id)) AS canon_id
    FROM pair GROUP BY typed_name
    """


REPORT_SQL = """
    SELECT t.ord, b.canon_id FROM {typed} t JOIN {best} b ON t.typed_name = b.typed_name
    UNION ALL
    SELECT t.ord, CAST(0 AS BIGINT) AS canon_id FROM {typed} t LEFT ANTI JOIN {best} b ON t.typed_name = b.typed_name
"""


def map_to_entries(typed: DataFrame, entries: DataFrame, *, k: int = MAX_EDITS) -> DataFrame:
    """Columns ord, canon_id: each row of typed(ord, typed_name) with the entry of entries(canon_id, unit_name) meant.

    0 reports that no entry is within k edits of stem, at most one for three of its letters, with the same closing word
    and numbers; so do null and empty names. Names may be in any script; closing words are those of the list itself.
    Among entries equally near the one whose spelling, accents included, is nearest counts, then the smaller id.
    Repeated names are compared once; an empty list leaves all names unmatched; other columns don't matter. Work grows
    with names times the entries that share a segment of equal place and length, never with names times entries.
    """
    sql = typed.sparkSession.sql
    typed = materialize(typed.select("ord", "typed_name"))
    entries = entries.select("canon_id", "unit_name")
    closing = closing_words(entries, "unit_name")
    name = materialize(sql(parsed("(SELECT DISTINCT typed_name FROM {typed} WHERE typed_name IS NOT NULL)", "typed_name", closing), typed=typed))
    entry = materialize(sql(parsed("{entries}", "unit_name", closing, shortened=False), entries=entries))
    best = materialize(sql(matching_sql(k), name=name, entry=entry))
    return sql(REPORT_SQL, typed=typed, best=best)


def typed_names(crosswalk: DataFrame) -> DataFrame:
    """Rows of the crosswalk whose typed name has to be mapped, as (ord, typed_name)."""
    return crosswalk.sparkSession.sql(
        r"SELECT ord, from_name AS typed_name FROM {crosswalk} WHERE merge = 'only_in_from' AND to_canonical_name IS NULL AND from_name RLIKE '(?U)\\S'", crosswalk=crosswalk
    )
