"""The queries of this subpackage: each takes (spark, folder of the tables) and runs over its whole tables."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import canonical, components, duplicates, linkage, mixture, names, tokens, topn, truncation, visual


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return components.link_groups(components.linking_rows(_table(spark, folder, "crosswalk")), "from_key", "to_key")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.map_to_entries(canonical.typed_names(_table(spark, folder, "crosswalk")), _table(spark, folder, "canonical_units"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    entries, crosswalk, units = (_table(spark, folder, t) for t in ("canonical_units", "crosswalk", "to_units"))

    def case(field: str, table: DataFrame, entry: str) -> DataFrame:
        return visual.same_look(table.select(F.lit(field).alias("field"), "ord", F.col(field).alias("value")), "value", entries, entry, "canon_id").select("field", "ord", "canon_id")

    return case("subdistrict", units, "unit_name").unionByName(case("from_name", crosswalk, "unit_name")).unionByName(case("from_canonical_name", crosswalk, "canonical_name"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.find_copies(_table(spark, folder, "to_units"), "ord", ["subdistrict"], ["state", "district"])


def p4_copies(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.collapse(_table(spark, folder, "to_units"), "ord", ["subdistrict"], ["state", "district"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return topn.top_n(_table(spark, folder, "crosswalk"), "from_key", "to_key", "score", 6).select("from_key", "to_key")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _linked(spark, folder).select("ord", "to_ord")


def p7_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return _linked(spark, folder)


def _linked(spark: SparkSession, folder: str) -> DataFrame:
    units = _table(spark, folder, "to_units").select("ord", F.col("subdistrict").alias("name"), "state", "district")
    return linkage.link(linkage.lost_rows(_table(spark, folder, "crosswalk")), units)[0]


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(_table(spark, folder, "documents"), "doc_id", "text")


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mix(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets"))[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mix(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets"))[1]


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.find_cut(_table(spark, folder, "documents"), "doc_id", "text", "title").where("cut").select("doc_id")


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    return truncation.cut_shares(documents, truncation.find_cut(documents, "doc_id", "text", "title"), "doc_id", "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p2_found, p3_found, p4_found, p4_copies, p5_found, p7_found, p7_confidence, p8_ids, p9_mixture, p9_shares, p10_found, p10_shares)
    return {f.__name__: f for f in own}


def _typed_names_sql() -> str:
    """Every typed name held against every entry, plainly: what the pigeonhole join has to find."""
    text = lambda t: "'" + t.replace("'", "''") + "'"
    f, t = visual.folding()
    other = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    folded = lambda c: f"translate(replace(lower(translate({c}, {text(f)}, {text(t)})), 'ⅱ', 'ii'), {text(''.join(other))}, '{''.join(str(unicodedata.decimal(x)) for x in other)}')"
    kind = names.KIND.replace("\\\\", "\\")
    numeral = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in names.NUMERALS.items())

    def parsed(source: str, column: str) -> str:
        return f"""
            SELECT *, list_filter(w, lambda x: NOT regexp_full_match(x, '[0-9]+')) AS ws, list_filter(w, lambda x: regexp_full_match(x, '[0-9]+')) AS nums
            FROM (SELECT *, list_transform(CASE WHEN a[1] = 'the' THEN a[2:] ELSE a END, lambda x: CASE x {numeral} ELSE x END) AS w
                  FROM (SELECT *, list_filter(regexp_split_to_array(regexp_replace({folded(column)}, '{kind}', ' ', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: x <> '') AS a FROM {source}))"""

    stem = f"array_to_string(list_transform(rest, lambda x: translate(x, '{names.DIGITS}', '{names.LETTERS}')), '')"
    pick = """SELECT *, CASE WHEN len(l) > 0 THEN l ELSE f END AS dirs, CASE WHEN len(l) > 0 THEN ws[1:len(ws) - 1] WHEN len(f) > 0 THEN ws[2:] ELSE ws END AS rest"""
    short = "regexp_full_match({0}, d[1] || regexp_replace(d[2:], '(.)', '\\1?', 'g'))"

    def meant(word: str) -> str:
        some = lambda that: f"coalesce((SELECT list(d) FROM closing WHERE {that}), [])"
        exact, begun, near = some(f"d = {word}"), some(short.format(word)), some(f"length({word}) >= 3 AND levenshtein({word}, d) <= 1")
        return f"CASE WHEN len(ws) < 2 THEN [] WHEN len({exact}) > 0 THEN {exact} WHEN len({begun}) > 0 THEN {begun} ELSE {near} END"

    same = lambda word: f"CASE WHEN len(ws) < 2 THEN [] ELSE coalesce((SELECT list(d) FROM closing WHERE d = {word}), []) END"
    return f"""
        WITH entry0 AS ({parsed("canonical_units", "unit_name")}),
        name AS (SELECT DISTINCT CASE WHEN len(ws) > 1 THEN ws[-1] END AS last, array_to_string(CASE WHEN len(ws) > 1 THEN ws[1:len(ws) - 1] ELSE ws END, '') AS stem FROM (SELECT DISTINCT ws FROM entry0 WHERE len(ws) > 0)),
        several AS (SELECT stem FROM name GROUP BY stem HAVING count(*) > 1),
        closing AS (SELECT last AS d FROM name WHERE regexp_full_match(last, '\\p{{L}}+') GROUP BY last HAVING count(*) >= {names.CLOSING_SHARE} * (SELECT count(last) FROM name) AND (count(*) > 1 OR bool_or(stem IN (SELECT stem FROM several)))),
        entry AS (SELECT canon_id, unit_name, nums, dirs, {stem} AS stem FROM ({pick} FROM (SELECT *, {same("ws[-1]")} AS l, {same("ws[1]")} AS f FROM entry0))),
        typed AS (SELECT ord, from_name AS typed_name FROM crosswalk WHERE merge = 'only_in_from' AND to_canonical_name IS NULL AND regexp_matches(from_name, '[^\\s\\p{{Z}}]')),
        typed0 AS ({parsed("(SELECT DISTINCT typed_name FROM typed)", "typed_name")}),
        spelled AS (SELECT typed_name, nums, dirs, {stem} AS stem FROM ({pick} FROM (SELECT *, {meant("ws[-1]")} AS l, {meant("ws[1]")} AS f FROM typed0))),
        best AS (SELECT p.typed_name, arg_min(e.canon_id, (levenshtein(p.stem, e.stem), levenshtein(lower(p.typed_name), lower(e.unit_name)), e.canon_id)) AS canon_id
                 FROM spelled p JOIN entry e ON p.nums = e.nums AND CASE WHEN len(e.dirs) = 0 THEN len(p.dirs) = 0 ELSE list_contains(p.dirs, e.dirs[1]) END
                 WHERE p.stem <> '' AND e.stem <> '' AND levenshtein(p.stem, e.stem) <= least({canonical.MAX_EDITS}, length(e.stem) // 3) GROUP BY p.typed_name)
        SELECT t.ord, coalesce(b.canon_id, 0) AS canon_id FROM typed t LEFT JOIN best b ON b.typed_name = t.typed_name"""


def _same_look_sql() -> str:
    """Look-alikes by a table of single characters and by composing what remains, joined plainly."""
    text = lambda t: "'" + t.replace("'", "''") + "'"
    rewrite = visual.transducer()
    forms = {c: rewrite(c) for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) <= 0xDFFF and rewrite(c) != c}
    one, gone, several = ({c: t for c, t in forms.items() if keep(len(t))} for keep in (lambda n: n == 1, lambda n: n == 0, lambda n: n > 1))
    table = f"map([{', '.join(map(text, several))}], [{', '.join(map(text, several.values()))}])"

    def form(v: str) -> str:
        plain = f"translate({v}, {text(''.join([*one, *gone]))}, {text(''.join(one.values()))})"
        long = f"array_to_string(list_transform(string_split({plain}, ''), lambda c: coalesce({table}[c], c)), '')"
        return f"trim(regexp_replace(nfc_normalize(CASE WHEN regexp_matches({plain}, '[{''.join(several)}]') THEN {long} ELSE {plain} END), '\\s+', ' ', 'g'))"

    fields = (("subdistrict", "to_units", "unit_name"), ("from_name", "crosswalk", "unit_name"), ("from_canonical_name", "crosswalk", "canonical_name"))
    return " UNION ALL ".join(
        f"""SELECT '{field}' AS field, ord, e.canon_id FROM {source} v
            JOIN (SELECT DISTINCT {field} AS v, {form(field)} AS form FROM {source} WHERE regexp_matches({field}, '[^\\x00-\\x7F]')) d ON d.v = v.{field}
            JOIN (SELECT form, arg_min({entry}, canon_id) AS entry, min(canon_id) AS canon_id FROM (SELECT *, {form(entry)} AS form FROM canonical_units) GROUP BY form) e ON e.form = d.form
            WHERE trim(regexp_replace(v.{field}, '[ \\t\\r\\n]+', ' ', 'g')) <> e.entry"""
        for field, source, entry in fields
    )


def oracle_sql() -> dict[str, str]:
    form = lambda c: f"lower(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
    records = f"""
        WITH form AS (SELECT ord, {form('state')} AS s, {form('district')} AS d, {form('subdistrict')} AS u FROM to_units),
        record AS (SELECT ord, u, CASE WHEN s IS NULL OR d IS NULL THEN coalesce(s, d) ELSE least(s, d) END AS a,
                          CASE WHEN s IS NULL OR d IS NULL THEN NULL ELSE greatest(s, d) END AS b FROM form)"""
    return {
        "p1_found": r"""
            WITH RECURSIVE row AS (SELECT DISTINCT from_key AS a, to_key AS b FROM crosswalk WHERE from_key IS NOT NULL AND to_key IS NOT NULL AND lower(regexp_replace(link_type, '^\s+|\s+$', '', 'g')) IN ('rename', 'split', 'merge', 'transfer')),
            tie AS (SELECT a, b FROM row UNION SELECT b, a FROM row),
            reach AS (SELECT a AS k, a AS r FROM tie UNION SELECT reach.k, tie.b FROM reach JOIN tie ON tie.a = reach.r)
            SELECT k AS unit_key, min(r) AS group_id FROM reach GROUP BY k""",
        "p2_found": _typed_names_sql(),
        "p3_found": _same_look_sql(),
        "p4_found": f"{records}, first AS (SELECT ord, min(ord) OVER (PARTITION BY a, b, u) AS keep_ord FROM record) SELECT keep_ord, ord AS copy_ord FROM first WHERE ord <> keep_ord",
        "p4_copies": f"{records} SELECT min(ord) AS keep_ord, count(*) AS copies FROM record GROUP BY a, b, u",
        "p5_found": """
            SELECT from_key, to_key FROM (
              SELECT from_key, to_key, max(score) AS score FROM crosswalk
              WHERE from_key IS NOT NULL AND to_key IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY from_key, to_key)
            QUALIFY row_number() OVER (PARTITION BY from_key ORDER BY score DESC, to_key) <= 6""",
    }
