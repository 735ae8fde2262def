"""Queries over whole runs and their parts: adjudication with failures, resuming, replay, the second stage, files, identity."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import api
from kinweave.operators import adjudicate as A
from kinweave.operators import crosswalk as C
from kinweave.operators import rescue as R
from kinweave.operators.prepare import work_frame
from kinweave.operators.service import normal_link
from kinweave.plans.identity import fingerprint, row_hashes, run_id, slug, stable_hash
from kinweave.plans.spec import MATCHED_TYPES, Spec
from kinweave.plans.store import DecisionLog
from kinweave.queries import core
from kinweave.session import materialize, shared_folder
from kinweave.sources.files import export_crosswalk, read_jsonl, read_table, write_table

FATE = 7


def _number(key: str) -> int:
    return int(key.rpartition("_")[2])


class Scripted:
    """An adjudicator whose answers depend on a unit's number only: it breaks at some, leaves out, invents and splits others."""

    def decide(self, items, spec):
        out = []
        for item in items:
            key, listed = item["from_key"], [c["to_key"] for c in item["candidates"]]
            fate = _number(key) % FATE
            link = lambda k, kind="rename", score=0.9, why="": {"to_key": k, "link_type": kind, "relationship": "father_to_child", "score": score, "evidence": f" {key} ", "reason": why}
            if not listed:
                out.append({"from_key": key, "links": []})
            elif fate == 0:
                raise RuntimeError(f"no answer for {key}")
            elif fate == 1:
                out.append({"from_key": key, "links": [link("to_none")]})
            elif fate == 2:
                continue
            elif fate == 3:
                out.append({"from_key": key, "links": []})
            elif fate == 4:
                out.append({"from_key": key, "links": [link(k, "split", 0.55, "two parts") for k in listed[:2]], "notes": "n" * 5000})
            elif fate == 5:
                out.append({"from_key": key, "links": [link(listed[0], "unknown", 0.3)]})
            else:
                out.append({"from_key": key, "links": [link(listed[0])]})
        return out

    def research(self, item, spec):
        n = _number(item["primary_key"])
        if n % 11 == 0:
            raise RuntimeError("nothing found")
        return {"event_type": "split" if n % 3 else "unknown", "lineage_hint": "", "notes": f"note {n}"}

    def choose(self, item, research, candidates, spec):
        keys = [c["secondary_key"] for c in candidates]
        return {"selected_secondary_keys": [keys[-1], "to_none", keys[0], keys[-1]], "link_type": "split", "relationship": "father_to_child", "score": 0.7, "evidence": research["notes"], "reason": ""}


def _spec(**more) -> Spec:
    return Spec(**({"country": "Partland", "year_from": 2001, "year_to": 2011, "map_col_from": "name", "exact_match": ("brand",), "id_col_from": "id", "id_col_to": "id", "string_exact_match_prune": "from", "order_from": ("id",), "order_to": ("id",), "extra_context_cols": ("id",), "batch_size": 3, "evidence": True, "reason": True} | more))


def _adjudicated(spark: SparkSession, folder: str) -> tuple:
    spec = _spec()
    f, t, exact, rest, candidates = core.open_frames(spark, folder, spec)
    items = materialize(A.batch_items(rest, candidates, t, spec))
    decisions = materialize(A.exact_decisions(exact, spec).unionByName(A.python_decisions(items, Scripted(), spec)))
    return f, t, spec, items, candidates, decisions


def adjudication_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batches in input order, and the number of candidates that go with each row."""
    return _adjudicated(spark, folder)[3].select("batch", "place", "from_key", F.size("candidates").alias("candidates"), F.get_json_object("item", "$.exact_match_context.brand").alias("brand"), F.get_json_object("item", "$.extra_context.id").alias("id"))


def adjudicated_crosswalk(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a run whose adjudicator fails, leaves out, invents and splits: every branch of a link."""
    f, t, spec, _, candidates, decisions = _adjudicated(spark, folder)
    rows = C.crosswalk_rows(f, t, decisions, candidates, spec, "run")
    passed = lambda k: F.col("constraints_passed").getItem(k)
    return rows.select("from_key", "to_key", "score", "link_type", "relationship", "merge", F.when(F.col("evidence").isin(A.NO_SHORTLIST, A.NO_LINK), "none").otherwise(F.col("evidence")).alias("evidence"), "reason", "country", "year_from", "year_to", passed("candidate_membership").alias("listed"), passed("exact_match").alias("same_scope"), passed("target_only_row").alias("target_only"))


def failed_adjudications(spark: SparkSession, folder: str) -> DataFrame:
    return C.still_failed(_adjudicated(spark, folder)[5])


def grounding_notes(spark: SparkSession, folder: str) -> DataFrame:
    _, _, _, items, _, decisions = _adjudicated(spark, folder)
    notes = A.notes_of(items, decisions, "")
    return notes.select("from_key", "status", F.length("notes").cast("long").alias("note_chars"), F.size("candidate_keys").alias("candidates"), "error")


def cached_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each row is answered by what was asked before with the same content, or has to be asked again."""
    _, _, spec, items, _, decisions = _adjudicated(spark, folder)
    cache = materialize(A.new_answers(items, decisions.where(F.substring_index("from_key", "_", -1).cast("long") % 2 == 0), spec))
    hits, rest = A.known_answers(items, cache, spec)
    return hits.select("from_key", F.lit("cache").alias("source")).unionByName(rest.select("from_key", F.lit("ask").alias("source")))


def resumed_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """A log after a run that broke off and one that went on: whose record counts, and in which run it was made."""
    f, _, spec, _, _, decisions = _adjudicated(spark, folder)
    log = DecisionLog(spark, f"{shared_folder(spark)}/resume-{uuid.uuid4().hex}", "run", "decisions", A.DECISION)
    number = F.substring_index("from_key", "_", -1).cast("long")
    log.append(decisions.where(number % 2 == 0).withColumn("logged_at", F.lit("1")))
    done = log.done("from_key", ["logged_at", "batch"])
    again = f.select(F.col("key").alias("from_key")).join(done, "from_key", "left_anti")
    second = again.select("from_key", F.lit("ai").alias("match_stage"), F.lit("ok").alias("status"), F.array().cast(f"array<{A.LINK}>").alias("links"), F.lit(None).cast("string").alias("error"), F.lit("2").alias("batch"), F.lit("2").alias("logged_at"), F.lit(None).cast("string").alias("notes"))
    whole = log.append(second)
    return C.latest_per_key(whole, ["from_key"], ["logged_at", "batch"], ["status", "logged_at"]).select("from_key", "status", F.col("logged_at").alias("run"))


def rescue_choices(spark: SparkSession, folder: str) -> DataFrame:
    """Second stage by an adjudicator: what it selects is cut down to the shortlist, failures stay records."""
    rows, f, t, spec = core.whole_crosswalk(spark, folder)
    items = materialize(R.described(R.pending(rows, "from").withColumns({"lineage_hint": F.lit("")}), f, spec))
    found = materialize(items.drop("lineage_hint").join(R.researched(items, Scripted(), spec, callers=4), "primary_key"))
    ranked = materialize(R.global_shortlist(found.where("error IS NULL AND event_type <> 'unknown'"), t, spec))
    chosen = R.chosen(found, ranked, t, Scripted(), spec, callers=4)
    return chosen.select("primary_key", "status", "event_type", "link_type", "score", F.coalesce(F.get("selected", F.lit(0)), F.lit("")).alias("first_key"), F.size("selected").alias("selected"), "evidence", F.coalesce("error", F.lit("")).alias("error"))


def _options(mode: str = "from") -> dict:
    return {"country": "Partland", "year_from": 2001, "year_to": 2011, "map_col_from": "name", "exact_match": ["brand"], "id_col_from": "id", "id_col_to": "id", "string_exact_match_prune": mode, "order_from": ["id"], "order_to": ["id"]}


def replayed_run(spark: SparkSession, folder: str) -> DataFrame:
    """The crosswalk of a whole run, taken from the store that the run before filled; files and folders are URLs."""
    base = shared_folder(spark)
    base = f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/run-{uuid.uuid4().hex}"
    sides = core.part_sides(spark, folder)
    first = api.build_evolution_key(*sides, **_options(), output_dir=f"{base}/a", replay_dir=f"{base}/store", write_csv=False)
    again, metadata = api.build_evolution_key(*sides, **_options(), output_dir=f"{base}/b", replay_dir=f"{base}/store")
    if not metadata["replay_hit"] or metadata["replayed_from_run_id"] != first[1]["run_id"]:
        raise ValueError("the second run didn't take over the first one's result")
    exported = export_crosswalk(spark, f"{base}/b/partland_2001_2011_name/evolution_key.parquet", "jsonl")
    kept = read_jsonl(spark, exported, again.select("from_key", "to_key", "merge", "score", "review_reason").schema)
    return kept.select("from_key", "to_key", "merge", "score", "review_reason")


def run_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts in a run's metadata, and what validation and preview say beforehand."""
    sides = core.part_sides(spark, folder)
    report, plan = api.validate_inputs(*sides, **_options()), api.preview_plan(*sides, **_options())
    base = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    counts = api.build_evolution_key(*sides, **_options(), output_dir=base, write_csv=False)[1]["counts"]
    row = (report["valid"], report["from_rows_input"], report["to_rows_effective"], plan["exact_string_matches"], plan["from_rows"], plan["avg_candidates"], counts["rows"], counts["error_from_rows"], counts["second_stage_attempted_rows"], counts["second_stage_rewritten_rows"])
    return spark.createDataFrame([row], "valid boolean, from_input long, to_effective long, exact long, from_open long, avg_candidates double, rows long, errors long, attempted long, rewritten long")


def file_formats(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers written as CSV and Parquet and read again, nulls and quotes included."""
    base = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    table = spark.read.parquet(f"{folder}/supplier.parquet").select("s_suppkey", F.concat(F.lit('a "b", '), "s_name").alias("s_name"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_nationkey")).alias("s_nationkey"))
    found = []
    for fmt in ("csv", "parquet"):
        write_table(table, f"{base}/t.{fmt}", fmt)
        back = read_table(spark, f"{base}/t.{fmt}")
        found.append(back.select(F.lit(fmt).alias("format"), F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("s_nationkey").cast("long").alias("s_nationkey")))
    return found[0].unionByName(found[1])


def order_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["o_orderkey", "o_custkey", "o_orderstatus"]
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    return spark.createDataFrame([(fingerprint(orders, columns), fingerprint(orders.limit(0), columns))], "whole string, none string")


def unit_row_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes of all rows of the earlier units by their dates, nulls included."""
    units = spark.read.parquet(f"{folder}/from_units.parquet").select("ord", F.date_format("recorded_at", "yyyy-MM-dd").alias("day"))
    return row_hashes(units, ["day", "missing", "ord"]).select(F.col("h").alias("row_hash"))


def identities(spark: SparkSession, folder: str) -> DataFrame:
    names = [r[0] for r in spark.read.parquet(f"{folder}/nation.parquet").select("n_name").collect()]
    return spark.createDataFrame([(n, slug(f" {n}/2001 "), stable_hash({"b": n, "a": 1}), run_id({"name": n}, 42)) for n in names], "n_name string, slug string, hash string, run_id string")


def link_spellings(spark: SparkSession, folder: str) -> DataFrame:
    """Link types of the crosswalk, loosely written, in their own spelling; null if there is none."""
    spec = Spec("X", 1, 2, "n")
    kinds = spark.read.parquet(f"{folder}/crosswalk.parquet").select("link_type").where("link_type IS NOT NULL").distinct()

    def spelled(kind: str) -> str | None:
        try:
            return normal_link({"to_key": "None", "link_type": kind, "relationship": "Father To-Child", "score": 1}, spec)["link_type"]
        except ValueError:
            return None

    return spark.createDataFrame([(r[0], spelled(r[0])) for r in kinds.collect()], "link_type string, spelled string")


def matched_types(spark: SparkSession, folder: str) -> DataFrame:
    """Which merge and relationship each kind of link gets."""
    spec = Spec("X", 1, 2, "n")
    rows = spark.read.parquet(f"{folder}/crosswalk.parquet").select("ord", "link_type", "to_key", "relationship")
    return rows.select("ord", C.merge_indicator(F.col("link_type"), F.col("to_key")).alias("merge"), C.final_relationship(F.col("relationship"), F.col("link_type"), F.col("to_key"), spec).alias("relationship"))


QUERIES = {
    f.__name__: f
    for f in (
        adjudication_batches, adjudicated_crosswalk, failed_adjudications, grounding_notes, cached_answers, resumed_decisions, rescue_choices, replayed_run, run_counts, file_formats, order_fingerprint, unit_row_hashes, identities, link_spellings, matched_types,
    )
}

_TYPES = ", ".join(f"'{t}'" for t in MATCHED_TYPES)
_PLACED = f"{core.OPEN}, placed AS (SELECT key, row_number() OVER (ORDER BY ord) - 1 AS place, ord % {FATE} AS fate FROM rest), listed AS (SELECT from_key, count(*) AS n FROM ranked GROUP BY from_key), asked AS (SELECT p.*, coalesce(n, 0) AS n FROM placed p LEFT JOIN listed ON from_key = key)"
_LINKS = f"""{_PLACED},
      link AS (
        SELECT from_key, to_key, 'rename' AS kind, 'father_to_father' AS rel, 1.0::double AS score, '{A.EXACT_TEXT}' AS evidence, '{A.EXACT_TEXT}' AS reason, true AS listed FROM exact
        UNION ALL SELECT key, NULL, 'unknown', 'unknown', 0, '{C.FAILED}no answer for ' || key, '', true FROM asked WHERE fate = 0 AND n > 0
        UNION ALL SELECT key, NULL, 'unknown', 'unknown', 0, '{C.OUTSIDE_EVIDENCE}', '{C.OUTSIDE_REASON}', false FROM asked WHERE fate = 1 AND n > 0
        UNION ALL SELECT key, NULL, 'unknown', 'unknown', 0, '{A.OMITTED}', '', true FROM asked WHERE fate = 2 AND n > 0
        UNION ALL SELECT key, NULL, 'no_match', 'unknown', 0, 'none', '', true FROM asked WHERE fate = 3 AND n > 0
        UNION ALL SELECT key, r.to_key, 'split', 'father_to_child', 0.55, key, 'two parts', true FROM asked JOIN ranked r ON r.from_key = key WHERE fate = 4 AND r.place <= 2
        UNION ALL SELECT key, r.to_key, 'unknown', 'unknown', 0.3, key, '', true FROM asked JOIN ranked r ON r.from_key = key WHERE fate = 5 AND r.place = 1
        UNION ALL SELECT key, r.to_key, 'rename', 'father_to_child', 0.9, key, '', true FROM asked JOIN ranked r ON r.from_key = key WHERE fate = 6 AND r.place = 1)"""

ORACLE = {
    "adjudication_batches": f"{_PLACED} SELECT (place // 3)::bigint AS batch, place, a.key AS from_key, n::int AS candidates, f.brand, f.id::varchar AS id FROM asked a JOIN f ON f.key = a.key",
    "failed_adjudications": f"{_PLACED} SELECT key AS from_key FROM asked WHERE fate = 0 AND n > 0",
    "matched_types": f"SELECT ord, CASE WHEN to_key IS NOT NULL AND link_type IN ({_TYPES}) THEN 'both' ELSE 'only_in_from' END AS merge, CASE WHEN to_key IS NULL OR link_type IS NULL OR link_type NOT IN ({_TYPES}) THEN 'unknown' WHEN relationship IN ('father_to_father', 'father_to_child', 'child_to_father', 'child_to_child') THEN relationship ELSE 'unknown' END AS relationship FROM crosswalk",
    "link_spellings": "SELECT link_type, CASE WHEN k IN ('rename', 'split', 'merge', 'transfer', 'no_match', 'unknown') THEN k WHEN k = 'exact_match' THEN 'rename' END AS spelled FROM (SELECT DISTINCT link_type, replace(replace(lower(regexp_replace(link_type, '^\\s+|\\s+$', '', 'g')), '-', '_'), ' ', '_') AS k FROM crosswalk WHERE link_type IS NOT NULL)",
    "identities": """SELECT n_name, regexp_replace(regexp_replace(lower(' ' || n_name || '/2001 '), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, sha256('{"a": 1, "b": "' || n_name || '"}') AS hash, sha256('{"request": {"name": "' || n_name || '"}, "seed": 42}')[1:16] AS run_id FROM nation""",
    "unit_row_hashes": """SELECT sha256('{"day":' || coalesce('"' || strftime(recorded_at, '%Y-%m-%d') || '"', 'null') || ',"missing":null,"ord":"' || ord || '"}') AS row_hash FROM from_units""",
    "order_fingerprint": """
        WITH h AS (SELECT sha256('{"o_orderkey":"' || o_orderkey || '","o_custkey":"' || o_custkey || '","o_orderstatus":"' || o_orderstatus || '"}') AS h FROM orders),
        w AS (SELECT count(*) AS n, sum(('0x' || h[1:15])::ubigint::hugeint) AS a, sum(('0x' || h[16:30])::ubigint::hugeint) AS b, sum(('0x' || h[31:45])::ubigint::hugeint) AS c, sum(('0x' || h[46:60])::ubigint::hugeint) AS d FROM h)
        SELECT sha256('{"columns": ["o_orderkey", "o_custkey", "o_orderstatus"], "rows": ' || n || ', "words": ["' || a || '", "' || b || '", "' || c || '", "' || d || '"]}') AS whole,
               sha256('{"columns": ["o_orderkey", "o_custkey", "o_orderstatus"], "rows": 0, "words": ["None", "None", "None", "None"]}') AS none FROM w""",
    "file_formats": """SELECT format, s_suppkey, 'a "b", ' || s_name AS s_name, CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey END AS s_nationkey FROM supplier CROSS JOIN (VALUES ('csv'), ('parquet')) x(format)""",
    "adjudicated_crosswalk": f"""{_LINKS},
        linked AS (SELECT l.from_key, l.to_key, l.score, l.kind AS link_type, CASE WHEN l.to_key IS NOT NULL AND l.kind IN ({_TYPES}) THEN rel ELSE 'unknown' END AS relationship, CASE WHEN l.to_key IS NOT NULL AND l.kind IN ({_TYPES}) THEN 'both' ELSE 'only_in_from' END AS merge,
                          evidence, reason, listed, true AS same_scope, NULL::boolean AS target_only FROM link l),
        nothing AS (SELECT key AS from_key, NULL AS to_key, 0.0::double AS score, 'no_match' AS link_type, 'unknown' AS relationship, 'only_in_from' AS merge, 'none' AS evidence, '' AS reason, true AS listed, true AS same_scope, NULL::boolean AS target_only FROM asked WHERE n = 0),
        whole AS (SELECT * FROM linked UNION ALL SELECT * FROM nothing UNION ALL SELECT NULL, key, 0.0::double, 'unknown', 'unknown', 'only_in_to', '{C.TARGET_EVIDENCE}', '{C.TARGET_REASON}', NULL, NULL, true FROM t WHERE key NOT IN (SELECT to_key FROM linked WHERE merge = 'both'))
        SELECT from_key, to_key, score, link_type, relationship, merge, evidence, reason, 'Partland' AS country, '2001' AS year_from, '2011' AS year_to, listed, same_scope, target_only FROM whole""",
    "grounding_notes": f"{_PLACED} SELECT key AS from_key, CASE WHEN n = 0 THEN 'skipped' WHEN fate = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN fate = 4 AND n > 0 THEN 4000 ELSE 0 END::bigint AS note_chars, n::int AS candidates, CASE WHEN fate = 0 AND n > 0 THEN 'no answer for ' || key ELSE '' END AS error FROM asked",
    "cached_answers": f"{_PLACED} SELECT a.key AS from_key, CASE WHEN f.ord % 2 = 0 AND NOT (fate = 0 AND n > 0) THEN 'cache' ELSE 'ask' END AS source FROM asked a JOIN f ON f.key = a.key",
    "resumed_decisions": f"{_PLACED} SELECT f.key AS from_key, 'ok' AS status, CASE WHEN f.ord % 2 = 0 AND (f.key NOT IN (SELECT key FROM asked WHERE fate = 0 AND n > 0)) THEN '1' ELSE '2' END AS run FROM f",
    "run_counts": f"""{core.ROWS}
        SELECT true AS valid, (SELECT count(*) FROM f_all) AS from_input, (SELECT count(*) FROM t) AS to_effective, (SELECT count(*) FROM exact) AS exact, (SELECT count(*) FROM rest) AS from_open, round((SELECT count(*) FROM ranked) / (SELECT count(*) FROM rest), 4) AS avg_candidates,
               (SELECT count(*) FROM crosswalk_rows) AS rows, 0 AS errors, (SELECT count(DISTINCT from_key) FROM crosswalk_rows WHERE merge = 'only_in_from') AS attempted, 0 AS rewritten""",
    "replayed_run": f"{core.ROWS} {core.FLAGGED.format('crosswalk_rows')} SELECT from_key, to_key, merge, score, review_reason FROM flagged",
    "rescue_choices": f"""{core.ROWS},
        pend AS (SELECT DISTINCT from_key AS primary_key, from_name AS primary_name, split_part(from_key, '_', 2)::bigint AS n FROM crosswalk_rows WHERE merge = 'only_in_from'),
        term AS (SELECT primary_key, {core.CN.format('primary_name')} AS tcn FROM pend),
        {core.similar("SELECT tcn AS cn FROM term UNION SELECT cn FROM t", "2")},
        best AS (SELECT primary_key, t.key AS k, row_number() OVER (PARTITION BY primary_key ORDER BY score DESC, t.cn, t.key) AS place FROM term JOIN sim2 ON sim2.a = tcn JOIN t ON t.cn = sim2.b QUALIFY place <= 6),
        ends AS (SELECT primary_key, arg_max(k, place) AS last, count(*) AS c FROM best GROUP BY primary_key)
        SELECT p.primary_key, CASE WHEN n % 11 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN n % 11 = 0 OR n % 3 = 0 THEN 'unknown' ELSE 'split' END AS event_type,
               CASE WHEN n % 11 = 0 OR n % 3 = 0 THEN 'no_match' ELSE 'split' END AS link_type, CASE WHEN n % 11 = 0 OR n % 3 = 0 THEN 0.0::double ELSE 0.7::double END AS score, CASE WHEN n % 11 = 0 OR n % 3 = 0 THEN '' ELSE last END AS first_key,
               CASE WHEN n % 11 = 0 OR n % 3 = 0 THEN 0 ELSE least(c, 2) END::int AS selected, CASE WHEN n % 11 = 0 OR n % 3 = 0 THEN '' ELSE 'note ' || n END AS evidence, CASE WHEN n % 11 = 0 THEN 'nothing found' ELSE '' END AS error
        FROM pend p JOIN ends e ON e.primary_key = p.primary_key""",
}
