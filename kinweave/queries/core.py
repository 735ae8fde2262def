"""Queries over the operators of the linking run, on the part table split by parity of its key, and on the unit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.names import canonical, tokens, trigrams
from kinweave.operators import adjudicate as A
from kinweave.operators import crosswalk as C
from kinweave.operators import rescue as R
from kinweave.operators.exact import exact_matches, prune
from kinweave.operators.prepare import work_frame
from kinweave.operators.shortlist import shortlist, similar_pairs
from kinweave.plans.identity import row_hashes
from kinweave.plans.pipeline import preview_groups
from kinweave.plans.spec import Spec
from kinweave.plans.validate import collapse_report, scopes_overlap
from kinweave.session import materialize

#: Brands that are on one side only, so that either has units of its own; of all others even keys are the earlier side.
ONLY_FROM, ONLY_TO = ("Brand#11", "Brand#12"), ("Brand#13",)


def _spec(mode: str = "from") -> Spec:
    return Spec("Partland", 2001, 2011, "name", exact_match=("brand",), id_col_from="id", id_col_to="id", string_exact_match_prune=mode, order_from=("id",), order_to=("id",))


def part_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    part = spark.read.parquet(f"{folder}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("name"))
    earlier = F.when(F.col("brand").isin(*ONLY_FROM), True).when(F.col("brand").isin(*ONLY_TO), False).otherwise(F.col("id") % 2 == 0)
    return part.where(earlier), part.where(~earlier)


def _frames(spark: SparkSession, folder: str, spec: Spec) -> tuple[DataFrame, DataFrame]:
    df_from, df_to = part_sides(spark, folder)
    return materialize(work_frame(df_from, "from", spec)), materialize(work_frame(df_to, "to", spec))


def canonical_names(spark: SparkSession, folder: str) -> DataFrame:
    names = spark.read.parquet(f"{folder}/supplier.parquet").select(F.col("s_name").alias("name")).union(spark.read.parquet(f"{folder}/customer.parquet").select("c_name"))
    return names.select("name", canonical(F.col("name")).alias("canonical"))


def _part_names(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", canonical(F.col("p_name")).alias("canonical"))


def name_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _part_names(spark, folder).select("p_partkey", F.explode(tokens(F.col("canonical"))).alias("token"))


def char_trigrams(spark: SparkSession, folder: str) -> DataFrame:
    return _part_names(spark, folder).select("p_partkey", F.explode(trigrams(F.col("canonical"))).alias("gram")).groupBy("p_partkey", "gram").agg(F.count("*").alias("n"))


def collapse_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return work_frame(part_sides(spark, folder)[0], "from", _spec()).select(F.col("key").alias("from_key"), "id", "name", "canonical", F.col("s0").alias("scope"))


def collapse_report_row(spark: SparkSession, folder: str) -> DataFrame:
    report = collapse_report(part_sides(spark, folder)[0], "from", _spec())
    return spark.createDataFrame([(report["input_rows"], report["effective_rows"], report["collapsed_rows"])], "input_rows long, effective_rows long, collapsed_rows long")


def scope_overlap(spark: SparkSession, folder: str) -> DataFrame:
    spec = Spec("World", 1, 2, "name", exact_match=("nation",))
    left = spark.read.parquet(f"{folder}/customer.parquet").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    right = spark.read.parquet(f"{folder}/supplier.parquet").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return spark.createDataFrame([(scopes_overlap(left, right, spec),)], "overlap boolean")


def exact_pairs(spark: SparkSession, folder: str) -> DataFrame:
    spec = _spec()
    return exact_matches(*_frames(spark, folder, spec), spec)


def _pruned(spark: SparkSession, folder: str, mode: str) -> DataFrame:
    spec = _spec(mode)
    f, t = _frames(spark, folder, spec)
    rest_from, rest_to = prune(f, t, exact_matches(f, t, spec), spec)
    return rest_from.select(F.lit("from").alias("side"), "key").union(rest_to.select(F.lit("to"), "key"))


def prune_from(spark: SparkSession, folder: str) -> DataFrame:
    return _pruned(spark, folder, "from")


def prune_to(spark: SparkSession, folder: str) -> DataFrame:
    return _pruned(spark, folder, "to")


def pair_similarity(spark: SparkSession, folder: str) -> DataFrame:
    f, t = _frames(spark, folder, _spec())
    return similar_pairs(f, t.withColumnRenamed("ord", "place"), "ord", "place", ["s0"]).select(F.col("ord").alias("from_ord"), F.col("place").alias("to_ord"), "score", "token_jaccard", "ngram_cosine")


def shortlist_topk(spark: SparkSession, folder: str) -> DataFrame:
    spec = _spec("none")
    return shortlist(*_frames(spark, folder, spec), spec).select("from_key", "to_key", "score", "token_jaccard", "ngram_cosine", F.col("rank").cast("long").alias("place"))


def global_shortlist(spark: SparkSession, folder: str) -> DataFrame:
    spec = Spec("World", 1, 2, "name", max_candidates=3, order_from=("id",), order_to=("id",))
    left = spark.read.parquet(f"{folder}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    right = spark.read.parquet(f"{folder}/region.parquet").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    found = shortlist(materialize(work_frame(left, "from", spec)), materialize(work_frame(right, "to", spec)), spec)
    return found.select("from_key", "to_key", "score", F.col("rank").cast("long").alias("place"))


def open_frames(spark: SparkSession, folder: str, spec: Spec) -> tuple[DataFrame, ...]:
    f, t = _frames(spark, folder, spec)
    exact = materialize(exact_matches(f, t, spec))
    rest_from, rest_to = prune(f, t, exact, spec)
    return f, t, exact, rest_from, materialize(shortlist(rest_from, rest_to, spec))


def preview_scopes(spark: SparkSession, folder: str) -> DataFrame:
    spec = _spec()
    f, t = _frames(spark, folder, spec)
    return preview_groups(prune(f, t, exact_matches(f, t, spec), spec)[0], spec).withColumnRenamed("s0", "scope")


def preview_summary(spark: SparkSession, folder: str) -> DataFrame:
    _, _, exact, rest, candidates = open_frames(spark, folder, _spec())
    per_row = rest.join(candidates.groupBy("from_key").agg(F.count("*").alias("n")), F.col("key") == F.col("from_key"), "left").agg(F.count("*").alias("from_rows"), F.round(F.avg(F.coalesce("n", F.lit(0))), 4).alias("avg_candidates"))
    return per_row.withColumn("exact_string_matches", F.lit(exact.count()).cast("long"))


def rule_based_decisions(spark: SparkSession, folder: str) -> DataFrame:
    spec = _spec()
    _, _, _, rest, candidates = open_frames(spark, folder, spec)
    return A.rule_decisions(rest, candidates, spec).select("from_key", F.inline("links")).select("from_key", "to_key", "link_type", "relationship", "score")


def whole_crosswalk(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, Spec]:
    spec = _spec()
    f, t, exact, rest, candidates = open_frames(spark, folder, spec)
    decisions = A.exact_decisions(exact, spec).unionByName(A.rule_decisions(rest, candidates, spec))
    return materialize(C.crosswalk_rows(f, t, materialize(decisions), candidates, spec, "run")), f, t, spec


_ROW = ("from_name", "to_name", "from_id", "to_id", "score", "link_type", "relationship", "merge", "from_key", "to_key", "brand")


def crosswalk(spark: SparkSession, folder: str) -> DataFrame:
    return whole_crosswalk(spark, folder)[0].select(*_ROW)


def review_flags(spark: SparkSession, folder: str) -> DataFrame:
    return C.with_flags(whole_crosswalk(spark, folder)[0]).select("from_key", "to_key", "review_reason")


def review_queue(spark: SparkSession, folder: str) -> DataFrame:
    return C.review_queue(C.with_flags(whole_crosswalk(spark, folder)[0])).select("from_name", "score", "from_key", "to_key", "review_reason")


def coverage(spark: SparkSession, folder: str) -> DataFrame:
    return C.coverage(whole_crosswalk(spark, folder)[0], ["brand"])


def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    return C.summary(whole_crosswalk(spark, folder)[0])


def _rescue(spark: SparkSession, folder: str) -> tuple:
    rows, f, t, spec = whole_crosswalk(spark, folder)
    items = materialize(R.pending(rows, "from").withColumn("lineage_hint", F.split("primary_name", " ")[0]))
    return rows, f, t, spec, items, materialize(R.global_shortlist(items, t, spec))


def rescue_shortlist(spark: SparkSession, folder: str) -> DataFrame:
    return _rescue(spark, folder)[-1].select("primary_key", "secondary_key", "score", "matched_term", F.col("rank").cast("long").alias("place"))


def rescue_crosswalk(spark: SparkSession, folder: str) -> DataFrame:
    rows, f, t, spec, items, ranked = _rescue(spark, folder)
    return R.rewrite(rows, R.hinted_decisions(items, ranked, spec), ranked, f, t, spec, "from", "run").select(*_ROW, "lineage_hint")


def latest_decisions(spark: SparkSession, folder: str) -> DataFrame:
    log = spark.read.parquet(f"{folder}/decision_log.parquet")
    return C.latest_per_key(log, ["from_key", "status"], ["logged_at", "seq"], ["seq", "link_type", "error"])


def failed_keys(spark: SparkSession, folder: str) -> DataFrame:
    return C.still_failed(spark.read.parquet(f"{folder}/decision_log.parquet"))


def fingerprint_rows(spark: SparkSession, folder: str) -> DataFrame:
    return row_hashes(spark.read.parquet(f"{folder}/region.parquet"), ["r_name", "r_regionkey"]).select(F.col("h").alias("row_hash"))


def units_shortlist(spark: SparkSession, folder: str) -> DataFrame:
    """The whole unit tables, by state and district, dirty and non-ASCII names included."""
    spec = Spec("Velmaria", 2001, 2011, "subdistrict", exact_match=("state", "district"), order_from=("ord",), order_to=("ord",))
    f, t = (materialize(work_frame(spark.read.parquet(f"{folder}/{s}_units.parquet"), s, spec)) for s in ("from", "to"))
    return shortlist(f, t, spec)


def _units_run(spark: SparkSession, folder: str) -> tuple:
    """Exact matches, shortlist, rules and crosswalk over the whole unit tables."""
    spec = Spec("Velmaria", 2001, 2011, "subdistrict", exact_match=("state", "district"), string_exact_match_prune="from", order_from=("ord",), order_to=("ord",), id_col_from="unit_id", id_col_to="unit_id")
    f, t = (materialize(work_frame(spark.read.parquet(f"{folder}/{s}_units.parquet"), s, spec)) for s in ("from", "to"))
    exact = materialize(exact_matches(f, t, spec))
    rest_from, rest_to = prune(f, t, exact, spec)
    candidates = materialize(shortlist(rest_from, rest_to, spec))
    decisions = materialize(A.exact_decisions(exact, spec).unionByName(A.rule_decisions(rest_from, candidates, spec)))
    return materialize(C.crosswalk_rows(f, t, decisions, candidates, spec, "run")), f, t, spec


def units_crosswalk(spark: SparkSession, folder: str) -> DataFrame:
    return _units_run(spark, folder)[0].select("from_key", "to_key", "from_name", "to_name", "score", "link_type", "merge", "state", "district")


def units_rescue(spark: SparkSession, folder: str) -> DataFrame:
    """The crosswalk after every unmatched unit was searched for in the whole other table by its name and its first word."""
    rows, f, t, spec = _units_run(spark, folder)
    items = materialize(R.pending(rows, "from").withColumn("lineage_hint", F.split("primary_name", " ")[0]))
    ranked = materialize(R.global_shortlist(items, t, spec))
    return R.rewrite(rows, R.hinted_decisions(items, ranked, spec), ranked, f, t, spec, "from", "run").select("from_key", "to_key", "from_name", "to_name", "score", "link_type", "merge", "lineage_hint")


def units_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Flags of the given crosswalk, whose few keys hold most rows."""
    return C.with_flags(spark.read.parquet(f"{folder}/crosswalk.parquet").drop("review_flags", "review_reason")).select("ord", "review_reason")


def units_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return C.coverage(spark.read.parquet(f"{folder}/crosswalk.parquet"), ["state", "district"])


QUERIES = {
    f.__name__: f
    for f in (
        canonical_names, name_tokens, char_trigrams, collapse_duplicates, collapse_report_row, scope_overlap, exact_pairs, prune_from, prune_to, pair_similarity, shortlist_topk, global_shortlist, preview_scopes, preview_summary,
        rule_based_decisions, crosswalk, review_flags, review_queue, coverage, run_summary, rescue_shortlist, rescue_crosswalk, latest_decisions, failed_keys, fingerprint_rows, units_shortlist, units_crosswalk, units_rescue, units_flags, units_coverage,
    )
}

CN = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


_EARLIER = f"CASE WHEN p_brand IN ({', '.join(map(repr, ONLY_FROM))}) THEN true WHEN p_brand IN ({', '.join(map(repr, ONLY_TO))}) THEN false ELSE p_partkey % 2 = 0 END"


def _side(side: str, earlier: str) -> str:
    return f"""
      {side}_all AS (SELECT p_partkey AS id, p_brand AS brand, p_name || ' ' || lower(p_type) AS name, {CN.format("p_name || ' ' || lower(p_type)")} AS cn, {CN.format('p_brand')} AS scope
                     FROM part WHERE {earlier}),
      {side}_one AS (SELECT * FROM {side}_all QUALIFY row_number() OVER (PARTITION BY scope, cn ORDER BY id) = 1),
      {side} AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS ord, '{dict(f='from', t='to')[side]}_' || (row_number() OVER (ORDER BY id) - 1) AS key FROM {side}_one)"""


_BASE = f"""
    WITH {_side("f", _EARLIER)}, {_side("t", f"NOT ({_EARLIER})")},
      exact AS (SELECT f.key AS from_key, x.key AS to_key FROM f JOIN (SELECT scope, cn, arg_max(key, ord) AS key FROM t GROUP BY ALL) x ON f.scope = x.scope AND f.cn = x.cn)"""


def similar(names: str, x: str = "") -> str:
    """CTEs sim(a, b, tok, gram, score) of all pairs of names (cn), with x at the end of their names."""
    return f"""
      nm{x} AS ({names}),
      tk{x} AS (SELECT DISTINCT cn, unnest(string_split(cn, ' ')) AS tok FROM nm{x}), ntk{x} AS (SELECT cn, count(*) AS n FROM tk{x} GROUP BY cn),
      gr0{x} AS (SELECT cn, unnest(list_transform(range(1, len(cn) + 2), lambda i: substr('  ' || cn || ' ', i, 3))) AS gram FROM nm{x}),
      gr{x} AS (SELECT cn, gram, count(*) AS n FROM gr0{x} GROUP BY ALL), norm{x} AS (SELECT cn, sqrt(sum(n * n)::double) AS v FROM gr{x} GROUP BY cn),
      dots{x} AS (SELECT a.cn AS a, b.cn AS b, sum(a.n * b.n)::double AS dot FROM gr{x} a JOIN gr{x} b ON a.gram = b.gram GROUP BY ALL),
      inter{x} AS (SELECT a.cn AS a, b.cn AS b, count(*)::double AS k FROM tk{x} a JOIN tk{x} b ON a.tok = b.tok GROUP BY ALL),
      parts{x} AS (SELECT x.cn AS a, y.cn AS b, coalesce(i.k, 0) / (p.n + q.n - coalesce(i.k, 0)) AS tok, coalesce(d.dot, 0) / (u.v * w.v) AS gram
                   FROM nm{x} x CROSS JOIN nm{x} y JOIN ntk{x} p ON p.cn = x.cn JOIN ntk{x} q ON q.cn = y.cn JOIN norm{x} u ON u.cn = x.cn JOIN norm{x} w ON w.cn = y.cn
                   LEFT JOIN dots{x} d ON d.a = x.cn AND d.b = y.cn LEFT JOIN inter{x} i ON i.a = x.cn AND i.b = y.cn),
      sim{x} AS (SELECT a, b, round(tok, 6) AS tok, round(gram, 6) AS gram, round(greatest(0, least(1, 0.55::double * tok + 0.45::double * gram)), 6) AS score FROM parts{x})"""


_NAMES = similar("SELECT cn FROM f UNION SELECT cn FROM t")
_RANKED = """
      ranked AS (SELECT x.key AS from_key, x.ord AS from_ord, t.key AS to_key, t.ord AS to_ord, score, tok, gram, row_number() OVER (PARTITION BY x.key ORDER BY score DESC, t.cn, t.key) AS place
                 FROM {0} x JOIN t ON x.scope = t.scope JOIN sim ON sim.a = x.cn AND sim.b = t.cn QUALIFY place <= 6)"""
OPEN = f"{_BASE}, {_NAMES}, rest AS (SELECT * FROM f WHERE key NOT IN (SELECT from_key FROM exact)), {_RANKED.format('rest')}"
_DECIDED = f"""{OPEN},
      top AS (SELECT from_key, arg_min(to_key, place) AS to_key, arg_min(score, place) AS score, count(*) AS n FROM ranked GROUP BY from_key),
      decided AS (SELECT rest.key AS from_key, top.to_key, CASE WHEN n IS NULL THEN 'no_match' WHEN n > 1 AND score < 0.5 THEN 'unknown' ELSE 'rename' END AS link_type,
                         CASE WHEN n IS NULL THEN 'unknown' ELSE 'father_to_father' END AS relationship,
                         CASE WHEN n IS NULL THEN 0.0::double WHEN n > 1 AND score < 0.5 THEN greatest(score, 0.4::double) ELSE greatest(score, 0.9::double) END AS score
                  FROM rest LEFT JOIN top ON top.from_key = rest.key)"""
ROWS = f"""{_DECIDED},
      link AS (SELECT * FROM decided UNION ALL SELECT from_key, to_key, 'rename', 'father_to_father', 1.0::double FROM exact),
      linked AS (SELECT f.name AS from_name, t.name AS to_name, f.id::varchar AS from_id, t.id::varchar AS to_id, link.score, link_type,
                        CASE WHEN link.to_key IS NOT NULL AND link_type = 'rename' THEN relationship ELSE 'unknown' END AS relationship,
                        CASE WHEN link.to_key IS NOT NULL AND link_type = 'rename' THEN 'both' ELSE 'only_in_from' END AS merge, link.from_key, link.to_key, f.brand
                 FROM link JOIN f ON f.key = link.from_key LEFT JOIN t ON t.key = link.to_key),
      crosswalk_rows AS (SELECT * FROM linked UNION ALL
                         SELECT NULL, name, NULL, id::varchar, 0.0::double, 'unknown', 'unknown', 'only_in_to', NULL, key, brand FROM t WHERE key NOT IN (SELECT to_key FROM linked WHERE merge = 'both'))"""
FLAGGED = """, pairs AS (SELECT DISTINCT from_key, to_key FROM {0} WHERE merge = 'both' AND from_key IS NOT NULL AND to_key IS NOT NULL),
      fan_out AS (SELECT from_key FROM pairs GROUP BY 1 HAVING count(*) > 3), fan_in AS (SELECT to_key FROM pairs GROUP BY 1 HAVING count(*) > 3),
      flagged AS (SELECT *, concat_ws(',', CASE WHEN score < 0.6 THEN 'low_score' END, CASE WHEN link_type IN ('unknown', 'no_match') THEN 'type_needs_review' END,
                         CASE WHEN from_key IN (SELECT from_key FROM fan_out) THEN 'high_fan_out' END, CASE WHEN to_key IN (SELECT to_key FROM fan_in) THEN 'high_fan_in' END) AS review_reason FROM {0})"""
_COVERAGE = "SELECT {0}, count(DISTINCT from_key) AS from_units, count(DISTINCT from_key) FILTER (to_key IS NOT NULL AND link_type IN ('rename', 'split', 'merge', 'transfer')) AS matched_from_units, count(DISTINCT from_key) - count(DISTINCT from_key) FILTER (to_key IS NOT NULL AND link_type IN ('rename', 'split', 'merge', 'transfer')) AS unmatched_from_units FROM {1} GROUP BY {0}"
_RESCUE = f"""{ROWS},
      pend AS (SELECT DISTINCT from_key AS primary_key, from_name AS primary_name, split_part(from_name, ' ', 1) AS hint FROM crosswalk_rows WHERE merge = 'only_in_from'),
      term AS (SELECT primary_key, 0 AS no, primary_name AS term, {CN.format('primary_name')} AS tcn FROM pend UNION ALL SELECT primary_key, 1, hint, {CN.format('hint')} FROM pend),
      {similar("SELECT tcn AS cn FROM term UNION SELECT cn FROM t", "2")},
      best AS (SELECT primary_key, t.key AS secondary_key, t.cn AS scn, max(score) AS score, arg_min(term, no) FILTER (score = top) AS matched_term
               FROM (SELECT primary_key, no, term, tcn, b, score, max(score) OVER (PARTITION BY primary_key, b) AS top FROM term JOIN sim2 ON sim2.a = tcn) z JOIN t ON t.cn = z.b GROUP BY ALL),
      rescue AS (SELECT primary_key, secondary_key, score, CASE WHEN score > 0 THEN matched_term ELSE '' END AS matched_term, row_number() OVER (PARTITION BY primary_key ORDER BY score DESC, scn, secondary_key) AS place FROM best QUALIFY place <= 6)"""

ORACLE = {
    "canonical_names": f"SELECT name, {CN.format('name')} AS canonical FROM (SELECT s_name AS name FROM supplier UNION ALL SELECT c_name FROM customer)",
    "name_tokens": f"SELECT DISTINCT p_partkey, unnest(string_split({CN.format('p_name')}, ' ')) AS token FROM part",
    "char_trigrams": f"SELECT p_partkey, gram, count(*) AS n FROM (SELECT p_partkey, unnest(list_transform(range(1, len(c) + 2), lambda i: substr('  ' || c || ' ', i, 3))) AS gram FROM (SELECT p_partkey, {CN.format('p_name')} AS c FROM part)) GROUP BY ALL",
    "collapse_duplicates": f"{_BASE} SELECT key AS from_key, id::varchar AS id, name, cn AS canonical, scope FROM f",
    "collapse_report_row": f"{_BASE} SELECT (SELECT count(*) FROM f_all) AS input_rows, (SELECT count(*) FROM f) AS effective_rows, (SELECT count(*) FROM f_all) - (SELECT count(*) FROM f) AS collapsed_rows",
    "scope_overlap": "SELECT EXISTS (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) AS overlap",
    "exact_pairs": f"{_BASE} SELECT from_key, to_key FROM exact",
    "prune_from": f"{_BASE} SELECT 'from' AS side, key FROM f WHERE key NOT IN (SELECT from_key FROM exact) UNION ALL SELECT 'to', key FROM t",
    "prune_to": f"{_BASE} SELECT 'from' AS side, key FROM f WHERE key NOT IN (SELECT from_key FROM exact) UNION ALL SELECT 'to', key FROM t WHERE key NOT IN (SELECT to_key FROM exact)",
    "pair_similarity": f"{_BASE}, {_NAMES} SELECT f.ord AS from_ord, t.ord AS to_ord, score, tok AS token_jaccard, gram AS ngram_cosine FROM f JOIN t ON f.scope = t.scope JOIN sim ON sim.a = f.cn AND sim.b = t.cn WHERE gram > 0",
    "shortlist_topk": f"{_BASE}, {_NAMES}, {_RANKED.format('f')} SELECT from_key, to_key, score, tok AS token_jaccard, gram AS ngram_cosine, place FROM ranked",
    "global_shortlist": f"""
        WITH f AS (SELECT 'from_' || (row_number() OVER (ORDER BY n_nationkey) - 1) AS key, {CN.format('n_name')} AS cn FROM nation), t AS (SELECT 'to_' || (row_number() OVER (ORDER BY r_regionkey) - 1) AS key, {CN.format('r_name')} AS cn FROM region), {_NAMES}
        SELECT f.key AS from_key, t.key AS to_key, score, row_number() OVER (PARTITION BY f.key ORDER BY score DESC, t.cn, t.key) AS place FROM f CROSS JOIN t JOIN sim ON sim.a = f.cn AND sim.b = t.cn QUALIFY place <= 3""",
    "preview_scopes": f"{_BASE} SELECT scope, count(*) AS rows FROM f WHERE key NOT IN (SELECT from_key FROM exact) GROUP BY scope",
    "preview_summary": f"{OPEN} SELECT (SELECT count(*) FROM rest) AS from_rows, round((SELECT count(*) FROM ranked) / (SELECT count(*) FROM rest), 4) AS avg_candidates, (SELECT count(*) FROM exact) AS exact_string_matches",
    "rule_based_decisions": f"{_DECIDED} SELECT * FROM decided",
    "crosswalk": f"{ROWS} SELECT * FROM crosswalk_rows",
    "review_flags": f"{ROWS} {FLAGGED.format('crosswalk_rows')} SELECT from_key, to_key, review_reason FROM flagged",
    "review_queue": f"{ROWS} {FLAGGED.format('crosswalk_rows')} SELECT from_name, score, from_key, to_key, review_reason FROM flagged WHERE review_reason <> ''",
    "coverage": f"{ROWS} {_COVERAGE.format('brand', 'crosswalk_rows')}",
    "run_summary": f"{ROWS} SELECT count(*) AS rows, count(DISTINCT from_key) AS from_units, count(DISTINCT to_key) AS to_units, round(avg(score), 6) AS avg_score FROM crosswalk_rows",
    "rescue_shortlist": f"{_RESCUE} SELECT primary_key, secondary_key, score, matched_term, place FROM rescue",
    "rescue_crosswalk": f"""{_RESCUE},
        won AS (SELECT primary_key, secondary_key, score, hint FROM rescue JOIN pend USING (primary_key) WHERE place = 1 AND score >= 0.5 AND hint <> ''),
        kept AS (SELECT c.*, CASE WHEN merge = 'only_in_from' THEN coalesce((SELECT hint FROM pend WHERE primary_key = from_key), '') ELSE '' END AS lineage_hint FROM crosswalk_rows c
                 WHERE NOT (merge = 'only_in_from' AND from_key IN (SELECT primary_key FROM won)) AND NOT (merge = 'only_in_to' AND to_key IN (SELECT secondary_key FROM won))
                   AND NOT EXISTS (SELECT 1 FROM won WHERE primary_key = from_key AND secondary_key = to_key))
        SELECT * FROM kept UNION ALL SELECT f.name, t.name, f.id::varchar, t.id::varchar, won.score, 'rename', 'father_to_father', 'both', f.key, t.key, f.brand, hint FROM won JOIN f ON f.key = primary_key JOIN t ON t.key = secondary_key""",
    "latest_decisions": "SELECT from_key, status, arg_max(seq, (logged_at, seq)) AS seq, first(link_type ORDER BY logged_at DESC, seq DESC) AS link_type, first(error ORDER BY logged_at DESC, seq DESC) AS error FROM decision_log WHERE from_key IS NOT NULL AND status IS NOT NULL GROUP BY from_key, status",
    "failed_keys": "SELECT DISTINCT from_key FROM decision_log WHERE status = 'error' AND from_key IS NOT NULL AND from_key NOT IN (SELECT from_key FROM decision_log WHERE status = 'ok' AND from_key IS NOT NULL)",
    "fingerprint_rows": """SELECT sha256('{"r_name":"' || r_name || '","r_regionkey":"' || r_regionkey || '"}') AS row_hash FROM region""",
    "units_flags": f"WITH x AS (SELECT 1) {FLAGGED.format('(SELECT * EXCLUDE (review_flags, review_reason) FROM crosswalk)')} SELECT ord, review_reason FROM flagged",
    "units_coverage": _COVERAGE.format("state, district", "crosswalk"),
}
