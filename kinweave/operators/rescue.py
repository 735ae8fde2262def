"""The second stage: unmatched units searched over the whole other table, and the crosswalk rewritten by what is found.

Research may give a hint (an earlier or later name). Own name and hint are search terms; the best of them scores a
unit of the other side. Decisions replace the unmatched rows of both sides in one set-based rewrite.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.names import canonical
from kinweave.operators.crosswalk import base_columns, final_relationship, first_per_key, merge_indicator
from kinweave.operators.order import with_position
from kinweave.operators.prepare import scope_columns
from kinweave.operators.shortlist import first_places, top_pairs
from kinweave.plans.spec import MATCHED_TYPES, Spec

DECISIONS = "primary_key string, status string, event_type string, lineage_hint string, notes string, selected array<string>, link_type string, relationship string, score double, evidence string, reason string, error string"


def primary_side(spec: Spec) -> str | None:
    """The side whose unmatched units are searched for; none where nothing was pruned or searching is off."""
    return spec.string_exact_match_prune if spec.string_exact_match_prune != "none" and spec.enable_search else None


def described(items: DataFrame, frame: DataFrame, spec: Spec) -> DataFrame:
    """items with `item`: what an adjudicator sees of a unit, as JSON."""
    context = lambda kind, names: F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.col(f"{kind}{i}").cast("string"))]) if names else F.create_map().cast("map<string,string>")
    unit = F.to_json(F.struct(F.col("key").alias("primary_key"), F.col("name").alias("primary_name"), F.col("canonical").alias("primary_canonical_name"), context("x", spec.exact_match).alias("exact_match_context"), context("c", spec.extra_context_cols).alias("extra_context")))
    return items.join(frame.select(F.col("key").alias("primary_key"), unit.alias("item")), "primary_key", "left")


def researched(items: DataFrame, adjudicator, spec: Spec, *, callers: int) -> DataFrame:
    """(primary_key, event_type, lineage_hint, notes, error): what an adjudicator finds out about each unit; an error ends no run."""

    def run(frames):
        for frame in frames:
            rows = []
            for key, item in zip(frame["primary_key"], frame["item"]):
                try:
                    found = adjudicator.research(json.loads(item), spec)
                    rows.append((key, str(found.get("event_type") or "unknown"), str(found.get("lineage_hint") or "").strip(), str(found.get("notes") or ""), None))
                except Exception as error:
                    rows.append((key, "unknown", "", "", str(error) or type(error).__name__))
            yield pd.DataFrame(rows, columns=["primary_key", "event_type", "lineage_hint", "notes", "error"])

    return items.select("primary_key", "item").repartition(callers, "primary_key").mapInPandas(run, "primary_key string, event_type string, lineage_hint string, notes string, error string")


def chosen(items: DataFrame, candidates: DataFrame, secondary: DataFrame, adjudicator, spec: Spec, *, callers: int) -> DataFrame:
    """Decisions of an adjudicator on the shortlists of researched units: of what it selects only keys of the shortlist count, once each.

    A unit whose event is unknown and that has no hint isn't asked about, one without a shortlist has no match, and an
    error becomes a record that a later run tries again.
    """
    context = lambda kind, names: F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.col(f"t.{kind}{i}").cast("string"))]) if names else F.create_map().cast("map<string,string>")
    payload = F.to_json(F.struct(F.col("c.rank").alias("rank"), F.col("c.secondary_key").alias("secondary_key"), F.col("c.secondary_name").alias("secondary_name"), F.col("c.secondary_canonical").alias("secondary_canonical_name"), F.col("c.score").alias("score"), context("x", spec.exact_match).alias("exact_match_context"), context("c", spec.extra_context_cols).alias("extra_context")))
    one = F.struct(F.col("c.rank").alias("rank"), F.col("c.secondary_key").alias("key"), payload.alias("json"))
    lists = candidates.alias("c").join(secondary.alias("t"), F.col("c.secondary_key") == F.col("t.key")).groupBy(F.col("c.primary_key").alias("primary_key")).agg(F.array_sort(F.collect_list(one)).alias("list"))
    asked = items.join(lists, "primary_key", "left").select("primary_key", "event_type", "lineage_hint", "notes", "error", "item", F.coalesce("list.key", F.array().cast("array<string>")).alias("keys"), F.coalesce("list.json", F.array().cast("array<string>")).alias("payloads"))

    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                base = {"primary_key": r.primary_key, "status": "ok", "event_type": r.event_type, "lineage_hint": r.lineage_hint, "notes": r.notes, "selected": [], "link_type": "no_match", "relationship": "unknown", "score": 0.0, "evidence": "", "reason": "", "error": None}
                if r.error:
                    base |= {"status": "error", "error": r.error}
                elif len(r.payloads) and (r.event_type != "unknown" or r.lineage_hint):
                    try:
                        found = adjudicator.choose(json.loads(r.item), {"event_type": r.event_type, "lineage_hint": r.lineage_hint, "notes": r.notes}, [json.loads(p) for p in r.payloads], spec)
                        listed = set(r.keys)
                        base |= {"selected": [k for k in dict.fromkeys(found.get("selected_secondary_keys") or []) if k in listed], "link_type": str(found.get("link_type") or "unknown"), "relationship": str(found.get("relationship") or "unknown"), "score": float(found.get("score") or 0.0), "evidence": str(found.get("evidence") or ""), "reason": str(found.get("reason") or "")}
                    except Exception as error:
                        base |= {"status": "error", "error": str(error) or type(error).__name__}
                rows.append(base)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DECISIONS.split(", ")])

    return asked.repartition(callers, "primary_key").mapInPandas(run, DECISIONS)


def pending(crosswalk: DataFrame, side: str, done: DataFrame | None = None) -> DataFrame:
    """Columns primary_key, primary_name: units with an unmatched row, once each, that aren't done yet.

    A unit that also has a matched row is pending all the same.
    """
    key = f"{side}_key"
    rows = crosswalk.where((F.col("merge") == f"only_in_{side}") & F.col(key).isNotNull()).select(F.col(key).alias("primary_key"), F.col(f"{side}_name").alias("primary_name"))
    rows = first_per_key(rows, "primary_key", ["primary_name"])
    return rows if done is None else rows.join(done.select("primary_key"), "primary_key", "left_anti")


def search_terms(items: DataFrame, spec: Spec) -> DataFrame:
    """Rows (primary_key, term_no, term, canonical): own name and hint, blank ones and those of one canonical form dropped."""
    terms = items.select("primary_key", F.posexplode(F.array(F.trim("primary_name"), F.trim("lineage_hint"))).alias("term_no", "term")).where("term <> ''")
    terms = terms.withColumn("canonical", canonical(F.col("term"), compose=spec.compose))
    return first_per_key(terms.withColumn("_k", F.concat_ws("\x00", "primary_key", "canonical")), "_k", ["term_no"]).drop("_k")


def global_shortlist(items: DataFrame, secondary: DataFrame, spec: Spec) -> DataFrame:
    """Columns primary_key, secondary_key, secondary_name, secondary_canonical, score, matched_term, rank.

    The k units of the other side that are most similar to the best of a unit's terms: the first term wins ties, and a
    unit without any similarity has score 0 and no term. items has primary_key, primary_name, lineage_hint. A unit
    without any term has no shortlist. The k best of the unit are among the k best of each of its terms; only where
    there are fewer than k the first names fill up, so nothing is compared with everything.
    """
    k = spec.max_candidates
    terms = with_position(search_terms(items, spec), ["primary_key", "term_no"], "ord")
    ranked = with_position(secondary, ["canonical", "key"], "place")
    pairs = top_pairs(terms.select("ord", "canonical"), ranked, "ord", "place", [], k)
    known = pairs.join(terms.select("ord", "primary_key", "term_no", "term"), "ord").where("score > 0")
    best = known.groupBy("primary_key", "place").agg(F.max(F.struct("score", (-F.col("term_no")).alias("no"), "term")).alias("b")).select("primary_key", "place", F.col("b.score").alias("score"), F.col("b.term").alias("matched_term"))
    order = Window.partitionBy("primary_key").orderBy(F.desc("score"), "place")
    top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
    full = top.groupBy("primary_key").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = terms.select("primary_key").distinct().join(full, "primary_key", "left_anti")
    zero = short.select("primary_key", F.explode(first_places(k, ranked)).alias("place")).join(top.select("primary_key", "place"), ["primary_key", "place"], "left_anti").withColumns({"score": F.lit(0.0), "matched_term": F.lit("")})
    both = top.unionByName(zero).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return both.join(ranked.select("place", F.col("key").alias("secondary_key"), F.col("name").alias("secondary_name"), F.col("canonical").alias("secondary_canonical")), "place").drop("place")


def hinted_decisions(items: DataFrame, candidates: DataFrame, spec: Spec, *, least: float = 0.5) -> DataFrame:
    """Decisions by rule: a unit with a hint takes its best candidate if that scores at least `least`.

    Without hint the event is unknown and no decision is looked for.
    """
    best = candidates.groupBy("primary_key").agg(F.min_by(F.struct("secondary_key", "score"), "rank").alias("top"))
    rows = items.join(best, "primary_key", "left")
    hint = F.trim(F.coalesce("lineage_hint", F.lit("")))
    found = (hint != "") & (F.col("top.score") >= least)
    relationship = "father_to_father" if spec.relationship == "auto" else spec.relationship
    return rows.select(
        "primary_key", F.lit("ok").alias("status"), F.when(hint != "", "rename").otherwise("unknown").alias("event_type"), hint.alias("lineage_hint"), F.lit("").alias("notes"),
        F.when(found, F.array("top.secondary_key")).otherwise(F.array().cast("array<string>")).alias("selected"), F.when(found, "rename").otherwise("no_match").alias("link_type"), F.when(found, relationship).otherwise("unknown").alias("relationship"),
        F.when(found, F.col("top.score")).otherwise(0.0).alias("score"), F.lit("").alias("evidence"), F.lit("").alias("reason"), F.lit(None).cast("string").alias("error"),
    )


def rewrite(crosswalk: DataFrame, decisions: DataFrame, candidates: DataFrame | None, frame_from: DataFrame, frame_to: DataFrame, spec: Spec, side: str, run_id: str) -> DataFrame:
    """crosswalk after the decisions of one side: hints noted, unmatched rows replaced by links.

    Selected keys outside the shortlist or the other table are dropped; each pair of keys has one row at the end.
    """
    other = "to" if side == "from" else "from"
    key, other_key = f"{side}_key", f"{other}_key"
    hints = decisions.select(F.col("primary_key").alias("_p"), F.trim(F.coalesce("lineage_hint", F.lit(""))).alias("_hint")).where("_hint <> ''")
    noted = crosswalk.join(hints, (F.col(key) == F.col("_p")) & (F.col("merge") == f"only_in_{side}"), "left").withColumn("lineage_hint", F.coalesce("_hint", "lineage_hint")).drop("_p", "_hint")
    matched = decisions.where((F.col("status") == "ok") & F.col("link_type").isin(*MATCHED_TYPES))
    links = matched.select("primary_key", "lineage_hint", "notes", "link_type", F.col("relationship").alias("given"), "score", "evidence", "reason", F.explode(F.array_distinct("selected")).alias("secondary_key"))
    if candidates is not None:
        links = links.join(candidates.select("primary_key", "secondary_key").distinct(), ["primary_key", "secondary_key"], "left_semi")
    p = (frame_from if side == "from" else frame_to).select(*[F.col(c).alias(f"p_{c}") for c in frame_from.columns])
    s = (frame_to if side == "from" else frame_from).select(*[F.col(c).alias(f"q_{c}") for c in frame_to.columns])
    links = links.join(p, F.col("primary_key") == F.col("p_key")).join(s, F.col("secondary_key") == F.col("q_key"))
    a, b = ("p", "q") if side == "from" else ("q", "p")
    pair = links.select(F.col(f"{a}_key").alias("_a"), F.col(f"{b}_key").alias("_b"))
    kept = noted.join(links.select(F.col("primary_key").alias(key)).distinct().withColumn("merge", F.lit(f"only_in_{side}")), [key, "merge"], "left_anti")
    kept = kept.join(links.select(F.col("secondary_key").alias(other_key)).distinct().withColumn("merge", F.lit(f"only_in_{other}")), [other_key, "merge"], "left_anti")
    kept = kept.join(pair, (F.col("from_key") == F.col("_a")) & (F.col("to_key") == F.col("_b")), "left_anti")
    passed = reduce(Column.__and__, [F.col(f"{a}_{c}").eqNullSafe(F.col(f"{b}_{c}")) for c in scope_columns(spec)], F.lit(True))
    evidence = F.when(F.trim(F.coalesce("evidence", F.lit(""))) != "", F.trim("evidence")).otherwise(F.coalesce("notes", F.lit("")))
    values = {
        "from_name": F.col(f"{a}_name"), "to_name": F.col(f"{b}_name"), "from_canonical_name": F.col(f"{a}_canonical"), "to_canonical_name": F.col(f"{b}_canonical"), "from_id": F.col(f"{a}_id"), "to_id": F.col(f"{b}_id"),
        "score": F.col("score"), "link_type": F.col("link_type"), "relationship": final_relationship(F.col("given"), F.col("link_type"), F.col(f"{b}_key"), spec), "merge": merge_indicator(F.col("link_type"), F.col(f"{b}_key")), "lineage_hint": F.trim(F.coalesce("lineage_hint", F.lit(""))),
        "evidence": F.substring(evidence, 1, 400), "reason": F.substring(F.trim(F.coalesce("reason", F.lit(""))), 1, 800) if spec.reason else F.lit(""), "country": F.lit(spec.country), "year_from": F.lit(str(spec.year_from)), "year_to": F.lit(str(spec.year_to)), "run_id": F.lit(run_id),
        "from_key": F.col(f"{a}_key"), "to_key": F.col(f"{b}_key"),
        "constraints_passed": F.create_map(F.lit("candidate_membership"), F.lit(True), F.lit("exact_match"), passed, F.lit("second_stage"), F.lit(True), F.lit("global_secondary_search"), F.lit(True)),
    }
    new = links.select(*[values[c].alias(c) for c in base_columns(spec.evidence)], *[F.col(f"{a}_x{i}").alias(c) for i, c in enumerate(spec.exact_match)])
    return kept.select(*new.columns).unionByName(new)
