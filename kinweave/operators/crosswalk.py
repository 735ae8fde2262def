"""Crosswalk rows from decisions: one per link, and one for every later unit that no row was matched with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.adjudicate import LINK, link
from kinweave.operators.prepare import scope_columns
from kinweave.plans.spec import MATCHED_TYPES, RELATIONSHIPS, Spec

# Texts of results.
FAILED = "Adjudication failed after retries: "
NO_RECORD = "No completed adjudication record."
OUTSIDE_EVIDENCE = "Model selected a target outside the provided candidates."
OUTSIDE_REASON = "The chosen target was not present in the candidate list."
TARGET_EVIDENCE = "Target unit appears in the later-period table but was not used by any matched source row."
TARGET_REASON = "No earlier-period source row was linked to this target unit."
EVIDENCE_CHARS, REASON_CHARS = 400, 800


def base_columns(evidence: bool) -> list[str]:
    before = ["from_name", "to_name", "from_canonical_name", "to_canonical_name", "from_id", "to_id", "score", "link_type", "relationship", "merge", "lineage_hint"]
    return before + ["evidence"] * evidence + ["reason", "country", "year_from", "year_to", "run_id", "from_key", "to_key", "constraints_passed"]


def merge_indicator(link_type: Column, to_key: Column) -> Column:
    return F.when(to_key.isNotNull() & link_type.isin(*MATCHED_TYPES), "both").otherwise("only_in_from")


def final_relationship(given: Column, link_type: Column, to_key: Column, spec: Spec) -> Column:
    value = F.lit(spec.relationship) if spec.relationship != "auto" else F.when(given.isin(*RELATIONSHIPS), given).otherwise("unknown")
    return F.when(to_key.isNull() | ~link_type.isin(*MATCHED_TYPES), "unknown").otherwise(value)


def latest(decisions: DataFrame, status: str, order: list[str]) -> DataFrame:
    """The last record of a status per from_key; records without a key don't count."""
    rows = decisions.where((F.col("status") == status) & F.col("from_key").isNotNull())
    return rows.groupBy("from_key").agg(F.max_by(F.struct("match_stage", "links", "error"), F.struct(*order)).alias("record")).select("from_key", "record.*")


def link_rows(frame_from: DataFrame, frame_to: DataFrame, decisions: DataFrame, candidates: DataFrame, spec: Spec, run_id: str) -> DataFrame:
    """One row per link of each from-row, in the columns of the crosswalk; links outside the shortlist become unknown."""
    ok, failed = latest(decisions, "ok", ["logged_at", "batch"]), latest(decisions, "error", ["logged_at", "batch"]).select("from_key", F.col("error").alias("error_text"))
    f = frame_from.alias("f").join(ok.alias("k"), F.col("f.key") == F.col("k.from_key"), "left").join(failed.alias("e"), F.col("f.key") == F.col("e.from_key"), "left")
    text = F.when(F.col("e.from_key").isNotNull(), F.concat(F.lit(FAILED), F.trim(F.coalesce("e.error_text", F.lit(""))))).otherwise(NO_RECORD)
    missing = link(F.lit(None), "unknown", "unknown", 0.0, text if spec.evidence else None, "" if spec.reason else None)
    links = F.when(F.size(F.coalesce("k.links", F.array().cast(f"array<{LINK}>"))) > 0, F.col("k.links")).otherwise(F.array(missing))
    kept = [F.col(f"f.{c}").alias(f"f_{c}") for c in frame_from.columns]
    one = f.select(*kept, F.col("k.match_stage").alias("stage"), F.posexplode(links).alias("at", "l")).select("*", "l.*").drop("l")
    allowed = candidates.select(F.col("from_key").alias("f_key"), F.col("to_key"), F.lit(True).alias("listed"))
    one = one.join(allowed, ["f_key", "to_key"], "left")
    member = F.coalesce(F.col("stage") == "exact", F.lit(False)) | F.col("to_key").isNull() | F.coalesce("listed", F.lit(False))
    one = one.withColumns({"member": member, "chosen": F.when(member, F.col("to_key"))})
    t = frame_to.select(*[F.col(c).alias(f"t_{c}") for c in frame_to.columns])
    one = one.join(t, F.col("chosen") == F.col("t_key"), "left")
    kind = F.when(~F.col("member"), "unknown").when(F.col("t_key").isNull() & F.col("link_type").isin(*MATCHED_TYPES), "unknown").otherwise(F.col("link_type"))
    one = one.withColumns({"kind": kind, "score": F.when(F.col("member"), F.coalesce("score", F.lit(0.0))).otherwise(0.0)})
    passed = reduce(Column.__and__, [F.col(f"f_{s}").eqNullSafe(F.col(f"t_{s}")) for s in scope_columns(spec)], F.lit(True))
    evidence = F.when(F.col("member"), F.trim(F.coalesce("evidence", F.lit("")))).otherwise(OUTSIDE_EVIDENCE)
    reason = F.trim(F.coalesce("reason", F.lit("")))
    reason = F.when(~F.col("member") & (reason == ""), OUTSIDE_REASON).otherwise(reason) if spec.reason else F.lit("")
    values = {
        "from_name": F.col("f_name"), "to_name": F.col("t_name"), "from_canonical_name": F.col("f_canonical"), "to_canonical_name": F.col("t_canonical"), "from_id": F.col("f_id"), "to_id": F.col("t_id"),
        "score": F.col("score"), "link_type": F.col("kind"), "relationship": final_relationship(F.col("relationship"), F.col("kind"), F.col("t_key"), spec), "merge": merge_indicator(F.col("kind"), F.col("t_key")), "lineage_hint": F.lit(""),
        "evidence": F.substring(evidence, 1, EVIDENCE_CHARS), "reason": F.substring(reason, 1, REASON_CHARS), "from_key": F.col("f_key"), "to_key": F.col("t_key"),
        "constraints_passed": F.create_map(F.lit("candidate_membership"), F.col("member"), F.lit("exact_match"), F.when(F.col("t_key").isNull(), True).otherwise(passed)),
    }
    return _shaped(one, values, "f_x", spec, run_id)


def _shaped(rows: DataFrame, values: dict[str, Column], scope: str, spec: Spec, run_id: str) -> DataFrame:
    values = values | {"country": F.lit(spec.country), "year_from": F.lit(str(spec.year_from)), "year_to": F.lit(str(spec.year_to)), "run_id": F.lit(run_id)}
    return rows.select(*[values[c].alias(c) for c in base_columns(spec.evidence)], *[F.col(f"{scope}{i}").alias(c) for i, c in enumerate(spec.exact_match)])


def target_rows(frame_to: DataFrame, matched: DataFrame, spec: Spec, run_id: str) -> DataFrame:
    """One row per later unit that no row with merge 'both' uses."""
    used = matched.where((F.col("merge") == "both") & F.col("to_key").isNotNull()).select(F.col("to_key").alias("key"))
    rest = frame_to.join(used, "key", "left_anti")
    none = F.lit(None).cast("string")
    values = {
        "from_name": none, "to_name": F.col("name"), "from_canonical_name": none, "to_canonical_name": F.col("canonical"), "from_id": none, "to_id": F.col("id"), "score": F.lit(0.0), "link_type": F.lit("unknown"), "relationship": F.lit("unknown"), "merge": F.lit("only_in_to"), "lineage_hint": F.lit(""),
        "evidence": F.lit(TARGET_EVIDENCE), "reason": F.lit(TARGET_REASON if spec.reason else ""), "from_key": none, "to_key": F.col("key"), "constraints_passed": F.create_map(F.lit("target_only_row"), F.lit(True)),
    }
    return _shaped(rest, values, "x", spec, run_id)


def crosswalk_rows(frame_from: DataFrame, frame_to: DataFrame, decisions: DataFrame, candidates: DataFrame, spec: Spec, run_id: str) -> DataFrame:
    links = link_rows(frame_from, frame_to, decisions, candidates, spec, run_id)
    return links.unionByName(target_rows(frame_to, links, spec, run_id))


def with_flags(crosswalk: DataFrame, *, threshold: float = 0.6, most_out: int = 3, most_in: int = 3) -> DataFrame:
    """crosswalk with review_flags and review_reason: low score, type, and more partners than usual on either side."""
    kinds = F.col("merge") == "both" if "merge" in crosswalk.columns else F.col("link_type").isin(*MATCHED_TYPES)
    matched = crosswalk.where(F.col("from_key").isNotNull() & F.col("to_key").isNotNull() & kinds).select("from_key", "to_key").distinct()
    out = matched.groupBy("from_key").agg(F.count("*").alias("_out")).where(F.col("_out") > most_out)
    into = matched.groupBy("to_key").agg(F.count("*").alias("_in")).where(F.col("_in") > most_in)
    rows = crosswalk.join(out, "from_key", "left").join(into, "to_key", "left")
    flags = F.array_compact(F.array(F.when(F.col("score") < threshold, "low_score"), F.when(F.col("link_type").isin("unknown", "no_match"), "type_needs_review"), F.when(F.col("_out").isNotNull(), "high_fan_out"), F.when(F.col("_in").isNotNull(), "high_fan_in")))
    return rows.withColumn("review_flags", flags).withColumn("review_reason", F.array_join("review_flags", ",")).select(*crosswalk.columns, "review_flags", "review_reason")


def review_queue(flagged: DataFrame) -> DataFrame:
    """Rows with a flag, by from_name (nulls last) and score."""
    return flagged.where(F.size("review_flags") > 0).orderBy(F.asc_nulls_last("from_name"), "score")


def coverage(crosswalk: DataFrame, scope: list[str]) -> DataFrame:
    """Per scope as given: from_units, matched_from_units, unmatched_from_units; without a scope one row."""
    matched = F.when(F.col("to_key").isNotNull() & F.col("link_type").isin(*MATCHED_TYPES), F.col("from_key"))
    counts = crosswalk.groupBy(*scope).agg(F.countDistinct("from_key").alias("from_units"), F.countDistinct(matched).alias("matched_from_units"))
    return counts.withColumn("unmatched_from_units", F.col("from_units") - F.col("matched_from_units"))


def summary(crosswalk: DataFrame) -> DataFrame:
    """One row: rows, from_units, to_units, avg_score (six decimals, null without rows)."""
    return crosswalk.agg(F.count("*").alias("rows"), F.countDistinct("from_key").alias("from_units"), F.countDistinct("to_key").alias("to_units"), F.round(F.avg("score"), 6).alias("avg_score"))


def latest_per_key(log: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key in an append-only log; rows with a null key don't count."""
    rows = log.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in key]))
    return rows.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")).select(*key, "_last.*")


def still_failed(log: DataFrame) -> DataFrame:
    """Keys that have an error record but none that is ok."""
    keys = lambda s: log.where((F.col("status") == s) & F.col("from_key").isNotNull()).select("from_key")
    return keys("error").distinct().join(keys("ok"), "from_key", "left_anti")


def first_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
