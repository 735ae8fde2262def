"""The whole run: validate, collapse, match exactly, rank, decide, build rows, rescue, flag, write."""

from __future__ import annotations

import io
import logging
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import adjudicate as A
from kinweave.operators import crosswalk as C
from kinweave.operators import rescue as R
from kinweave.operators.exact import exact_matches, prune
from kinweave.operators.prepare import work_frame
from kinweave.operators.shortlist import shortlist
from kinweave.plans.identity import replay_identity, run_folder
from kinweave.plans.identity import run_id as make_run_id
from kinweave.plans.spec import OUTPUT_VERSION, PROMPT_VERSION, Spec
from kinweave.plans.store import AnswerCache, DecisionLog, ReplayStore
from kinweave.plans.validate import validate
from kinweave.session import materialize, temporary_tables
from kinweave.sources.files import below, exists, read_text, write_document, write_table, write_text


class RunLog:
    """A logger of one run, whose lines are added to a file on any file system when the run ends, well or not."""

    def __init__(self, spark, path: str, run_key: str) -> None:
        self.spark, self.path, self.lines = spark, path, io.StringIO()
        self.logger = logging.getLogger(f"kinweave.{run_key}")
        self.handler = logging.StreamHandler(self.lines)
        self.handler.setFormatter(logging.Formatter("%(asctime)s | %(levelname)s | %(message)s", "%Y-%m-%dT%H:%M:%S"))

    def __enter__(self) -> logging.Logger:
        self.logger.setLevel(logging.INFO)
        self.logger.addHandler(self.handler)
        return self.logger

    def __exit__(self, kind, error, trace) -> None:
        if error is not None:
            self.logger.error("the run broke off: %s", error)
        self.logger.removeHandler(self.handler)
        before = read_text(self.spark, self.path) if exists(self.spark, self.path) else ""
        write_text(self.spark, self.path, before + self.lines.getvalue())


@dataclass
class Frames:
    """Work frames, exact matches, and what goes on to the shortlist."""

    frame_from: DataFrame
    frame_to: DataFrame
    exact: DataFrame
    open_from: DataFrame
    open_to: DataFrame


@dataclass
class Run:
    crosswalk: DataFrame
    review_queue: DataFrame
    metadata: dict[str, Any]
    warnings: list[str] = field(default_factory=list)


def frames(df_from: DataFrame, df_to: DataFrame, spec: Spec) -> Frames:
    frame_from, frame_to = materialize(work_frame(df_from, "from", spec)), materialize(work_frame(df_to, "to", spec))
    exact = exact_matches(frame_from, frame_to, spec)
    if spec.string_exact_match_prune == "none":
        exact = exact.limit(0)
    exact = materialize(exact)
    return Frames(frame_from, frame_to, exact, *prune(frame_from, frame_to, exact, spec))


def scope_label(row: Any, n: int) -> str:
    """The scope's values as a tuple's text, '__all__' without a scope."""
    return str(tuple(row[f"s{i}"] for i in range(n))) if n else "__all__"


def preview_groups(open_from: DataFrame, spec: Spec) -> DataFrame:
    """Rows of each normalized scope that go on to the shortlist: s0.., rows."""
    return open_from.groupBy(*[f"s{i}" for i in range(len(spec.exact_match))]).agg(F.count("*").alias("rows"))


def preview(df_from: DataFrame, df_to: DataFrame, options: dict[str, Any]) -> dict[str, Any]:
    """What a run would do, without a decision: sizes, scopes and the mean length of the shortlists."""
    report = validate(df_from, df_to, options)
    if not report["valid"]:
        return {"valid": False, "errors": report["errors"], "warnings": report["warnings"]}
    spec = Spec(**options)
    all_ = frames(df_from, df_to, spec)
    candidates = shortlist(all_.open_from, all_.open_to, spec)
    n_from, n_to, n_pairs = all_.open_from.count(), all_.open_to.count(), candidates.count()
    groups = preview_groups(all_.open_from, spec).collect() if n_from else []
    return {
        "valid": True, "country": spec.country, "year_from": spec.year_from, "year_to": spec.year_to,
        "from_rows_input": report["from_rows_input"], "from_rows_effective": report["from_rows_effective"], "to_rows_input": report["to_rows_input"], "to_rows_effective": report["to_rows_effective"],
        "from_rows": n_from, "to_rows": n_to, "exact_match": list(spec.exact_match), "string_exact_match_prune": spec.string_exact_match_prune, "exact_string_matches": all_.exact.count(),
        "groups": {scope_label(r, len(spec.exact_match)): r["rows"] for r in groups}, "max_candidates": spec.max_candidates, "avg_candidates": round(n_pairs / n_from, 4) if n_from else 0.0, "warnings": report["warnings"],
    }


def run(
    df_from: DataFrame,
    df_to: DataFrame,
    options: dict[str, Any],
    *,
    adjudicator: A.Adjudicator | None = None,
    hints: DataFrame | None = None,
    output_dir: str | Path = "outputs",
    review_score_threshold: float = 0.6,
    write_csv: bool = True,
    write_parquet: bool = True,
    replay_dir: str | Path | None = None,
    cache_dir: str | Path | None = None,
    retry: dict[str, Any] | None = None,
    callers: int = A.CALLERS,
    loader_metadata: dict[str, Any] | None = None,
) -> Run:
    """Build the crosswalk of two tables.

    Without an adjudicator the built-in rules decide. hints(primary_key, lineage_hint) are what is known of unmatched
    units; other units are researched by the adjudicator if it can, and it chooses from their shortlists; without it a
    rule takes the best candidate of units with a hint. Decisions are written to a log keyed by the run's content, part
    by part, so that a later run with the same content takes them over and asks only for rows that failed or weren't
    reached. With a cache folder an adjudicator's answers are also kept by the content of what was asked, for runs of
    any request. Folders may be on any file system that Spark can write.
    """
    started = datetime.now(UTC).isoformat()
    report = validate(df_from, df_to, options)
    if not report["valid"]:
        raise ValueError("; ".join(report["errors"]))
    spec, spark, warnings = Spec(**options), df_from.sparkSession, list(report["warnings"])
    identity = replay_identity(spec, df_from, df_to, type(adjudicator).__name__ if adjudicator else "rules")
    run_key = make_run_id(identity, spec.seed)
    folder = below(output_dir, run_folder(spec))
    asking = Asking(A.with_settings(adjudicator, retry) if adjudicator else None, hints, AnswerCache(spark, cache_dir) if cache_dir and adjudicator else None, callers)
    with RunLog(spark, below(folder, "run.log"), run_key) as log, temporary_tables(spark) as kept:
        for warning in warnings:
            log.warning(warning)
        store = ReplayStore(spark, replay_dir) if replay_dir else None
        logs = Logs(spark, folder, run_key)
        tables, stage, replayed = None, {}, None
        if store:
            try:
                found = store.load(identity["replay_key"])
            except Exception as error:
                found = None
                warnings.append(f"The stored result of this request can't be used ({error}), so the run starts anew. Replay bundle: {identity['replay_key']}.")
            if found:
                tables, manifest = found
                stage, replayed = manifest["stage_counts"], manifest["run_id"]
                for name, one in logs.all().items():
                    one.restore(tables[name])
                log.info("replayed from run %s", replayed)
        if tables is None:
            crosswalk, stage = _live(df_from, df_to, spec, asking, logs, run_key, warnings, log)
        else:
            crosswalk = tables["crosswalk"]
        flagged = materialize(C.with_flags(crosswalk, threshold=review_score_threshold))
        kept.append(flagged)
        queue = C.review_queue(flagged)
        if store and replayed is None and not stage["error_from_rows"] and not stage["second_stage_failed_rows"]:
            try:
                bundle = {"crosswalk": crosswalk, "review_queue": queue} | {name: one.read() for name, one in logs.all().items()}
                store.publish(identity["replay_key"], bundle, {"run_id": run_key, "identity": identity, "stage_counts": stage})
            except Exception as error:
                warnings.append(f"The result couldn't be stored for replay: {error}")
        totals = C.summary(flagged).first().asDict()
        cover = C.coverage(flagged, list(spec.exact_match)).collect()
        label = lambda r: (str(tuple(r[c] for c in spec.exact_match)) if len(spec.exact_match) > 1 else str((r[spec.exact_match[0]],))) if spec.exact_match else "__all__"
        metadata = {
            "run_id": run_key, "schema_version": PROMPT_VERSION, "output_schema_version": OUTPUT_VERSION, "request": spec.request(),
            "counts": totals | {k: report[k] for k in ("from_rows_input", "from_rows_effective", "to_rows_input", "to_rows_effective")} | stage,
            "coverage_by_group": {label(r): {c: r[c] for c in ("from_units", "matched_from_units", "unmatched_from_units")} for r in cover} if totals["rows"] else {},
            "warnings": warnings, "loader_metadata": loader_metadata or {}, "started_at": started, "finished_at": datetime.now(UTC).isoformat(),
            "replay_key": identity["replay_key"], "replay_hit": replayed is not None, "replayed_from_run_id": replayed, "execution_mode": "replay" if replayed else "live",
        }
        metadata["artifacts"] = _write(flagged, queue, folder, write_csv, write_parquet, warnings)
        write_document(spark, below(folder, "run_metadata.json"), metadata)
        log.info("%s rows, %s earlier units, %s later units", totals["rows"], totals["from_units"], totals["to_units"])
    return Run(flagged, queue, metadata, warnings)


@dataclass
class Asking:
    """Who decides what the rules of exact names don't."""

    adjudicator: A.Adjudicator | None
    hints: DataFrame | None
    cache: AnswerCache | None
    callers: int


class Logs:
    """The logs of one run."""

    def __init__(self, spark, folder: str, run_key: str) -> None:
        log = lambda name, schema: DecisionLog(spark, folder, run_key, name, schema)
        self.decisions, self.second_stage = log("decisions", A.DECISION), log("second_stage", R.DECISIONS + ", logged_at string")
        self.notes = log("grounding_notes", "from_key string, candidate_keys array<string>, status string, notes string, error string, logged_at string")

    def all(self) -> dict[str, DecisionLog]:
        return {"decisions": self.decisions, "second_stage": self.second_stage, "grounding_notes": self.notes}


def _decided(all_: Frames, candidates: DataFrame, spec: Spec, asking: Asking, logs: Logs, log: logging.Logger) -> tuple[DataFrame, dict[str, int]]:
    """The decision log after all rows that weren't decided yet, and the counts of notes."""
    done = logs.decisions.done("from_key", ["logged_at", "batch"])
    pending = all_.open_from.join(done.withColumnRenamed("from_key", "key"), "key", "left_anti")
    exact = A.exact_decisions(all_.exact.join(done, "from_key", "left_anti"), spec)
    noted = {"grounding_attempted_rows": 0, "grounded_rows": 0, "grounding_failed_rows": 0}
    if asking.adjudicator is None:
        return logs.decisions.append(exact.unionByName(A.rule_decisions(pending, candidates, spec))), noted
    since = datetime.now(UTC).isoformat()
    items = materialize(A.batch_items(pending, candidates, all_.frame_to, spec))
    asked = items
    if asking.cache:
        hits, asked = A.known_answers(items, asking.cache.read(), spec)
        exact, asked = exact.unionByName(hits), materialize(asked)
    decisions = logs.decisions.append(exact)
    batches = (asked.agg(F.max("batch")).first()[0] or 0) + 1
    parts = max(1, min(A.COMMITS, batches // (4 * asking.callers)))
    for part in range(parts):
        decisions = logs.decisions.append(A.python_decisions(asked.where(F.pmod("batch", F.lit(parts)) == part), asking.adjudicator, spec, callers=asking.callers))
        log.info("part %s of %s is decided", part + 1, parts)
        A.raise_fatal(decisions, since)
    if asking.cache:
        asking.cache.append(A.new_answers(items, decisions.where(F.col("logged_at") >= since), spec))
    if spec.enable_search:
        logs.notes.restore(A.notes_of(items, decisions, since))
        by = {r["status"]: r["count"] for r in logs.notes.read().groupBy("status").count().collect()}
        noted = {"grounding_attempted_rows": by.get("ok", 0) + by.get("error", 0), "grounded_rows": by.get("ok", 0), "grounding_failed_rows": by.get("error", 0)}
    return decisions, noted


def _live(df_from: DataFrame, df_to: DataFrame, spec: Spec, asking: Asking, logs: Logs, run_key: str, warnings: list[str], log: logging.Logger) -> tuple[DataFrame, dict[str, int]]:
    all_ = frames(df_from, df_to, spec)
    candidates = materialize(shortlist(all_.open_from, all_.open_to, spec))
    decisions, noted = _decided(all_, candidates, spec, asking, logs, log)
    failed = C.still_failed(decisions).count()
    if failed:
        warnings.append(f"{failed} earlier units got no decision and are unknown for now; a later run asks again.")
    crosswalk = materialize(C.crosswalk_rows(all_.frame_from, all_.frame_to, decisions, candidates, spec, run_key))
    stage = {"error_from_rows": failed} | noted | {"second_stage_attempted_rows": 0, "second_stage_rewritten_rows": 0, "second_stage_failed_rows": 0}
    side = R.primary_side(spec)
    if side is None:
        if spec.string_exact_match_prune != "none":
            warnings.append("Unmatched units aren't rescued: rescue is disabled as long as enable_search is false.")
        return crosswalk, stage
    last = _rescued(crosswalk, all_, spec, asking, logs.second_stage, side)
    failures = last.where("status = 'error'").count()
    if failures:
        warnings.append(f"{failures} unmatched units couldn't be looked into; a later run tries them again.")
    stage |= {"second_stage_attempted_rows": last.count(), "second_stage_rewritten_rows": last.where((F.size("selected") > 0) & F.col("link_type").isin(*C.MATCHED_TYPES)).count(), "second_stage_failed_rows": failures}
    log.info("second stage: %s units, %s linked, %s failed", *[stage[f"second_stage_{k}_rows"] for k in ("attempted", "rewritten", "failed")])
    return materialize(R.rewrite(crosswalk, last, None, all_.frame_from, all_.frame_to, spec, side, run_key)), stage


def _rescued(crosswalk: DataFrame, all_: Frames, spec: Spec, asking: Asking, chosen: DecisionLog, side: str) -> DataFrame:
    """The last decision on every unmatched unit; what is selected is always of the unit's shortlist."""
    spark = crosswalk.sparkSession
    primary, secondary = (all_.frame_from, all_.frame_to) if side == "from" else (all_.frame_to, all_.frame_from)
    items = R.pending(crosswalk, side, chosen.done("primary_key", ["logged_at"]))
    given = asking.hints if asking.hints is not None else spark.createDataFrame([], "primary_key string, lineage_hint string")
    items = R.described(items.join(given.select("primary_key", F.trim("lineage_hint").alias("lineage_hint")), "primary_key", "left"), primary, spec)
    items = materialize(items.withColumns({"lineage_hint": F.coalesce("lineage_hint", F.lit("")), "event_type": F.lit("unknown"), "notes": F.lit(""), "error": F.lit(None).cast("string")}))
    able = lambda name: asking.adjudicator is not None and _has(asking.adjudicator, name)
    if able("research"):
        found = R.researched(items.where("lineage_hint = ''"), asking.adjudicator, spec, callers=asking.callers)
        known = items.where("lineage_hint <> ''")
        items = materialize(known.unionByName(items.where("lineage_hint = ''").drop("lineage_hint", "event_type", "notes", "error").join(found, "primary_key")))
    wanted = items.where("(lineage_hint <> '' OR event_type <> 'unknown') AND error IS NULL")
    ranked = materialize(R.global_shortlist(wanted, secondary, spec))
    new = R.chosen(items, ranked, secondary, asking.adjudicator, spec, callers=asking.callers) if able("choose") else R.hinted_decisions(items, ranked, spec)
    log = chosen.append(new.withColumn("logged_at", F.lit(datetime.now(UTC).isoformat())))
    return C.latest_per_key(log, ["primary_key"], ["logged_at"], [c.split()[0] for c in R.DECISIONS.split(", ") if c.split()[0] != "primary_key"])


def _has(adjudicator: Any, name: str) -> bool:
    return callable(getattr(getattr(adjudicator, "adjudicator", adjudicator), name, None))


def _write(flagged: DataFrame, queue: DataFrame, folder: str, csv: bool, parquet: bool, warnings: list[str]) -> dict[str, str]:
    paths = {"run_dir": folder} | {name: below(folder, name) for name in ("decisions", "second_stage", "grounding_notes")}
    paths |= {"review_queue_csv": below(folder, "review_queue.csv"), "run_metadata_json": below(folder, "run_metadata.json"), "run_log": below(folder, "run.log")}
    if parquet:
        try:
            write_table(flagged, below(folder, "evolution_key.parquet"), "parquet")
            paths["evolution_key_parquet"] = below(folder, "evolution_key.parquet")
        except Exception as error:
            warnings.append(f"The Parquet table couldn't be written ({error}), a CSV table stands in for it.")
            csv = True
    if csv:
        write_table(flagged, below(folder, "evolution_key.csv"), "csv")
        paths["evolution_key_csv"] = below(folder, "evolution_key.csv")
    write_table(queue, paths["review_queue_csv"], "csv")
    return paths
