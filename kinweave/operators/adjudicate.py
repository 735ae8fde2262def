"""Decisions on shortlists: built-in rules as columns, or any adjudicator called in batches inside the tasks."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable
from datetime import UTC, datetime
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.order import with_position
from kinweave.plans.spec import PROMPT_VERSION, Spec

#: Tasks that ask an adjudicator at the same time, so that the total rate of calls doesn't grow with the cluster.
CALLERS = 8
#: Writes of the decision log in one run at most; a run that breaks off keeps what was written.
COMMITS = 20
LINK = "struct<to_key:string,link_type:string,relationship:string,score:double,evidence:string,reason:string>"
DECISION = f"from_key string, match_stage string, status string, links array<{LINK}>, error string, batch string, logged_at string, notes string"
NOTE_CHARS = 4000

# Texts of results.
EXACT_TEXT = "Resolved by normalized exact string match within the current scope."
NO_SHORTLIST = "No shortlist candidates available in the constrained group."
NO_CANDIDATES = "No candidates available in constrained group."
OMITTED = "LLM omitted this item in batch response."
NO_LINK = "No valid link selected by model."
BEST_EVIDENCE = "Best lexical and contextual candidate within exact-match constraints."
BEST_REASON = "The lexical score and local context were stronger than the other available options."
NONE_REASON = "No candidate was strong enough to justify a link."


class TransientError(Exception):
    """The service may answer the next time."""


class FatalError(Exception):
    """No further call can succeed: the run ends."""


class QuotaError(FatalError):
    """The service's quota is used up."""


class Adjudicator(Protocol):
    """decide gets the items of a batch and returns [{from_key, links: [{to_key, link_type, relationship, score, ...}], notes}].

    Two more methods are optional. research(item, spec) gives {event_type, lineage_hint, notes} of a unit that found no
    match; choose(item, research, candidates, spec) gives {selected_secondary_keys, link_type, relationship, score,
    evidence, reason} out of the candidates of the second stage. Without them the rules of the second stage decide.
    """

    def decide(self, items: list[dict], spec: Spec) -> list[dict]: ...


class Retrying:
    """An adjudicator whose calls are made again after transient errors."""

    def __init__(self, adjudicator: Adjudicator, *, max_attempts: int = 6, base_delay_seconds: float = 1.0, max_delay_seconds: float = 20.0, jitter_seconds: float = 0.2) -> None:
        self.adjudicator, self.waits = adjudicator, {"attempts": max_attempts, "base": base_delay_seconds, "most": max_delay_seconds, "jitter": jitter_seconds}

    def __getattr__(self, name: str):
        if name not in ("decide", "research", "choose"):
            raise AttributeError(name)
        call = getattr(self.adjudicator, name)
        return lambda *args: with_retries(lambda: call(*args), **self.waits)


def with_settings(adjudicator: Adjudicator, retry: dict | None) -> Adjudicator:
    """adjudicator with a configuration's retry settings; one that retries by itself (`retry_with`) takes them over."""
    if not retry:
        return adjudicator
    own = getattr(adjudicator, "retry_with", None)
    return own(**retry) if own else Retrying(adjudicator, **retry)


def link(to_key: Column, link_type: Column | str, relationship: Column | str, score: Column | float, evidence: Column | str | None, reason: Column | str | None) -> Column:
    column = lambda v: v if isinstance(v, Column) else F.lit(v)
    parts = (to_key, link_type, relationship, score, evidence, reason)
    return F.struct(*[column(p).alias(n) for p, n in zip(parts, ("to_key", "link_type", "relationship", "score", "evidence", "reason"))]).cast(LINK)


def exact_decisions(exact: DataFrame, spec: Spec) -> DataFrame:
    relationship = "father_to_father" if spec.relationship == "auto" else spec.relationship
    one = link(F.col("to_key"), "rename", relationship, 1.0, EXACT_TEXT if spec.evidence else None, EXACT_TEXT if spec.reason else None)
    return exact.select("from_key", F.lit("exact").alias("match_stage"), F.lit("ok").alias("status"), F.array(one).alias("links"), F.lit(None).cast("string").alias("error"), F.lit("exact").alias("batch"), F.lit(_now()).alias("logged_at"), F.lit(None).cast("string").alias("notes"))


def rule_decisions(frame_from: DataFrame, candidates: DataFrame, spec: Spec, *, default_score: float = 0.9) -> DataFrame:
    """The best candidate of each row: a rename, or unknown where it is one of several and scores less than 0.5."""
    best = candidates.groupBy("from_key").agg(F.min_by(F.struct("to_key", "score"), "rank").alias("top"), F.count("*").alias("n"))
    rows = frame_from.select(F.col("key").alias("from_key")).join(best, "from_key", "left")
    score, unsure = F.col("top.score"), (F.col("n") > 1) & (F.col("top.score") < 0.5)
    relationship = "father_to_father" if spec.relationship == "auto" else spec.relationship
    found = link(F.col("top.to_key"), F.when(unsure, "unknown").otherwise("rename"), relationship, F.greatest(score, F.when(unsure, 0.4).otherwise(default_score)), BEST_EVIDENCE if spec.evidence else None, BEST_REASON if spec.reason else None)
    none = link(F.lit(None), "no_match", "unknown", 0.0, NO_CANDIDATES if spec.evidence else None, NONE_REASON if spec.reason else None)
    links = F.array(F.when(F.col("n").isNull(), none).otherwise(found))
    return rows.select("from_key", F.lit("ai").alias("match_stage"), F.lit("ok").alias("status"), links.alias("links"), F.lit(None).cast("string").alias("error"), F.lit("rules").alias("batch"), F.lit(_now()).alias("logged_at"), F.lit(None).cast("string").alias("notes"))


def batch_items(frame_from: DataFrame, candidates: DataFrame, frame_to: DataFrame, spec: Spec) -> DataFrame:
    """Rows (batch, place, from_key, item, candidates): what an adjudicator sees of each row, as JSON, in batches in input order."""
    context = lambda alias, kind, names: F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.col(f"{alias}.{kind}{i}").cast("string"))]) if names else F.create_map().cast("map<string,string>")
    c, t = candidates.alias("c"), frame_to.alias("t")
    payload = F.struct(F.col("c.rank").alias("rank"), F.col("c.to_key").alias("to_key"), F.col("c.to_name").alias("to_name"), F.col("c.to_canonical").alias("to_canonical_name"), F.col("c.score").alias("score"), context("t", "x", spec.exact_match).alias("exact_match_context"), context("t", "c", spec.extra_context_cols).alias("extra_context"))
    one = F.struct(F.col("c.rank").alias("rank"), F.to_json(payload).alias("json"))
    lists = c.join(t, F.col("c.to_key") == F.col("t.key")).groupBy(F.col("c.from_key").alias("from_key")).agg(F.array_sort(F.collect_list(one)).alias("candidates"))
    f = with_position(frame_from, ["ord"], "place").alias("f")
    items = f.join(lists, F.col("f.key") == F.col("from_key"), "left")
    item = F.to_json(F.struct(F.col("f.key").alias("from_key"), F.col("f.name").alias("from_name"), F.col("f.canonical").alias("from_canonical_name"), context("f", "x", spec.exact_match).alias("exact_match_context"), context("f", "c", spec.extra_context_cols).alias("extra_context")))
    return items.select(F.floor(F.col("f.place") / spec.batch_size).alias("batch"), F.col("f.place").alias("place"), F.col("f.key").alias("from_key"), item.alias("item"), F.coalesce("candidates.json", F.array().cast("array<string>")).alias("candidates"))


def with_retries(call: Callable, *, attempts: int, base: float, most: float, jitter: float, sleep: Callable[[float], None] = time.sleep):
    """call() again after transient errors, waiting base * 2^(n-1) up to most, plus a random jitter."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except TransientError:
            if n == attempts:
                raise
            sleep(min(most, base * 2 ** (n - 1)) + random.uniform(0, jitter))


def adjudicate_batch(adjudicator: Adjudicator, items: list[dict], label: str, spec: Spec) -> list[dict]:
    """Decision records of a batch. A failing batch is halved again and again; a failing row becomes an error record."""
    if len(items) == 1 and not items[0]["candidates"]:
        return [_record(items[0]["from_key"], "ok", [_link("no_match", NO_SHORTLIST, spec)], None, label)]
    try:
        replies = {d["from_key"]: d for d in adjudicator.decide(items, spec)}
    except FatalError:
        raise
    except Exception as error:
        if len(items) == 1:
            return [_record(items[0]["from_key"], "error", [], str(error), label)]
        half = len(items) // 2
        return adjudicate_batch(adjudicator, items[:half], f"{label}.1", spec) + adjudicate_batch(adjudicator, items[half:], f"{label}.2", spec)
    out = []
    for item in items:
        reply = replies.get(item["from_key"], {})
        links = reply.get("links", [] if reply else None)
        if links is None:
            links = [_link("unknown", OMITTED, spec)]
        elif not links:
            links = [_link("no_match", NO_LINK, spec)]
        out.append(_record(item["from_key"], "ok", [_whole(x) for x in links], None, label, reply.get("notes")))
    return out


def _now() -> str:
    return datetime.now(UTC).isoformat()


def _link(kind: str, evidence: str, spec: Spec) -> dict:
    return {"to_key": None, "link_type": kind, "relationship": "unknown", "score": 0.0, "evidence": evidence if spec.evidence else None, "reason": "" if spec.reason else None}


def _whole(x: dict) -> dict:
    return {"to_key": x.get("to_key"), "link_type": str(x.get("link_type", "unknown")), "relationship": str(x.get("relationship") or "unknown"), "score": float(x.get("score", 0.0)), "evidence": x.get("evidence"), "reason": x.get("reason")}


def _record(key: str | None, status: str, links: list[dict], error: str | None, label: str, notes: str | None = None) -> dict:
    return {"from_key": key, "match_stage": "ai", "status": status, "links": links, "error": error, "batch": label, "logged_at": _now(), "notes": None if notes is None else str(notes)[:NOTE_CHARS]}


def python_decisions(items: DataFrame, adjudicator: Adjudicator, spec: Spec, *, callers: int = CALLERS) -> DataFrame:
    """Decisions of an adjudicator on batch_items. Tasks may run again, so write the result before using it.

    At most `callers` tasks ask, each with an adjudicator of its own for all of its batches. A fatal error ends the
    asking of its task and becomes a record without a key (status "fatal"), so that the answers made before it are kept.
    """

    def run(frames):
        stopped = False
        for label, rows in _batches(frames):
            if stopped:
                continue
            items_ = [json.loads(i) | {"candidates": [json.loads(c) for c in cs]} for i, cs in zip(rows["item"], rows["candidates"])]
            try:
                records = adjudicate_batch(adjudicator, items_, str(label + 1), spec)
            except FatalError as error:
                stopped, records = True, [_record(None, "fatal", [], f"{type(error).__name__}: {error}", str(label + 1))]
            yield pd.DataFrame(records, columns=[c.split()[0] for c in ("from_key", "match_stage", "status", "links", "error", "batch", "logged_at", "notes")])

    return items.repartition(callers, "batch").sortWithinPartitions("batch", "place").mapInPandas(run, DECISION)


def _batches(frames):
    """Whole batches of frames that are sorted by batch, however they were cut."""
    held = None
    for frame in frames:
        held = frame if held is None else pd.concat([held, frame], ignore_index=True)
        last = held["batch"].iloc[-1]
        done = held[held["batch"] != last]
        for label, rows in done.groupby("batch", sort=True):
            yield int(label), rows
        held = held[held["batch"] == last]
    if held is not None and len(held):
        yield int(held["batch"].iloc[0]), held


def raise_fatal(decisions: DataFrame, since: str) -> None:
    """Raise the first fatal error that was recorded since then."""
    first = decisions.where((F.col("status") == "fatal") & (F.col("logged_at") >= since)).select("error").head()
    if first:
        kind, _, text = first["error"].partition(": ")
        raise (QuotaError if kind == "QuotaError" else FatalError)(text)


def notes_of(items: DataFrame, decisions: DataFrame, since: str) -> DataFrame:
    """(from_key, candidate_keys, status, notes, error, logged_at) of the items decided since then; those without candidates are skipped."""
    made = decisions.where((F.col("match_stage") == "ai") & (F.col("batch") != "cache") & (F.col("logged_at") >= since)).select("from_key", "status", "notes", "error", "logged_at")
    keys = F.transform("candidates", lambda c: F.get_json_object(c, "$.to_key"))
    asked = F.size("candidates") > 0
    return items.join(made, "from_key").select("from_key", keys.alias("candidate_keys"), F.when(asked, F.col("status")).otherwise("skipped").alias("status"), F.substring(F.coalesce("notes", F.lit("")), 1, NOTE_CHARS).alias("notes"), F.coalesce("error", F.lit("")).alias("error"), "logged_at")


def answer_key(spec: Spec) -> Column:
    """What an item's answer depends on: model, settings, prompt version and the item with its candidates."""
    settings = "|".join(map(str, (spec.model, spec.temperature, spec.seed, spec.enable_search, PROMPT_VERSION, spec.country, spec.year_from, spec.year_to, spec.relationship, spec.evidence, spec.reason)))
    return F.sha2(F.concat_ws("\x00", F.lit(settings), "item", F.array_join("candidates", "\x01")), 256)


def known_answers(items: DataFrame, cache: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """Decisions of items that the cache (key, links, logged_at) answers, its latest answer each; and the other items."""
    keyed = items.withColumn("key", answer_key(spec))
    last = cache.groupBy("key").agg(F.max_by("links", "logged_at").alias("links"))
    hits = keyed.join(last, "key").select("from_key", F.lit("ai").alias("match_stage"), F.lit("ok").alias("status"), "links", F.lit(None).cast("string").alias("error"), F.lit("cache").alias("batch"), F.lit(_now()).alias("logged_at"), F.lit(None).cast("string").alias("notes"))
    return hits, keyed.join(last, "key", "left_anti").drop("key")


def new_answers(items: DataFrame, decisions: DataFrame, spec: Spec) -> DataFrame:
    """Rows (key, links, logged_at) for the cache from decisions that were just made."""
    made = decisions.where("status = 'ok' AND match_stage = 'ai' AND batch <> 'cache'").select("from_key", "links", "logged_at")
    return items.withColumn("key", answer_key(spec)).join(made, "from_key").select("key", "links", "logged_at")
