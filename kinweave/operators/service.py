"""An adjudicator that asks a text service: prompt, pace, retries, lenient reading of replies, one repair."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from typing import Any

from kinweave.operators.adjudicate import FatalError, QuotaError, TransientError, with_retries
from kinweave.plans.spec import LINK_TYPES, PROMPT_VERSION, RELATIONSHIPS, Spec

#: The line after which a prompt has its payload.
MARKER = "INPUT_PAYLOAD_JSON:\n"

# What a service's errors mean.
SPENDING = ("spending cap", "spending limit", "budget exceeded", "budget exhausted", "insufficient balance", "credit balance", "payment required", "billing account", "billing has not been enabled")
QUOTA = ("quota", "resource exhausted", "resource_exhausted", "usage limit", "limit exceeded")
RATE = ("rate limit", "too many requests")
PASSING_CODES = (408, 409, 425, 500, 502, 503, 504)
PASSING = (
    "temporarily unavailable", "try again later", "timeout", "timed out", "connection reset", "connection aborted", "connection refused", "connection closed", "connection terminated", "remote protocol error", "server disconnected without sending a response",
    "stream ended unexpectedly", "service unavailable", "getaddrinfo failed", "temporary failure in name resolution", "name or service not known", "nodename nor servname provided", "failed to establish a new connection",
)
ALIASES = {"exact_match": "rename"}
NULL_KEYS = ("null", "none")
EVENT_TYPES = ("rename", "split", "merge", "transfer", "dissolved", "unknown")
DESCRIPTIVE = ("default", "examples", "description", "title")
SEARCH_ATTEMPTS = 2


def classify(error: Exception) -> Exception:
    """A quota error for money and quota, a transient one for pace and transport, else a fatal one."""
    code, text = _code(error), f"{getattr(error, 'status', '')} {error}".lower()
    has = lambda terms: any(t in text for t in terms)
    paid = has(SPENDING)
    if code == 402 or paid or (code == 403 and has(QUOTA)) or (code == 429 and has(QUOTA) and not has(RATE)):
        return QuotaError(str(error))
    if code == 429 or code in PASSING_CODES or has(PASSING):
        return TransientError(str(error))
    return FatalError(str(error))


def _code(error: Exception) -> int | None:
    """The HTTP code of an error, whichever attribute has it."""
    found = (getattr(error, name, None) for name in ("code", "status_code", "status"))
    return next((c for c in found if isinstance(c, int)), None)


def read_reply(text: str) -> Any:
    """The JSON of a reply: the whole text, a fenced block, or what the outermost braces or brackets hold."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.DOTALL)
    tries = [text, fenced.group(1) if fenced else ""]
    tries += [text[text.find(a) : text.rfind(b) + 1] for a, b in ("{}", "[]") if a in text]
    for part in tries:
        try:
            return json.loads(part.strip())
        except ValueError:
            continue
    raise ValueError("the reply holds no JSON")


def _token(value: Any) -> str:
    return str(value).strip().lower().replace("-", "_").replace(" ", "_")


def normal_link(link: dict[str, Any], spec: Spec) -> dict[str, Any]:
    """A link with its enumerations in their own spelling and textual nulls as null; ValueError if it isn't one."""
    allowed = {"to_key", "link_type", "relationship", "score"} | {k for k in ("evidence", "reason") if getattr(spec, k)}
    if unknown := set(link) - allowed:
        raise ValueError(f"unknown keys in a link: {sorted(unknown)}")
    kind, relationship, score = _token(link["link_type"]), _token(link["relationship"]), float(link["score"])
    kind = ALIASES.get(kind, kind)
    if kind not in LINK_TYPES or relationship not in RELATIONSHIPS or not 0 <= score <= 1:
        raise ValueError(f"not a link: {link}")
    key = link.get("to_key")
    return link | {"link_type": kind, "relationship": relationship, "score": score, "to_key": None if key is None or _token(key) in NULL_KEYS else key}


def _only(given: dict[str, Any], needed: tuple[str, ...], more: tuple[str, ...] = ()) -> dict[str, Any]:
    if set(given) - {*needed, *more} or set(needed) - set(given):
        raise ValueError(f"keys must be {sorted({*needed, *more})}, not {sorted(given)}")
    return given


def decisions_of(reply: Any, spec: Spec) -> list[dict[str, Any]]:
    rows = _only(reply, ("decisions",))["decisions"] if isinstance(reply, dict) else reply
    return [{"from_key": r["from_key"], "links": [normal_link(x, spec) for x in r["links"]]} for r in (_only(r, ("from_key", "links"), ("notes",)) for r in rows)]


def research_of(reply: Any) -> dict[str, Any]:
    _only(reply, ("event_type",), ("lineage_hint", "notes"))
    kind = _token(reply["event_type"])
    if kind not in EVENT_TYPES:
        raise ValueError(f"no event: {reply['event_type']!r}")
    return {"event_type": kind, "lineage_hint": str(reply.get("lineage_hint") or ""), "notes": str(reply.get("notes") or "")}


def choice_of(reply: Any, spec: Spec) -> dict[str, Any]:
    _only(reply, ("primary_key", "link_type", "score"), ("selected_secondary_keys", "relationship", "evidence", "reason"))
    link = normal_link({"link_type": reply["link_type"], "relationship": reply.get("relationship") or "unknown", "score": reply["score"]}, spec)
    return {"selected_secondary_keys": [str(k) for k in reply.get("selected_secondary_keys") or []], "evidence": str(reply.get("evidence") or ""), "reason": str(reply.get("reason") or "")} | {k: link[k] for k in ("link_type", "relationship", "score")}


def reply_schema(spec: Spec) -> dict[str, Any]:
    """The JSON schema of a batch's reply, for services that take one."""
    one = lambda kind, **more: {"type": kind} | more
    link = {"to_key": one(["string", "null"]), "link_type": one("string", enum=list(LINK_TYPES)), "relationship": one("string", enum=list(RELATIONSHIPS)), "score": one("number", minimum=0, maximum=1)} | {k: one("string") for k in ("evidence", "reason") if getattr(spec, k)}
    whole = lambda properties: one("object", properties=properties, required=list(properties), additionalProperties=False)
    return whole({"decisions": one("array", items=whole({"from_key": one("string"), "links": one("array", items=whole(link))}))})


def plain_schema(schema: Any) -> Any:
    """A JSON schema without what services refuse: descriptive keys go, an anyOf of bare types becomes a list of types."""
    if isinstance(schema, list):
        return [plain_schema(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    kept = {k: plain_schema(v) for k, v in schema.items() if k not in DESCRIPTIVE}
    options = kept.get("anyOf")
    if options and all(isinstance(o, dict) and set(o) == {"type"} and isinstance(o["type"], str) for o in options):
        types = [o["type"] for o in options]
        kept = {k: v for k, v in kept.items() if k != "anyOf"} | {"type": types if len(types) > 1 else types[0]}
    return kept


def _payload(spec: Spec, **more: Any) -> str:
    base = {"schema_version": PROMPT_VERSION, "country": spec.country, "year_from": spec.year_from, "year_to": spec.year_to}
    return f"{MARKER}{json.dumps(base | more, ensure_ascii=False, sort_keys=True, default=str)}"


def _texts(spec: Spec) -> str:
    return "".join(f', "{k}": text' for k in ("evidence", "reason") if getattr(spec, k))


def batch_prompt(items: list[dict[str, Any]], spec: Spec) -> str:
    """Instructions and, after the marker, the payload of a batch."""
    return (
        f"Decide for each unit of {spec.year_from} which units of {spec.year_to} in {spec.country} continue it. Choose only among its candidates; give one link per unit it became, or one with to_key null.\n"
        f'Answer with JSON only: {{"decisions": [{{"from_key": key, "links": [{{"to_key": key or null, "link_type": one of {list(LINK_TYPES)}, "relationship": one of {list(RELATIONSHIPS)}, "score": 0 to 1{_texts(spec)}}}]}}]}}\n'
        + _payload(spec, exact_match=list(spec.exact_match), requested_relationship=spec.relationship, include_evidence=spec.evidence, include_reason=spec.reason, items=items)
    )


def research_prompt(item: dict[str, Any], spec: Spec) -> str:
    return (
        f"Find out what became of one unit of {spec.country} between {spec.year_from} and {spec.year_to}, or what it was before, and name the one predecessor or successor that is worth looking for. If sources are weak, say unknown and leave the hint empty.\n"
        f'Answer with JSON only: {{"event_type": one of {list(EVENT_TYPES)}, "lineage_hint": name or "", "notes": short facts}}\n' + _payload(spec, primary_item=item)
    )


def choice_prompt(item: dict[str, Any], research: dict[str, Any], candidates: list[dict[str, Any]], spec: Spec) -> str:
    return (
        "Decide which of the candidates continue this unit, by what was found out about it. Take none if nothing speaks for one, several if it was split or merged.\n"
        f'Answer with JSON only: {{"primary_key": key, "selected_secondary_keys": list of candidates\' keys, "link_type": one of {list(LINK_TYPES)}, "relationship": one of {list(RELATIONSHIPS)}, "score": 0 to 1{_texts(spec)}}}\n'
        + _payload(spec, requested_relationship=spec.relationship, include_evidence=spec.evidence, include_reason=spec.reason, primary_item=item, lineage_research=research, candidate_subset=candidates)
    )


class ServiceAdjudicator:
    """Asks a text service. ask(prompt) gives its text; structured(prompt, schema), if there is one, is tried before, and
    searching(prompt), which may look things up, before that where the request allows it.

    A reply that can't be used leads to the next of them, at last to one request to mend it. Calls of one task keep
    `spacing` seconds apart; searches are tried twice at most.
    """

    def __init__(
        self, ask: Callable[[str], str], *, structured: Callable[[str, dict], str] | None = None, searching: Callable[[str], str] | None = None, attempts: int = 6, base: float = 1.0, most: float = 20.0, jitter: float = 0.2, spacing: float = 0.5
    ) -> None:
        self.ask, self.structured, self.searching = ask, structured, searching
        self.attempts, self.base, self.most, self.jitter, self.spacing, self.last = attempts, base, most, jitter, spacing, 0.0

    def retry_with(self, *, max_attempts: int, base_delay_seconds: float, max_delay_seconds: float, jitter_seconds: float) -> ServiceAdjudicator:
        return ServiceAdjudicator(self.ask, structured=self.structured, searching=self.searching, attempts=max_attempts, base=base_delay_seconds, most=max_delay_seconds, jitter=jitter_seconds, spacing=self.spacing)

    def _call(self, call: Callable[[], str]) -> str:
        time.sleep(max(0.0, self.last + self.spacing - time.monotonic()))
        self.last = time.monotonic()
        try:
            return call()
        except (TransientError, FatalError):
            raise
        except Exception as error:
            raise classify(error) from error

    def _text(self, call: Callable[[], str], attempts: int) -> str:
        return with_retries(lambda: self._call(call), attempts=attempts, base=self.base, most=self.most, jitter=self.jitter)

    def _reply(self, prompt: str, read: Callable[[Any], Any], *, schema: dict | None = None, search: bool = False) -> Any:
        rungs = [(lambda: self.searching(prompt), min(self.attempts, SEARCH_ATTEMPTS))] if search and self.searching else []
        rungs += [(lambda: self.structured(prompt, plain_schema(schema)), self.attempts)] if schema and self.structured else []
        rungs.append((lambda: self.ask(prompt), self.attempts))
        text, problem = "", None
        for i, (call, attempts) in enumerate(rungs):
            try:
                text = self._text(call, attempts)
                return read(read_reply(text))
            except (ValueError, KeyError, TypeError) as error:
                problem = error
            except TransientError:
                if i == len(rungs) - 1:
                    raise
        return read(read_reply(self.text(f"{prompt}\n\nThis reply can't be used ({problem}); give it again as the JSON asked for:\n{text}")))

    def text(self, prompt: str) -> str:
        """The service's text, whatever it is."""
        return self._text(lambda: self.ask(prompt), self.attempts)

    def decide(self, items: list[dict], spec: Spec) -> list[dict]:
        return self._reply(batch_prompt(items, spec), lambda reply: decisions_of(reply, spec), schema=reply_schema(spec), search=spec.enable_search)

    def research(self, item: dict, spec: Spec) -> dict:
        return self._reply(research_prompt(item, spec), research_of, search=True)

    def choose(self, item: dict, research: dict, candidates: list[dict], spec: Spec) -> dict:
        return self._reply(choice_prompt(item, research, candidates, spec), lambda reply: choice_of(reply, spec))
