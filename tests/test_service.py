import json
import sys

import pytest
from pyspark import cloudpickle

from kinweave import config
from kinweave.guard import guarded
from kinweave.operators import service as S
from kinweave.operators.adjudicate import FatalError, QuotaError, TransientError
from kinweave.plans import pipeline
from kinweave.plans.spec import Spec
from kinweave.plans.store import DecisionLog
from kinweave.session import materialize, shared_folder, temporary_tables
from kinweave.sources.files import exists, read_document, read_table, read_text, spans_lines

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPEC = Spec("X", 1, 2, "n")
GOOD = json.dumps({"decisions": [{"from_key": "f", "links": [{"to_key": None, "link_type": "no_match", "relationship": "unknown", "score": 0}]}]})
UNIT = "ord long, state string, subdistrict string"
OPTIONS = {"country": "X", "year_from": 1, "year_to": 2, "map_col_from": "subdistrict", "exact_match": ["state"], "order_from": ["ord"], "order_to": ["ord"]}


def table(spark, names):
    return spark.createDataFrame([(i, "S", n) for i, n in enumerate(names)], UNIT)


def service(*replies, **more):
    said, asked = list(replies), []

    def ask(prompt, *_):
        asked.append(prompt)
        reply = said.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply

    return S.ServiceAdjudicator(ask, base=0, jitter=0, spacing=0, **{k: ask if v is True else v for k, v in more.items()}), asked


def test_the_ladder():
    one, asked = service("nothing", "{}", GOOD, structured=True)
    assert one.decide([], SPEC)[0]["from_key"] == "f" and len(asked) == 3 and "can't be used" in asked[2]
    one, asked = service(TransientError(), TransientError(), GOOD, searching=True)
    assert one.decide([], SPEC) and len(asked) == 3  # a search is tried twice, then the plain request
    one, asked = service(TransientError(), TransientError(), TransientError(), searching=True, attempts=1)
    with pytest.raises(TransientError):
        one.decide([], SPEC)
    one, _ = service('{"event_type": "Split", "lineage_hint": "New"}', "free text")
    assert one.research({}, SPEC) == {"event_type": "split", "lineage_hint": "New", "notes": ""} and one.text("x") == "free text"
    one, _ = service('{"primary_key": "p", "selected_secondary_keys": ["a"], "link_type": "Exact match", "score": 0.5}')
    assert one.choose({}, {}, [], SPEC)["link_type"] == "rename"


def test_strict_keys_schema_and_status():
    for bad in ({"decisions": [], "more": 1}, [{"from_key": "f", "links": [], "extra": 1}], [{"from_key": "f"}]):
        with pytest.raises((ValueError, KeyError)):
            S.decisions_of(bad, SPEC)
    with pytest.raises(ValueError):
        S.research_of({"event_type": "eaten"})
    schema = {"title": "T", "anyOf": [{"type": "string"}, {"type": "null"}], "items": [{"default": 1, "type": "integer"}]}
    assert S.plain_schema(schema) == {"type": ["string", "null"], "items": [{"type": "integer"}]}
    assert "evidence" in str(S.reply_schema(Spec("X", 1, 2, "n", evidence=True))) and "evidence" not in str(S.reply_schema(SPEC))
    error = lambda **k: type("E", (Exception,), k)("")
    assert [type(S.classify(error(**k))) for k in ({"status_code": 503}, {"status": "RESOURCE_EXHAUSTED", "code": 429}, {"status": 402}, {"status": "NOT_FOUND", "code": 404})] == [TransientError, QuotaError, QuotaError, FatalError]


def test_guard():
    run = lambda code, **k: guarded([sys.executable, "-c", code], **k)
    assert run("print('a'); print('b')").lines == ["a", "b"] and run("import sys; sys.exit(3)").code == 3
    assert run("import time; time.sleep(30)", stall_seconds=0.5).reason == "stalled"
    assert run("import time\nwhile True: print(1, flush=True); time.sleep(0.1)", stall_seconds=5, total_seconds=1).reason == "timeout"


def test_tables_are_dropped_early(spark):
    with temporary_tables(spark) as kept:
        gone, stays = materialize(spark.range(3)), materialize(spark.range(4))
        kept.append(stays)
    assert stays.count() == 4 and not exists(spark, gone.kept_at) and shared_folder(spark)


def test_csv_is_split_unless_values_span_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"a ""b"", c"\n2,d\n')
    (tmp_path / "b.csv").write_text('x,y\n1,"a\nb"\n')
    assert not spans_lines(spark, str(tmp_path / "a.csv")) and spans_lines(spark, str(tmp_path / "b.csv"))
    assert [tuple(r) for r in read_table(spark, tmp_path / "a.csv").collect()] == [(1, 'a "b", c'), (2, "d")] and read_table(spark, tmp_path / "b.csv").first()["y"] == "a\nb"


def test_configuration(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# c\nexport KIN_A='1'\nKIN_B=2\nnothing\n")
    monkeypatch.setenv("KIN_B", "own")
    monkeypatch.delenv("KIN_A", raising=False)
    (tmp_path / "deep").mkdir()
    assert config.load_env(tmp_path / "deep") == tmp_path / ".env" and (config.os.environ["KIN_A"], config.os.environ["KIN_B"]) == ("1", "own")
    (tmp_path / "own_service.py").write_text("class A:\n    def decide(self, items, spec): return []\ndef make(params): return A()\n")
    request = {"country": "X", "year_from": 1, "year_to": 2, "map_col_from": "n"}
    content = {"request": request, "data": {"from_path": "a.csv", "to_path": "b.csv"}, "retry": {"max_attempts": 2}, "cache": {"path": "answers"}, "llm": {"provider": "python_hook", "callable": "own_service:make"}}
    options = config.parse_config(content, tmp_path).run_options()
    assert options["retry"]["max_attempts"] == 2 and options["cache_dir"] == str(tmp_path / "answers") and type(options["adjudicator"]).__name__ == "A"
    for wrong in ({"llm": {"provider": "python_hook"}}, {"llm": {"provider": "other"}}, {"cache": {"backend": "x"}}, {"cache": {"colour": 1}}):
        with pytest.raises(ValueError):
            config.parse_config(content | wrong, tmp_path)


class Noting:
    """Writes down which units it is asked about; its quota ends at one of them."""

    def __init__(self, path, ends_at=None):
        self.path, self.ends_at = path, ends_at

    def decide(self, items, spec):
        for item in items:
            if item["from_key"] == self.ends_at:
                raise QuotaError("used up")
            with open(self.path, "a") as out:
                out.write(item["from_key"] + "\n")
        return [{"from_key": i["from_key"], "links": [{"to_key": i["candidates"][0]["to_key"], "link_type": "rename", "relationship": "x", "score": 0.9}], "notes": "seen"} for i in items]


def test_answers_made_before_an_abort_are_kept(spark, tmp_path):
    names = [f"Unit {c}" for c in "abcdefgh"]
    sides, run = (table(spark, names), table(spark, [f"{n} New" for n in names])), {"callers": 1, "output_dir": f"file:{tmp_path}/out"}
    with pytest.raises(QuotaError, match="used up"):
        pipeline.run(*sides, OPTIONS | {"batch_size": 1}, adjudicator=Noting(f"{tmp_path}/asked", "from_5"), **run)
    before = (tmp_path / "asked").read_text().split()
    assert "from_5" not in before and len(before) >= 1 and "broke off" in read_text(spark, f"file:{tmp_path}/out/x_1_2_subdistrict/run.log")
    result = pipeline.run(*sides, OPTIONS | {"batch_size": 1}, adjudicator=Noting(f"{tmp_path}/asked"), **run)
    after = (tmp_path / "asked").read_text().split()
    assert sorted(after) == sorted({f"from_{i}" for i in range(8)}) and result.crosswalk.where("merge = 'both'").count() == 8
    counts = result.metadata["counts"]
    assert counts["grounding_attempted_rows"] == counts["grounded_rows"] == 8 - len(before) and counts["grounding_failed_rows"] == 0
    log = DecisionLog(spark, f"file:{tmp_path}/out/x_1_2_subdistrict", "other", "decisions", "from_key string")
    assert [r["run_id"] for r in log.runs().collect()] == [result.metadata["run_id"]] and log.read().count() == 0


class Researching(Noting):
    def decide(self, items, spec):
        return [{"from_key": i["from_key"], "links": []} for i in items]

    def research(self, item, spec):
        if item["primary_name"] == "Broken":
            raise RuntimeError("no answer")
        return {"event_type": "split", "lineage_hint": "Ayodhya", "notes": "renamed"} if item["primary_name"] == "Faizabad" else {"event_type": "unknown", "lineage_hint": ""}

    def choose(self, item, research, candidates, spec):
        assert all({"secondary_id", "matched_term"}.isdisjoint(c) for c in candidates)
        return {"selected_secondary_keys": ["to_0", "to_77", "to_1", "to_0"], "link_type": "split", "relationship": "father_to_child", "score": 0.8}


@pytest.mark.parametrize("scheme", ["", "file:"])
def test_the_second_stage_asks_and_keeps_to_the_shortlist(spark, tmp_path, scheme):
    out = {"output_dir": f"{scheme}{tmp_path}/out", "replay_dir": f"{scheme}{tmp_path}/store"}
    sides = table(spark, ["Faizabad", "Quiet", "Same"]), table(spark, ["Ayodhya East", "Ayodhya West", "Same"])
    options = OPTIONS | {"string_exact_match_prune": "from", "exact_match": []}
    result = pipeline.run(*sides, options, adjudicator=Researching("x"), **out)
    rows = sorted((r["from_key"] or "", r["to_key"] or "", r["merge"], r["lineage_hint"]) for r in result.crosswalk.collect())
    assert rows == [("from_0", "to_0", "both", "Ayodhya"), ("from_0", "to_1", "both", "Ayodhya"), ("from_1", "", "only_in_from", ""), ("from_2", "to_2", "both", "")]
    again = pipeline.run(*sides, options, adjudicator=Researching("x"), **(out | {"output_dir": f"{scheme}{tmp_path}/b"}))
    assert again.metadata["replay_hit"] and read_document(spark, f"{tmp_path}/b/x_1_2_subdistrict/run_metadata.json")["replay_hit"]
    assert spark.read.parquet(f"{tmp_path}/b/x_1_2_subdistrict/second_stage").count() == 2
    failing = pipeline.run(table(spark, ["Broken"]), sides[1], options, adjudicator=Researching("x"), **out)
    assert failing.metadata["counts"]["second_stage_failed_rows"] == 1 and any("tries them again" in w for w in failing.warnings)
