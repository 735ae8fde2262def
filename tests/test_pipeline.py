import json
import sys

import pytest
from pyspark import cloudpickle

from kinweave import api, cli
from kinweave.config import parse_config
from kinweave.operators.adjudicate import QuotaError, TransientError, with_retries
from kinweave.plans import pipeline
from kinweave.plans.identity import fingerprint, slug
from kinweave.sources.files import export_crosswalk, read_jsonl, read_table, resolve

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers can't import tests

UNIT = "ord long, state string, district string, subdistrict string, unit_id string"
FROM = [("S1", "D1", "North Block", "f1"), ("S1", "D1", "East Circle", "f2"), ("S1", "D2", "River Tehsil", "f3")]
TO = [("S1", "D1", "North Block", "t1"), ("S1", "D1", "East Circle New", "t2"), ("S1", "D2", "River Tehsil", "t3"), ("S1", "D3", "Unrelated", "t4")]
OPTIONS = {"country": "India", "year_from": 2001, "year_to": "2011", "map_col_from": "subdistrict", "exact_match": ["state", "district"], "id_col_from": "unit_id", "id_col_to": "unit_id", "order_from": ["ord"], "order_to": ["ord"]}


def table(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], UNIT)


def go(spark, tmp_path, rows_from=FROM, rows_to=TO, run=None, **options):
    return pipeline.run(table(spark, rows_from), table(spark, rows_to), OPTIONS | options, output_dir=tmp_path, **(run or {}))


def merges(result):
    return sorted((r["from_name"] or "", r["to_name"] or "", r["merge"], r["link_type"]) for r in result.crosswalk.collect())


def test_sample_run(spark, tmp_path):
    result = go(spark, tmp_path, evidence=True, reason=True)
    assert merges(result) == [("", "Unrelated", "only_in_to", "unknown"), ("East Circle", "East Circle New", "both", "rename"), ("North Block", "North Block", "both", "rename"), ("River Tehsil", "River Tehsil", "both", "rename")]
    assert result.crosswalk.columns == [*api.output_schema(evidence=True)["crosswalk_columns"], "state", "district", "review_flags", "review_reason"]
    row = next(r for r in result.crosswalk.collect() if r["merge"] == "only_in_to")
    assert row["constraints_passed"] == {"target_only_row": True} and row["review_reason"] == "low_score,type_needs_review" and row["to_id"] == "t4" and row["lineage_hint"] == ""
    counts = result.metadata["counts"]
    assert (counts["rows"], counts["from_units"], counts["to_units"], counts["from_rows_input"]) == (4, 3, 4, 3)
    assert result.metadata["coverage_by_group"]["('S1', 'D3')"] == {"from_units": 0, "matched_from_units": 0, "unmatched_from_units": 0}
    written = json.loads((tmp_path / "india_2001_2011_subdistrict" / "run_metadata.json").read_text())
    assert written["run_id"] == result.metadata["run_id"] and len(written["run_id"]) == 16
    assert read_table(spark, tmp_path / "india_2001_2011_subdistrict" / "evolution_key.csv").count() == 4
    assert read_table(spark, tmp_path / "india_2001_2011_subdistrict" / "evolution_key.parquet").count() == 4


def test_unmatched_on_both_sides(spark, tmp_path):
    result = go(spark, tmp_path, [("S", "D1", "North Block", "f1"), ("S", "D9", "Missing Source", "f2")], [("S", "D1", "North Block", "t1"), ("S", "D3", "Unrelated", "t2")])
    assert sorted(m for *_, m, _ in merges(result)) == ["both", "only_in_from", "only_in_to"]


def test_copies_and_validation(spark):
    rows = [("S", "D1", "North Block", "a"), ("S", "D1", "north  block", "b"), ("S", "D2", "North Block", "c")]
    report = api.validate_inputs(table(spark, rows), table(spark, TO), **OPTIONS)
    assert report["valid"] and report["from_rows_effective"] == 2 and report["collapse_reports"]["from"]["sample_keys"] == [{"state": "s", "district": "d1", "subdistrict": "north block"}]
    assert any("overlap" in w for w in report["warnings"]) and any(w.startswith("df_from: 1 of 3 rows repeat") for w in report["warnings"])
    bad = api.validate_inputs(table(spark, FROM), table(spark, TO), **OPTIONS | {"map_col_from": "missing", "country": " ", "exact_match": ["nowhere"], "id_col_to": "none"})
    assert not bad["valid"] and len(bad["errors"]) == 6 and bad["errors"][1].startswith("map_col_from")
    with pytest.raises(ValueError):
        api.build_evolution_key(table(spark, FROM), table(spark, TO), **OPTIONS | {"map_col_from": "missing"})


def test_preview(spark):
    plan = api.preview_plan(table(spark, FROM), table(spark, TO), **OPTIONS | {"string_exact_match_prune": "from"})
    assert plan["valid"] and (plan["from_rows"], plan["to_rows"], plan["exact_string_matches"], plan["avg_candidates"]) == (1, 4, 2, 2.0) and plan["groups"] == {"('s1', 'd1')": 1}
    assert api.preview_plan(table(spark, FROM), table(spark, TO), **OPTIONS)["exact_string_matches"] == 0
    assert not api.preview_plan(table(spark, FROM), table(spark, TO), **OPTIONS | {"country": ""})["valid"]


class Scripted:
    """Fails for batches of more than one item and for some rows; picks a target outside the list for others."""

    def decide(self, items, spec):
        if len(items) > 1:
            raise TransientError("too many")
        key = items[0]["from_key"]
        if key == "from_0":
            raise RuntimeError("broken row")
        if key == "from_1":
            return [{"from_key": key, "links": [{"to_key": "to_999", "link_type": "rename", "relationship": "x", "score": 0.7}]}]
        return [{"from_key": key, "links": []}]


class Exhausted:
    def decide(self, items, spec):
        raise QuotaError("quota")


class TopTwo:
    def decide(self, items, spec):
        return [{"from_key": i["from_key"], "links": [{"to_key": c["to_key"], "link_type": "split", "relationship": "father_to_child", "score": c["score"]} for c in i["candidates"][:2]]} for i in items]


def test_adjudicator_failures(spark, tmp_path):
    result = go(spark, tmp_path, run={"adjudicator": Scripted()}, batch_size=3, evidence=True, reason=True)
    by = {r["from_key"]: r for r in result.crosswalk.where("from_key IS NOT NULL").collect()}
    assert by["from_0"]["evidence"] == "Adjudication failed after retries: broken row" and by["from_0"]["link_type"] == "unknown"
    assert by["from_1"]["to_key"] is None and by["from_1"]["reason"] == "The chosen target was not present in the candidate list." and not by["from_1"]["constraints_passed"]["candidate_membership"]
    assert by["from_2"]["link_type"] == "no_match" and by["from_2"]["evidence"] == "No valid link selected by model."
    assert result.metadata["counts"]["error_from_rows"] == 1
    with pytest.raises(Exception, match="quota"):
        go(spark, tmp_path / "q", run={"adjudicator": Exhausted()})


def test_many_links_and_resume(spark, tmp_path):
    result = go(spark, tmp_path, run={"adjudicator": TopTwo()})
    assert sum(r["from_key"] == "from_0" for r in result.crosswalk.collect()) == 2 and {r["relationship"] for r in result.crosswalk.where("merge = 'both'").collect()} == {"father_to_child"}

    class TopTwoAgain(Exhausted):
        pass

    TopTwoAgain.__name__ = "TopTwo"
    again = go(spark, tmp_path, run={"adjudicator": TopTwoAgain()})  # every row is decided already
    assert merges(again) == merges(result) and again.metadata["run_id"] == result.metadata["run_id"]


def test_replay(spark, tmp_path):
    run = {"replay_dir": tmp_path / "store"}
    first, second = go(spark, tmp_path / "a", run=run), go(spark, tmp_path / "b", run=run)
    assert not first.metadata["replay_hit"] and second.metadata["replay_hit"] and merges(first) == merges(second)
    assert not go(spark, tmp_path / "c", run=run, relationship="child_to_child").metadata["replay_hit"]
    (tmp_path / "store" / first.metadata["replay_key"] / "replay_manifest.json").write_text("{")
    third = go(spark, tmp_path / "d", run=run)
    assert not third.metadata["replay_hit"] and any("Replay bundle" in w for w in third.warnings)


def test_fingerprint_ignores_order(spark):
    a, b = table(spark, FROM), table(spark, FROM).orderBy("ord", ascending=False)
    assert fingerprint(a, ["state", "subdistrict"]) == fingerprint(b, ["state", "subdistrict"]) != fingerprint(table(spark, FROM[:2]), ["state", "subdistrict"])
    assert fingerprint(a.union(a), ["state"]) != fingerprint(a, ["state"]) and slug(" A b/c ") == "a-b-c" and slug("!") == "run"


@pytest.mark.parametrize(("mode", "rows_from", "rows_to", "key", "hint", "scope", "both"), [
    ("from", [("S", "Faizabad")], [("S", "Ayodhya")], "from_0", "Ayodhya", [], 1),
    ("to", [("S", "Allahabad")], [("S", "Prayagraj")], "to_0", "Allahabad", [], 1),
    ("from", [("Old State", "Faizabad")], [("New State", "Ayodhya")], "from_0", "Ayodhya", ["state"], 1),
    ("from", [("S", "Faizabad")], [("S", "Ayodhya")], "from_0", "", [], 0),
])
def test_rescue(spark, tmp_path, mode, rows_from, rows_to, key, hint, scope, both):
    hints = spark.createDataFrame([(key, hint)], "primary_key string, lineage_hint string")
    wide = lambda rows: [(s, None, n, f"id-{n}") for s, n in rows]
    low = type("Unsure", (), {"decide": lambda self, items, spec: [{"from_key": i["from_key"], "links": []} for i in items]})()
    result = go(spark, tmp_path, wide(rows_from), wide(rows_to), run={"hints": hints, "adjudicator": low}, exact_match=scope, string_exact_match_prune=mode)
    rows = result.crosswalk.collect()
    assert sum(r["merge"] == "both" for r in rows) == both and len(rows) == (1 if both else 2)
    if both:
        assert rows[0]["lineage_hint"] == hint and rows[0]["constraints_passed"]["exact_match"] == (not scope) and rows[0]["constraints_passed"]["second_stage"]
    assert result.metadata["counts"]["second_stage_rewritten_rows"] == both


def test_rescue_many_to_one(spark, tmp_path):
    hints = spark.createDataFrame([("from_0", "Unified Tehsil"), ("from_1", "Unified Tehsil")], "primary_key string, lineage_hint string")
    low = type("Unsure", (), {"decide": lambda self, items, spec: []})()
    result = go(spark, tmp_path, [("S", None, "North Tehsil", "a"), ("S", None, "South Tehsil", "b")], [("S", None, "Unified Tehsil", "c")], run={"hints": hints, "adjudicator": low}, exact_match=[], string_exact_match_prune="from")
    assert sorted((r["from_key"], r["to_key"], r["merge"]) for r in result.crosswalk.collect()) == [("from_0", "to_0", "both"), ("from_1", "to_0", "both")]
    off = go(spark, tmp_path / "off", run={"hints": hints}, string_exact_match_prune="from", enable_search=False)
    assert any("rescue is disabled" in w for w in off.warnings)


def test_retries():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise TransientError
        return "done"

    assert with_retries(call, attempts=6, base=1, most=3, jitter=0, sleep=waits.append) == "done" and waits == [1, 2, 3]
    with pytest.raises(TransientError):
        with_retries(lambda: (_ for _ in ()).throw(TransientError()), attempts=2, base=0, most=0, jitter=0)


def test_files_config_and_command_line(spark, tmp_path, capsys):
    for name, rows in (("from", FROM), ("to", TO)):
        table(spark, rows).toPandas().to_csv(tmp_path / f"{name}.csv", index=False)
    request = {k: v for k, v in OPTIONS.items()}
    content = {"request": request, "data": {"mode": "files", "from_path": "from.csv", "to_path": "to.csv"}, "output": {"output_dir": "out"}}
    path = tmp_path / "config.json"
    path.write_text(json.dumps(content))
    assert cli.main(["validate", "--config", str(path)], spark) == 0 and cli.main(["preview", "--config", str(path)], spark) == 0 and cli.main(["run", "--config", str(path)], spark) == 0
    folder = tmp_path / "out" / "india_2001_2011_subdistrict"
    for fmt in ("jsonl", "parquet", "csv"):
        assert cli.main(["export", "--input", str(folder / "evolution_key.parquet"), "--format", fmt], spark) == 0
    assert read_table(spark, folder / "evolution_key_export.parquet").count() == 4
    path.write_text(json.dumps(content | {"request": request | {"map_col_from": "missing"}}))
    assert cli.main(["run", "--config", str(path)], spark) == 2
    capsys.readouterr()
    for wrong in ({"request": request | {"colour": 1}, "data": content["data"]}, {"request": request, "data": {"mode": "files"}}, {"request": request, "data": {"mode": "python_hook"}}, {"more": 1}, [], {"request": request | {"country": ""}, "data": content["data"]}):
        with pytest.raises(ValueError):
            parse_config(wrong)
    with pytest.raises(ValueError):
        export_crosswalk(spark, tmp_path / "x.txt", "csv")
    with pytest.raises(ValueError):
        read_table(spark, tmp_path / "x.txt")
    assert read_jsonl(spark, tmp_path / "none.jsonl", "a int").count() == 0 and resolve("a.csv", "/b") == "/b/a.csv"


def test_loader_hook(spark, tmp_path):
    (tmp_path / "own_loader.py").write_text("def load(spark, params):\n    t = spark.createDataFrame([(0, params['name'])], 'ord long, subdistrict string')\n    return t, t\n\ndef wrong(spark, params):\n    return 1\n")
    config = parse_config({"request": {"country": "X", "year_from": 1, "year_to": 2, "map_col_from": "subdistrict"}, "data": {"mode": "python_hook", "callable": "own_loader:load", "params": {"name": "A"}}}, tmp_path)
    from kinweave.config import load_frames
    from kinweave.sources.files import load_by_hook

    assert load_frames(spark, config)[0].first()["subdistrict"] == "A"
    with pytest.raises(ValueError):
        load_by_hook(spark, "own_loader:wrong", {}, tmp_path)


def test_answers_are_kept_by_content(spark, tmp_path):
    run = {"adjudicator": TopTwo(), "cache_dir": tmp_path / "cache"}
    first = go(spark, tmp_path / "a", run=run)

    class Never(Exhausted):
        pass

    again = go(spark, tmp_path / "b", run=run | {"adjudicator": Never()})  # another run, the same questions
    assert merges(again) == merges(first) and again.metadata["run_id"] != first.metadata["run_id"]
    with pytest.raises(Exception, match="quota"):
        go(spark, tmp_path / "c", run=run | {"adjudicator": Never()}, relationship="child_to_child")


def test_service_replies():
    from kinweave.operators.service import MARKER, ServiceAdjudicator, classify, decisions_of, read_reply
    from kinweave.plans.spec import Spec

    spec = Spec("X", 1, 2, "n")
    link = {"to_key": " None", "link_type": "Exact Match", "relationship": "Father-to-father", "score": 1}
    good = json.dumps({"decisions": [{"from_key": "from_0", "links": [link]}]})
    for text in (good, f"Sure:\n```json\n{good}\n```", f"It is {good} indeed"):
        assert decisions_of(read_reply(text), spec) == [{"from_key": "from_0", "links": [{"to_key": None, "link_type": "rename", "relationship": "father_to_father", "score": 1.0}]}]
    for bad in ({**link, "extra": 1}, {**link, "score": 2}, {**link, "link_type": "other"}):
        with pytest.raises(ValueError):
            decisions_of([{"from_key": "f", "links": [bad]}], spec)
    with pytest.raises(ValueError):
        read_reply("nothing")
    asked = []

    def ask(prompt):
        asked.append(prompt)
        if len(asked) == 1:
            raise OSError("connection reset")
        return "no JSON" if len(asked) == 2 else good

    assert ServiceAdjudicator(ask, base=0, jitter=0, spacing=0).decide([{"from_key": "from_0", "candidates": []}], spec)[0]["links"][0]["link_type"] == "rename"
    assert len(asked) == 3 and json.loads(asked[0].split(MARKER)[1])["items"][0]["from_key"] == "from_0"
    coded = lambda text, code: type("E", (Exception,), {"code": code})(text)
    kinds = [("x", 402), ("quota", 429), ("too many requests, quota", 429), ("x", 503), ("timed out", None), ("quota", 403), ("bad key", 403), ("billing account", None)]
    assert [type(classify(coded(*k))).__name__ for k in kinds] == ["QuotaError", "QuotaError", "TransientError", "TransientError", "TransientError", "QuotaError", "FatalError", "QuotaError"]
