import math
import random
import unicodedata
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave.functions.names import canonical, tokens, trigrams
from kinweave.operators import search
from kinweave.operators import shortlist as shortlist_module
from kinweave.operators.crosswalk import coverage, review_queue, with_flags
from kinweave.operators.exact import exact_matches, prune
from kinweave.operators.order import with_position
from kinweave.operators.prepare import work_frame
from kinweave.operators.shortlist import shortlist
from kinweave.plans.spec import Spec
from kinweave.session import materialize

UNIT = "ord long, state string, district string, subdistrict string, unit_id string"


def spec(**more):
    return Spec(**({"country": "X", "year_from": 1, "year_to": 2, "map_col_from": "subdistrict", "order_from": ("ord",), "order_to": ("ord",)} | more))


def frame(spark, side, rows, s):
    return work_frame(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], UNIT), side, s)


def test_canonical(spark):
    cases = {"  São-Paulo (North)  ": "são paulo north", "Beta  Circle": "beta circle", "पश्चिमी सिंहभूम": "पश च म स हभ म", "Ａ１": "a1", "Ⅱ_x": "ii_x", "": "", None: "", " \t": ""}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "a string, b string").select(canonical(F.col("a")).alias("c"), "b").collect()
    assert [r["c"] for r in rows] == [r["b"] for r in rows]
    assert spark.createDataFrame([("A-b",)], "a string").select(canonical(F.col("a"), compose=False)).first()[0] == "a b"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=30, max_size=30))
def test_nfkc_is_pythons(spark, texts):
    from kinweave.functions.names import nfkc

    known = [t for t in texts if all(unicodedata.category(c) not in ("Cn", "Cs") and c != "\0" for c in t)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in known], "a string").select(nfkc(F.col("a"))).collect()]
    assert got == [unicodedata.normalize("NFKC", t) for t in known]


def test_tokens_and_trigrams(spark):
    row = spark.createDataFrame([("a bc a",), ("",), ("x",)], "n string").select(tokens(F.col("n")).alias("t"), trigrams(F.col("n")).alias("g")).collect()
    assert row[0]["t"] == ["a", "bc"] and row[0]["g"] == ["  a", " a ", "a b", " bc", "bc ", "c a", " a "]
    assert row[1]["t"] == [] and row[1]["g"] == [] and row[2]["g"] == ["  x", " x "]


def test_positions_have_no_gaps(spark):
    rows = spark.range(0, 1000, 1, 7).select((F.lit(5000) - F.col("id")).alias("v"))
    got = with_position(rows, ["v"], "p").orderBy("p").collect()
    assert [r["p"] for r in got] == list(range(1000)) and [r["v"] for r in got] == sorted(r["v"] for r in got)
    assert with_position(rows.limit(0), ["v"], "p").collect() == []


def test_first_row_wins_by_normalized_key(spark):
    s = spec(exact_match=("state",), id_col_from="unit_id")
    rows = [(" State A ", None, "DELHI", "keep-me"), ("state a", None, "delhi", "drop-me"), ("State B", None, "Mumbai", "keep-too"), (None, None, None, "null-1"), (None, None, None, "null-2"), (None, None, "", "empty")]
    got = [(r["key"], r["id"]) for r in frame(spark, "from", rows, s).orderBy("ord").collect()]
    assert got == [("from_0", "keep-me"), ("from_1", "keep-too"), ("from_2", "null-1"), ("from_3", "empty")]


def brute(left, right, k):
    def grams(n):
        p = f"  {n} "
        return Counter(p[i : i + 3] for i in range(len(p) - 2)) if n else Counter()

    def score(a, b):
        ta, tb, ga, gb = set(a.split()), set(b.split()), grams(a), grams(b)
        tok = 1.0 if not ta and not tb else 0.0 if not ta or not tb else len(ta & tb) / len(ta | tb)
        dot = sum(n * gb[g] for g, n in ga.items())
        gram = 1.0 if not ga and not gb else 0.0 if not ga or not gb else dot / math.sqrt(sum(n * n for n in ga.values())) / math.sqrt(sum(n * n for n in gb.values()))
        return round(max(0, min(1, 0.55 * tok + 0.45 * gram)), 6)

    out = []
    for fk, fs, fn in left:
        ranked = sorted((-score(fn, tn), tn, tk) for tk, ts, tn in right if ts == fs)[:k]
        out += [(fk, tk, -s) for s, tn, tk in ranked]
    return sorted(out)


@pytest.mark.parametrize("scoped", [True, False])
def test_shortlist_is_the_brute_force_ranking(spark, scoped):
    s = spec(exact_match=("state",) if scoped else (), max_candidates=3)
    names = ["East Circle", "East Circle New", "East Side", "West Block", "", None, "north-north north", "x", "Zeta", "Circle East"]
    left = [(st_, None, n, None) for st_ in ("A", None, "only") for n in names]
    right = [(st_, None, n, None) for st_ in ("A", None, "other") for n in [*names[:-1], "Alpha", "Beta", "Gamma 1", "Gamma 2"]]
    f, t = frame(spark, "from", left, s), frame(spark, "to", right, s)
    got = shortlist(f, t, s).collect()
    plain = lambda fr: [(r["key"], r["s0"] if scoped else 0, r["canonical"]) for r in fr.collect()]
    assert sorted((r["from_key"], r["to_key"], pytest.approx(r["score"], abs=2e-6)) for r in got) == brute(plain(f), plain(t), 3)
    assert shortlist(f, t.limit(0), s).collect() == [] and shortlist(f.limit(0), t, s).collect() == []


def test_names_without_scope_are_searched_in_blocks(spark, monkeypatch):
    """No row for every feature that two names share, and with blocks of a few names the ranking of all pairs."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(("ka", "thul", "mor", "é", "पश", "zz")) for _ in range(rng.randint(1, 3)))
    names = ["", "upper", "_", "𐎠𐎡", *{f"{word()} {rng.choice(('upper', 'lower', word()))}".strip() for _ in range(60)}]
    s = spec(max_candidates=3)
    f, t = frame(spark, "from", [(None, None, n, None) for n in [*names[::2], "", "upper upper", "qq"]], s), frame(spark, "to", [(None, None, n, None) for n in names], s)
    monkeypatch.setattr(search, "BLOCK", 16), monkeypatch.setattr(search, "ASKED", 8)
    pairs = shortlist(f, t, s)
    plain = lambda fr: [(r["key"], 0, r["canonical"]) for r in fr.collect()]
    assert sorted((r["from_key"], r["to_key"], pytest.approx(r["score"], abs=2e-6)) for r in pairs.collect()) == brute(plain(f), plain(t), 3)
    made: list[set[str]] = []
    monkeypatch.setattr(shortlist_module, "materialize", lambda df, **more: made.append(set(df.columns)) or materialize(df, **more))
    shortlist(f, t, s)
    assert made and not any("feature" in columns for columns in made)


def test_ties_go_to_the_smaller_name_then_key(spark):
    s = spec(max_candidates=12)
    to = frame(spark, "to", [("A", str(i), "Same Name", None) for i in range(12)], spec(exact_match=("district",)))
    got = shortlist(frame(spark, "from", [("A", None, "Same Name", None)], s), to.drop("s0", "x0"), s).orderBy("rank").collect()
    assert [r["to_key"] for r in got] == sorted(f"to_{i}" for i in range(12))


def test_exact_matches_and_pruning(spark):
    rows_from = [("STATE A", None, "DELHI", None), ("STATE A", None, "Delhi Rural", None), ("STATE B", None, "DELHI", None)]
    rows_to = [("state a", None, "delhi", None), ("state a", None, "delhi extension", None), ("state b", None, "delhi", None)]
    for mode, left, right in (("from", {"delhi rural"}, 3), ("to", {"delhi rural"}, 1), ("none", None, 3)):
        s = spec(exact_match=("state",), string_exact_match_prune=mode)
        f, t = frame(spark, "from", rows_from, s), frame(spark, "to", rows_to, s)
        exact = exact_matches(f, t, s)
        assert sorted(map(tuple, exact.collect())) == [("from_0", "to_0"), ("from_2", "to_2")]
        rest_from, rest_to = prune(f, t, exact, s)
        assert {r["canonical"] for r in rest_from.collect()} == (left or {"delhi", "delhi rural"}) and rest_to.count() == right


def test_flags_queue_and_coverage(spark):
    rows = [("A", "B", "from_0", "to_0", 0.8, "rename", "both", "s"), ("C", None, "from_1", None, 0.2, "no_match", "only_in_from", "s"), (None, "T", None, "to_9", 0.0, "unknown", "only_in_to", None)]
    rows += [("F", "x", "from_2", f"to_{i}", 0.9, "split", "both", "s") for i in range(1, 5)] + [(f"G{i}", "y", f"from_{i}", "to_8", 0.9, "merge", "both", "s") for i in range(3, 7)]
    table = spark.createDataFrame(rows, "from_name string, to_name string, from_key string, to_key string, score double, link_type string, merge string, state string")
    reasons = {(r["from_key"], r["to_key"]): r["review_reason"] for r in with_flags(table).collect()}
    assert reasons["from_0", "to_0"] == "" and reasons["from_1", None] == "low_score,type_needs_review" == reasons[None, "to_9"]
    assert reasons["from_2", "to_1"] == "high_fan_out" and reasons["from_3", "to_8"] == "high_fan_in"
    queue = review_queue(with_flags(table)).collect()
    assert queue[0]["from_name"] == "C" and queue[-1]["from_name"] is None and len(queue) == 10
    cover = {r["state"]: (r["from_units"], r["matched_from_units"], r["unmatched_from_units"]) for r in coverage(table, ["state"]).collect()}
    assert cover == {"s": (7, 6, 1), None: (0, 0, 0)}
    assert with_flags(table.limit(0)).count() == 0 and coverage(table, []).count() == 1
