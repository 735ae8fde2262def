"""Groups, mapping to a list, one form, copies, top n."""

import random
import unicodedata
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave.llm import canonical, components, duplicates, topn, visual
from kinweave.llm.names import closing_words, parsed


def groups(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    return {(x, find(x)) for x in parent}


@pytest.mark.parametrize("bound", [12, 100, 10_000])
def test_groups(spark, bound):
    rng = random.Random(5)
    pairs = [(f"from_{rng.randrange(160)}", f"to_{rng.randrange(160)}") for _ in range(110)] + [(f"from_{1000 + i}", f"to_{1000 + i + d}") for i in range(150) for d in (0, 1)]
    pairs += [("from_hub", f"to_h{i}") for i in range(200)] * 2 + [("from_self", "from_self"), (None, "to_1"), ("from_1", None), (None, None)]
    table = spark.createDataFrame([(a, b, "x") for a, b in pairs], "from_key string, to_key string, root string").repartition(6)
    got = components.link_groups(table, "from_key", "to_key", bound=bound).collect()
    assert len(got) == len({r["unit_key"] for r in got}) and {tuple(r) for r in got} == groups(pairs)


def test_groups_of_nothing_and_linking_types(spark):
    schema = "from_key string, to_key string, link_type string"
    assert components.link_groups(spark.createDataFrame([], schema), "from_key", "to_key").collect() == []
    rows = [("f", "t", " Merge\t"), ("f", "t2", "no_match"), ("f", None, "split"), ("f", "t3", None), ("g", "t", "SPLIT ")]
    assert sorted(r["link_type"] for r in components.linking_rows(spark.createDataFrame(rows, schema)).collect()) == [" Merge\t", "SPLIT "]


ENTRIES = [(1, "Kusthulsar Central"), (2, "Kusthulsar North"), (3, "Nurt-Hunza"), (4, "Zotorni"), (5, "Zotörni"), (6, "Norlelsur II"), (7, "Fursürnil Upper"), (8, "Thult-Hanlen Upper"), (9, "Kelkepî Circle"), (10, "Ward"), (11, None)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_typed_names(spark):
    cases = {
        "kusthulsar centr.": 1, "CENTRAL KUSTHLSAR (sub-district)": 1, "Kusthulsra N.": 2, "kusthulsar noth": 2, "Kusthulsar": 0, "Kusthulsar South": 0, "NurtHunza": 3, "Nurt. Hunza, ": 3, "Zotorni": 4, "zotörni": 5, "norlelsur 2nd": 6,
        "Two  Norlelsur": 6, "fursürn1l up": 7, "Ｔｈｕｌｔ－Ｈａｎｌｅｎ Ｕｐｐｅｒ": 8, "Kelk͏epi Cir﻿cle": 9, "test": 0, "#REF!": 0, "Фольгищи": 0, "": 0, "x" * 5000: 0, "Кusthulsar Central": 1, "ward": 10, "Norlelsur II 7": 0,
    }
    typed = spark.createDataFrame([(i, n, "x") for i, n in enumerate([*cases, *cases, None])], "ord long, typed_name string, stem string")
    entries = spark.createDataFrame([(*e, "y") for e in ENTRIES], "canon_id long, unit_name string, stem string")
    got = {r["ord"]: r["canon_id"] for r in canonical.map_to_entries(typed, entries).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values()) and len(got) == 2 * len(cases) + 1 and got[2 * len(cases)] == 0
    assert {r["canon_id"] for r in canonical.map_to_entries(typed, entries.limit(0)).collect()} == {0}
    assert canonical.map_to_entries(typed.limit(0), entries).collect() == []


def test_pigeonhole_join_misses_nothing(spark):
    rng = random.Random(3)
    letters = "abc"
    names = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    entries = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(40)})
    typed = spark.createDataFrame(list(enumerate(names)), "ord long, typed_name string")
    listed = spark.createDataFrame([(i + 1, e) for i, e in enumerate(entries)], "canon_id long, unit_name string")
    got = {r["ord"]: r["canon_id"] for r in canonical.map_to_entries(typed, listed).collect()}
    for i, name in enumerate(names):
        near = [(d, j + 1) for j, e in enumerate(entries) if (d := edits(name, e)) <= min(2, len(e) // 3)]
        assert got[i] == (min(near)[1] if near else 0)


def test_parsed_names(spark):
    rows = spark.createDataFrame([("Upper Thulp-isvir",), ("W. Rolsoskel 12",), ("North",), (None,)], "n string")
    got = spark.sql(parsed("{t}", "n", ["east", "upper", "west"]), t=rows).collect()
    assert [(r["stem"], r["dirs"], r["nums"]) for r in got] == [("thulpisvir", ["upper"], []), ("rolsoskel", ["west"], ["12"]), ("north", [], []), ("", [], [])]


def test_closing_words_come_from_the_list(spark):
    stems = ["".join(p) for p in zip("bcdfghklmnprstvz" * 20, "aeiou" * 64, "mnprstbdfgkl" * 27, "oeaui" * 64, "lrnstkmdpb" * 32)]
    rows = [(f"{x.title()} {w}",) for x in sorted(set(stems))[:60] for w in ("Haut", "Bas", "II")] + [("Нижний Дон",), ("Верхний Дон",), (None,), ("",), ("Solo",), ("Two Words",)]
    table = spark.createDataFrame(rows, "n string")
    closing = closing_words(table, "n")
    assert closing == ["bas", "haut", "дoн"]  # look-alikes are folded
    typed = spark.createDataFrame([("BAS Xenon",), ("Xenon Ht.",), ("Xenon hauut",), ("Xenon 2nd",), ("Xenon bx",), ("Верхний Дон",)], "n string")
    got = spark.sql(parsed("{t}", "n", closing), t=typed).collect()
    assert [(r["stem"], r["dirs"], r["nums"]) for r in got[:5]] == [("xenon", ["bas"], []), ("xenon", ["haut"], []), ("xenon", ["haut"], []), ("xenon", [], ["2"]), ("xenonbx", [], [])]
    assert closing_words(table.limit(0), "n") == [] and spark.sql(parsed("{t}", "n", []), t=typed).count() == 6


def test_typed_names_of_other_scripts(spark):
    listed = spark.createDataFrame([(1, "रामपुर"), (2, "Нижний"), (3, "東京"), (4, "Rampur")], "canon_id long, unit_name string")
    names = ["रामपुर", "нижнйи", "東京", "京都", "रामपूर", "RAMPUR", "Верхний"]
    typed = spark.createDataFrame(list(enumerate(names)), "ord long, typed_name string")
    got = {r["ord"]: r["canon_id"] for r in canonical.map_to_entries(typed, listed).collect()}
    assert [got[i] for i in range(7)] == [1, 2, 3, 0, 1, 4, 0]


@pytest.mark.parametrize(("text", "form"), [
    ("Ｎｕｒｔ－Ｈｕｎｚａ", "Nurt-Hunza"), ("Dothušshur Circle", "Dothušshur Circle"), ("Вerantho Εast", "Berantho East"), ("Pifol᠎ker", "Pifolker"), ("Chorsanver Ⅱ", "Chorsanver II"), ("Zark‑Usmer", "Zark-Usmer"),
    ("n​̃", "ñ"), ("е́", "é"), ("тehsil", "тehsil"), ("　a \t b️", "a b"), ("", ""), ("рекhаm", "peкham"), ("कलमोरा", "कलमोरा"), ("ﬁ", "fi"),
])
def test_one_form(text, form):
    assert visual.one_form(text) == form and visual.one_form(form) == form


@pytest.mark.parametrize(("a", "b"), [("e\u0302\u0323", "\u1ec7"), ("\u0439", "\u0438\u0306"), ("\u1100\u1161\u11a8", "\uac01"), ("\u0958", "\u0915\u093c"), ("\u24b6", "A"), ("o\u0338", "ø"), ("\uff76\uff9e", "ガ"), ("\u043e\u0323\u0302", "ộ"), ("e\u200b\u0301", "é")])
def test_clusters_that_look_the_same(a, b):
    assert visual.one_form(f"x{a}y") == visual.one_form(f"x{b}y") and visual.one_form(a * 3000) == visual.one_form(b) * 3000


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0xFFFF, exclude_categories=("Cs",)), max_size=30))
def test_one_form_is_stable_and_keeps_ascii(text):
    once = visual.one_form(text)
    assert visual.one_form(once) == once
    ascii_ = "".join(c for c in text if c.isascii())
    assert visual.one_form(ascii_) == " ".join(ascii_.split())


def test_conflicts_are_errors():
    with pytest.raises(ValueError, match="two targets"):
        visual.merged({"a": "b"}, {"a": "c"})
    with pytest.raises(ValueError, match="rewritten again"):
        visual.Transducer({"é": "à", "à": "a"}, frozenset())
    with pytest.raises(ValueError):
        visual.Transducer({"​": "a"}, frozenset("​"))
    longest = visual.Transducer({"é": "1", "éé": "2"}, frozenset("​"))
    assert longest("é​ééx") == "21x"


def test_same_look(spark):
    entries = spark.createDataFrame([(3, "Zotörni", 0), (2, "Zotorni", 0), (1, "Berantho East", 0), (9, None, 0)], "canon_id long, unit_name string, _form int")
    values = ["Zotörni", "Zotorni", " Zotörni ", "Ζotorni", "Вerantho Εast", "berantho Еast", "Zotоrni", None, "", "Bеrantho  East\n", "Zötorni", "x​" * 3000]
    table = spark.createDataFrame([(i, v, "own") for i, v in enumerate(values)], "ord long, value string, canon_id string")
    got = {r["ord"]: r["canon_id"] for r in visual.same_look(table, "value", entries, "unit_name", "canon_id").collect()}
    assert got == {2: 3, 3: 2, 4: 1, 6: 2, 9: 1}
    assert visual.same_look(table, "value", entries.limit(0), "unit_name", "canon_id").collect() == []


FIELDS = "ord long, state string, district string, subdistrict string, k string"


def form(text):
    return None if text is None else "".join(c for c in text.lower() if unicodedata.category(c)[0] in "LN")


@pytest.mark.parametrize("limit", [3, 10_000])
def test_copies(spark, limit):
    rng = random.Random(11)
    base = [("Karvana", "Nongunmur Rural", f"Name {i % 30}") for i in range(60)] + [("Karvana", None, "x"), (None, "Karvana", "x"), (None, None, None), ("", None, ""), ("(é)", "e", "É"), ("k" * 3000, "d", "z" * 3000)]
    rows = []
    for _ in range(300):
        s, d, u = rng.choice(base)
        if rng.random() < 0.5:
            s, d = d, s
        noisy = lambda t: t if t is None else rng.choice([t, t.upper(), f" {t}..", t.replace(" ", "-")])
        rows.append((noisy(s), noisy(d), noisy(u)))
    rows += [("Hot", "Spot", "Unit")] * 150
    want = defaultdict(list)
    for i, (s, d, u) in enumerate(rows):
        want[tuple(sorted((form(s), form(d)), key=lambda x: (x is not None, x))), form(u)].append(i)
    table = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], FIELDS).repartition(5)
    got = {tuple(r) for r in duplicates.find_copies(table, "ord", ["subdistrict"], ["state", "district"], limit=limit).collect()}
    assert got == {(g[0], i) for g in want.values() for i in g[1:]}
    counts = {tuple(r) for r in duplicates.collapse(table, "ord", ["subdistrict"], ["state", "district"], limit=limit).collect()}
    assert counts == {(g[0], len(g)) for g in want.values()}


def test_copies_of_nothing_and_bounds(spark):
    empty = spark.createDataFrame([], FIELDS)
    assert duplicates.find_copies(empty, "ord", ["subdistrict"], ["state", "district"]).collect() == []
    records = spark.createDataFrame([(bytearray(f"same{i:04d}".encode()),) for i in range(500)] + [(bytearray(b"hot"),)] * 90, "k binary")
    levels = [level.groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("k").alias("keys"), F.min("k").alias("lo"), F.max("k").alias("hi")).collect() for level in duplicates.radix_buckets(records, 40)]
    assert sum(r["n"] for level in levels for r in level) == 590 and all(r["n"] <= 40 or r["keys"] == 1 for level in levels for r in level) and len(levels) == 3
    assert all(bytes(r["lo"]).startswith(bytes(r["bucket"])) and bytes(r["hi"]).startswith(bytes(r["bucket"])) for level in levels for r in level)
    assert [level.count() for level in duplicates.radix_buckets(records.limit(0), 40)] == [0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=5), max_size=40))
def test_trie_counts(keys):
    trie = duplicates.Trie()
    for i, k in enumerate(keys):
        trie.add(k, 1, i)
    assert sorted(trie.terminals()) == sorted((k, keys.count(k), keys.index(k)) for k in set(keys))


@pytest.mark.parametrize("shares", [(), (0.1, 0.3, 0.6), topn.BAND_SHARES])
def test_top_n(spark, shares):
    rng = random.Random(2)
    rows = [("hot", f"i{rng.randrange(900)}", rng.randrange(10) / 10) for _ in range(3000)] + [("tied", f"t{i:03d}", 1.0) for i in range(400)]
    rows += [(f"g{rng.randrange(60)}", f"i{rng.randrange(30)}", rng.choice([None, float("nan"), rng.random(), 0.5, -1.0])) for _ in range(900)] + [(None, "i", 1.0), ("g", None, 1.0), ("void", "i", None), ("void", "j", float("nan"))]
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and s == s:
            best[g, i] = max(s, best.get((g, i), -9))
    by = defaultdict(list)
    for (g, i), s in best.items():
        by[g].append((-s, i))
    want = {(g, i, -s, n + 1) for g, items in by.items() for n, (s, i) in enumerate(sorted(items)[:6])}
    table = spark.createDataFrame([(*r, "x") for r in rows], "g string, i string, s double, had string").repartition(5)
    got = topn.top_n(table, "g", "i", "s", 6, shares=shares)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert topn.top_n(table.limit(0), "g", "i", "s", 6).collect() == []
