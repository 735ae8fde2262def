"""Linkage, token ids, mixtures, cut texts."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import linkage, mixture, tokens, truncation

PLACE = "ord long, name string, state string, district string, to_ord string"


def test_linkage(spark):
    units = [("Disvulsan", "Lower Vessin", "Kosmolpi-Sadar"), ("Disvulsan", "Karvana", "Chiltèrral"), ("Bosmelfur Block", "Dunvarra", "Thurgosrü"), ("Bosmelfur", "Dunvarra", "Thurgosrü"), ("DISVULSAN.", "Kosmolpi sadar", "lower  vessin"), ("Nermunzol Upper", "North Ostmere", "Zasheszel & Environs")]
    units += [("Thanchellun Lower", "Zamora Plains", "Shenlerzal & Environs"), ("Ward No. 12", "Karvana", "Chiltèrral"), (None, "Karvana", "Chiltèrral"), ("Alone", None, None), ("Zusmelfor", None, "Chiltèrral")]
    units += [(f"Filler{c}{d}ana {w}", "Karvana", "Chiltèrral") for c in "bdfgkl" for d in "mnprst" for w in ("East", "West")]
    units += [("Zusmelfor Lower", "Dunvarra", "Thurgosrü"), ("Zusmelfor Upper", "Dunvarra", "Thurgosrü")]  # closing words are learned from the list
    cases = [
        (("Dsivulsan", "Kosmolpi-Sadar", "Lower bessin"), 0), (("disvulsan", "Karvana prov.", "Chilterral"), 1), (("Bosmeflur", "DUNVARRA", "THURGOSRÜ"), 3), (("Bosmeflur Blk", "Dunvarra (old)", "Thurgosru"), 2), (("Nremunzol Upper", None, "Zasheszel   & Environs"), 5),
        (("Thanchelun Low.", "Z. Plains", "Shenlerzal - Environs"), 6), (("Ward No. 13", "Karvana", "Chiltèrral"), None), (("ward 12", "Karvana", "Chiltèrral"), 7), (("Disvulsan", "Belgrath", "Diñsalne"), None), (("Zusmelfr", "Karvana", "Chiltèrral"), 10),
        ((None, "Karvana", "Chiltèrral"), None), (("  ", "Karvana", "Chiltèrral"), None), (("Disvulsan", None, None), None), (("test", "Karvana", "Chiltèrral"), None), (("Fillerbmana East", "Karvana", "Chiltèrral"), 11), (("q" * 4000, "Karvana", "Chiltèrral"), None),
    ]
    lost = [c for c, _ in cases] * 2
    left = spark.createDataFrame([(i, *c, "x") for i, c in enumerate(lost)], PLACE)
    right = spark.createDataFrame([(i, *u, "y") for i, u in enumerate(units)], PLACE)
    found, model = linkage.link(left, right)
    got = {r["ord"]: r["to_ord"] for r in found.collect()}
    assert [got.get(i) for i in range(len(lost))] == [t for _, t in cases] * 2
    assert all(0.5 <= r["confidence"] <= 1 for r in found.collect()) and model.m["name"][3] < 0.1 < model.u["name"][3]
    assert linkage.link(left.limit(0), right)[0].collect() == [] and linkage.link(left, right.limit(0))[0].collect() == []


def test_em_finds_the_classes():
    rng = np.random.RandomState(0)
    m = [[0.5, 0.3, 0.19, 0.01], [0.95, 0.05], [0.98, 0.02], [0.8, 0.15, 0.05], [0.8, 0.15, 0.05]]
    u = [[0.01, 0.02, 0.07, 0.9], [0.2, 0.8], [0.9, 0.1], [0.6, 0.3, 0.1], [0.6, 0.3, 0.1]]
    rows = [tuple(rng.choice(len(p), p=p) for p in (m if i < 4000 else u)) for i in range(10_000)]
    model = linkage.fit(list(Counter(rows).items()))
    assert model.share == pytest.approx(0.4, abs=0.05) and model.m["name"][0] == pytest.approx(0.5, abs=0.06) and model.u["direction"][0] == pytest.approx(0.2, abs=0.06)
    assert linkage.fit([]).share == 0.5


def exact(texts):
    enc = tokens.encoder(tokens.TOKENIZERS)
    return [enc.encode_ordinary(t) for t in texts]


def by_chunks(text):
    data, enc = text.encode(), tokens.encoder(tokens.TOKENIZERS)
    own, again = tokens.chunks(text)
    assert own[0][0] == 0 and own[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    ids = lambda lo, hi: np.array(enc.encode_ordinary(data[lo:hi].decode()), dtype=np.int64)
    return tokens.repaired([(0, lo, hi, ids(lo, hi)) for lo, hi in own] + [(1, lo, hi, ids(lo, hi)) for lo, hi in again], tokens.token_lengths(tokens.TOKENIZERS))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["the", "It's", "'ll", " ", "  ", "\n\n", "\t", ".", "...", "。", "、」", "半年使っても", "é", "é", "👩‍🍳", "12345", "<|endoftext|>", "Straße", " ", "　", "!'s", "abcdefghij" * 9, "ば", "है", "?!", "a b c"]), min_size=1, max_size=120).map("".join))
def test_chunked_ids_are_exact(text):
    assert by_chunks(text) == exact([text])[0]


def test_ids_of_a_corpus(spark):
    texts = ["", None, " ", "Hello world. " * 300, "漢字かな交じり文" * 200, "x" * 20_000, "<|endoftext|> is text", "  leading", "tab\tand\nnewline  \n ", "Hello world. " * 300, "🙂" * 500, "a" + " " * 5000 + "b"]
    table = spark.createDataFrame([(i if i != 7 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = tokens.encode_corpus(table, "doc_id", "text")
    assert {r["doc_id"]: r["ids"] for r in got.collect()} == {(i if i != 7 else None): e for i, e in enumerate(exact([t or "" for t in texts]))}
    assert tokens.encode_corpus(table.limit(0), "doc_id", "text").collect() == [] and dict(got.dtypes)["ids"] == "array<int>"


def test_equal_passages_give_equal_chunks():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    shared = " ".join(word() for _ in range(400))
    a, b = (" ".join(word() for _ in range(60)) + " " + shared for _ in range(2))
    pieces = [{t.encode()[lo:hi] for lo, hi in tokens.chunks(t)[0]} for t in (a, b)]
    assert len(pieces[0] & pieces[1]) > 0.6 * len(tokens.chunks(shared)[0])


def test_pivotal_rounding_keeps_tokens_and_probabilities():
    n, seen, size = 40, np.zeros(40), np.random.RandomState(4).randint(1, 200, 40)
    p = np.random.RandomState(5).random_sample(40)
    for seed in range(1500):
        rows = pd.DataFrame({"source": "s", "doc_id": range(n), "part": 1, "tokens": size, "base": 0, "fraction": p, "mix": np.random.RandomState(seed).permutation(n) + seed * 1000, "bucket": 0})
        out = mixture.settle(rows, seed)
        open_ = (out["fraction"] > 0) & (out["fraction"] < 1)
        assert open_.sum() <= 1 and (out["fraction"] * out["tokens"]).sum() == pytest.approx((p * size).sum())
        seen += out.sort_values("doc_id")["fraction"].to_numpy()
    assert np.abs(seen / 1500 - p).max() < 0.06


@pytest.mark.parametrize("bucket_rows", [7, 100_000])
def test_mixture(spark, bucket_rows):
    rows = [(i, f"word number {i} and some more " * (1 + i % 5), "big", "x") for i in range(300)] + [(1000 + i, "short text", "small", None) for i in range(9)] + [(2000, "no target", "other", None), (2001, None, "big", None), (2002, "", "small", None), (2003, "x", None, None), (1000, "short text", "small", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string")
    targets = spark.createDataFrame([("big", 0.8, 1), ("small", 0.1, 4), ("none", 0.1, 10)], "source string, target_share double, max_repeats int")
    mixed, report = mixture.mix(docs, targets, bucket_rows=bucket_rows)
    got = {r["source"]: r for r in report.collect()}
    assert got["none"]["tokens_mixed"] == 0 and got["small"]["most_copies"] <= 4 and got["big"]["most_copies"] <= 1 and {r["source"] for r in mixed.collect()} == {"big", "small"}
    longest = 40
    whole = got["big"]["tokens_mixed"] + got["small"]["tokens_mixed"]
    assert abs(got["big"]["tokens_mixed"] - whole * 8 / 9) <= 2 * longest and got["big"]["actual_share"] + got["small"]["actual_share"] == pytest.approx(1)
    again = mixture.mix(docs, targets, bucket_rows=bucket_rows)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))
    assert mixture.mix(docs.limit(0), targets)[0].collect() == [] and mixture.mix(docs, targets.limit(0))[0].collect() == []


def test_rates():
    r = {x.source: x for x in mixture.rates({"a": 1000, "b": 10}, [("a", 0.5, 1), ("b", 0.4, 5), ("c", 0.1, 2)], total=10_000)}
    assert r["b"].copies == 5 and r["a"].copies == 1 and r["c"].copies == 0
    assert mixture.rates({}, [("a", 1.0, 1)])[0].copies == 0


@pytest.mark.parametrize(("text", "kind"), [("All good.", "stop"), ("All good!​  ", "stop"), ('He said "no."', "stop"), ("All go", "open"), ("Well, ", "open"), ("great 👍🏽", "sign"), ("(updated)", "sign"), ("Co�", "broken"), ("  ​", "none"), ("", "none"), ("終わり。", "stop"), ("終わ", "open"), ("है", "open")])
def test_endings(text, kind):
    assert truncation.ending(text) == kind


def test_cut_texts(spark):
    rng = random.Random(8)
    things, sentences = ["kettle", "lid", "motor", "handle", "battery"], []
    for _ in range(400):
        a, b = rng.choice(things), rng.choice(things)
        sentences.append(rng.choice([f"The {a} works exactly as described", f"I love the {a} on this {b}", f"After two weeks the {a} still looks new", f"The {a} took a moment to understand, but now I use it every day", f"My sister bought the {b} as well and is just as happy"]))
    text = lambda n: ". ".join(rng.choice(sentences) for _ in range(n)) + "."
    whole = [text(rng.randrange(3, 9)) for _ in range(250)]
    no_stop = [text(4)[:-1] for _ in range(12)]
    cut = [text(3) + " The motor took a mom", text(3) + " After two weeks the lid still", text(3) + " My sister bought the", text(4) + " I love the hand"]
    original = " ".join(f"unusual{i} words{i} here{i}" for i in range(60)) + " and then it ends with something quite singular today."
    copies = [original, original[: len(original) - 18]]
    odd = [None, "", "   ", "Love it", "👍👍👍", "5", "good �", text(2000)]
    texts = [*whole, *no_stop, *cut, *copies, *odd, cut[0]]
    rows = [(i, t, "Love it" if i == 3 else None, "s1" if i % 2 else None, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, title string, source string, cut string").repartition(3)
    found = truncation.find_cut(docs, "doc_id", "text", "title")
    got = {r["doc_id"] for r in found.where("cut").collect()}
    first = len(whole) + len(no_stop)
    assert got == {*range(first, first + len(cut)), first + len(cut) + 1, texts.index("good �"), len(texts) - 1}
    shares = {r["source"]: r["cut_texts"] for r in truncation.cut_shares(docs, found, "doc_id", "source").collect()}
    assert sum(shares.values()) == len(got)
    assert truncation.find_cut(docs.limit(0), "doc_id", "text", "title").collect() == []


def test_aligned_copies():
    base = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(80))
    assert truncation.alignment(base, base + " and more") == 1 == truncation.alignment(base[:-1], base + " more words")
    assert truncation.alignment(base, base + ". Next sentence") == -1
    assert truncation.alignment(base, base + " (updated)") == 0 == truncation.alignment(base, "something else entirely " * 9) == truncation.alignment("", base)


def near(spark, texts):
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    read = table.mapInArrow(truncation._read(0.0), f"{truncation._TEXT_COLUMNS}, {truncation._GRAM_COLUMNS}, part int").where("part = 0")
    return {r["id"]: r["said"] for r in truncation.near_copies(table, read).collect()}


def test_every_copy_in_a_band_is_held_against(spark):
    word = lambda i: f"word{chr(97 + i // 26)}{chr(97 + i % 26)}"
    base = " ".join(map(word, range(90)))
    longer = [f"{base}. {' '.join(word(j) + word(i) for j in range(26))}." for i in range(60)]
    original = base + " and more of it."
    many = [f"{word(i)}s of {word(i + 40)} {' '.join(map(word, range(200, 270)))} there" for i in range(20)]
    got = near(spark, [base, base[:-2], original, *longer, *many, *(f"{t} it went on like that" for t in many), "short one", many[0] + ". And so on"])
    assert {i for i, said in got.items() if said == 1} == {0, 1, *range(63, 83)}


@pytest.mark.parametrize("part", [0.5, 0.6, 0.79, 0.95])
def test_a_text_cut_anywhere_meets_its_original(spark, part):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    whole = [" ".join(word() for _ in range(rng.randrange(60, 140))) for _ in range(60)]
    cut = [" ".join((w := t.split())[: int(part * len(w))])[:-1] for t in whole]
    stopped = [f"{' '.join(t.split()[:40])}. And then {word()} {word()}." for t in whole[:5]]
    got = near(spark, [*whole, *cut, *stopped])
    assert sum(got.get(60 + i) == 1 for i in range(60)) >= 0.9 * 60 and not any(got.get(i) == 1 for i in range(60))


def test_terminality_is_learned(spark):
    examples = pd.DataFrame({"label": [0] * 50 + [1] * 50, "logit": list(np.linspace(-1, 5, 50)) + list(np.linspace(-9, -2, 50)), "sign": 0.0})
    constant, slope, _ = truncation.fit_cut(examples)
    assert slope < 0 and constant + slope * 3 < 0 < constant - slope * 4 and truncation.fit_cut(examples[:0])[1] == -1.0


def test_names_in_other_scripts_are_linked(spark):
    names = ["Донецкий", "Нижний", "თბილისი", "กรุงเทพ", "रामपुर", "रामपूर", "東京", "大阪", "さくらむら", "Łódźże Дон", "वार्ड 12", "Disvulsan", "—"]
    units = spark.createDataFrame([(i, n, "Karvana", "Chiltèrral", "") for i, n in enumerate(names)] + [(90, "Нижний", "Dunvarra", "Thurgosrü", "")] + [(100 + i, f"Filler{c}{d}ana", "Karvana", "Chiltèrral", "") for i, (c, d) in enumerate(zip("bdfgklbd", "mnprstpr"))], PLACE)
    lost = [*((n, None if n == "—" else i) for i, n in enumerate(names)), ("Донецкйи", 0), ("京都", None), ("वार्ड १२", 10), ("वार्ड १३", None), ("Ещёодин", None)]
    left = spark.createDataFrame([(i, n, "Karvana", "Chilterral", "") for i, (n, _) in enumerate(lost)], PLACE)
    got = {r["ord"]: r["to_ord"] for r in linkage.link(left, units)[0].collect()}
    assert [got.get(i) for i in range(len(lost))] == [t for _, t in lost]


def test_templates_cut_at_one_length_are_no_formula(spark):
    rng = random.Random(3)
    some = ["it boils water quickly", "we moment by moment enjoy the kettle", "the lid closes well", "a sturdy handle is what it has", "my aunt uses it daily"]
    whole = [". ".join(rng.choice(some) for _ in range(6)) + f". {i}." for i in range(60)]
    names = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(12)]
    inside = [f"Ordered by {n} for a kitchen, and this parcel brought mom" for n in names[:6]]
    between = [f"Given to {n} for a kitchen, where steam rises off the" for n in names[6:]]
    formula = [f"{'.  '.join(rng.choice(some) for _ in range(2 + i))}. Happy customers praise the kettle" for i in range(5)]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate([*inside, *between, *formula, *whole])], "doc_id long, text string, title string")
    assert {r["doc_id"] for r in truncation.find_cut(docs, "doc_id", "text", "title").where("cut").collect()} == set(range(12))


def test_rows_without_a_district_stay_few(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(5))
    units = [(i, word().title(), "Karvana", word(), "") for i in range(200)] + [(200, "Solanadur", "Karvana", "Karvanna", "")]
    lost = [(i, u[1][:4] + u[1][5:], "Karvana", None, "") for i, u in enumerate(units)]
    written, write = [], linkage.materialize

    def counting(df, **options):
        written.append((table := write(df, **options)).count())
        return table

    monkeypatch.setattr(linkage, "materialize", counting)
    left, right = spark.createDataFrame(lost, PLACE), spark.createDataFrame(units, PLACE)
    got = [(r["ord"], r["to_ord"]) for r in linkage.link(left, right)[0].collect()]
    assert sorted(got) == [(i, i) for i in range(201)]
    assert max(written) <= 2 * len(units) + 2  # not rows without a district times the districts of their state
    likely = linkage.Model(0.5, *({f: [p] * n for f, n in linkage.LEVELS.items()} for p in (0.9, 0.1)), 1)
    monkeypatch.setattr(linkage, "fit", lambda patterns: likely)
    other = spark.createDataFrame([(0, "Bodu" + units[0][1][4:], "Karvana", None, "")], PLACE)
    assert [r["to_ord"] for r in linkage.link(other, right.where("ord = 0"))[0].collect()] == [0]  # another name counts if the model says so


def test_endings_meet_by_the_bands_they_share():
    rng = random.Random(11)
    tail = [rng.choice("abcdefgh") * rng.randint(2, 5) for _ in range(60)]
    texts = [" ".join(w if rng.random() > share else "other" for w in tail[:-4]) + " " + " ".join(tail[-4:]) for share in (0, 0.02, 0.05, 0.1, 0.2) for _ in range(12)]
    words = truncation.Words.of(texts)
    ends = words.starts[1:] - 4
    bands, meet = words.endings[:, ends], words.meeting[:, ends]
    shared = [(int((bands[:, i] == bands[:, j]).sum()), bool((meet[:, i] == meet[:, j]).any())) for i in range(len(texts)) for j in range(i)]
    assert all(met == (n >= truncation.LEAST_BANDS) for n, met in shared) and {n for n, _ in shared} >= {0, 1, 2, 4}
    tails = words.tails(list(range(len(texts))))
    assert (tails.meeting[:, tails.starts[1:] - 4] == meet).all()


def test_texts_that_only_share_their_ending_are_not_aligned(spark, monkeypatch):
    rng, template = random.Random(3), "please write again whenever you like since we answer every letter that comes to the house by the river on the same morning and"
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    start = lambda n: " ".join(word() for _ in range(n))
    bodies = [start(30) for _ in range(12)]
    rows = [f"{b} {template}" for b in bodies] + [f"{start(30)} {template} never later than {word()}." for _ in range(12)] + [f"{bodies[0]} {template} never later than noon."]
    texts = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    pairs = spark.createDataFrame([(i, j, [3]) for i in range(12) for j in range(12, 25)], "id long, other long, places array<int>")
    monkeypatch.setattr(truncation, "ASKED", 5)
    kept = {(r["id"], r["other"]) for r in truncation.may_contain(pairs, texts).collect()}
    enough = lambda a, b: len(np.intersect1d(x := truncation._shingles(a), truncation._shingles(b))) >= truncation.SIMILARITY * len(x)
    assert kept == {(i, j) for i in range(12) for j in range(12, 25) if enough(rows[i], rows[j])} and kept == {(0, 24)}
