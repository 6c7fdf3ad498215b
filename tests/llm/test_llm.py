import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstead.llm import consensus as C
from loomstead.llm import gazetteer as Z
from loomstead.llm import leakage as K
from loomstead.llm import mixing as M
from loomstead.llm import names as N
from loomstead.llm import places as P
from loomstead.llm import truncation as T
from loomstead.llm.components import components
from loomstead.llm.spelling import bones, edits, plain, sound


# --- sounds ------------------------------------------------------------------------------------------------------


def test_both_scripts_sound_alike():
    for he, la in (("בעסערבישטיין", "Beserbishteyn"), ("דעשאנקוצקי", "Deshankutski"), ("קעלצושאפאליע", "Keltsushapolye"), ("טעלבוזווואלד", "Telbuzuvald")):
        assert edits(sound(plain(he)), sound(plain(la)), 3) <= 2, (he, la)
    assert edits("abcd", "abdc", 2) == 1 and edits("a", "abcd", 2) == 3 and bones("betel") == "btl"


# --- p1 ----------------------------------------------------------------------------------------------------------


def test_parse_names():
    lex = N.Lexicon(N.listed())
    (p,) = N.parse('הרה"ק וואלף געסאבמיהאלץ זצ״ל', lex)
    assert p["given"] == ["זאב"] and p["surname"] == sound(plain("געסאבמיהאלץ"))
    (q,) = N.parse("געסאבמיהאלץ, ז׳", lex)
    assert q["given"] == ["?ז"] and q["surname"] == p["surname"] and "זאב" in q["called"]
    assert N.given_likeness(["זאב"], ["דוב"], lex) is None and N.given_likeness(["?ז"], ["זאב"], lex)[0] > 0.5
    assert N.parse(None, lex) == [] and N.parse(" - ", lex) == []
    assert {tuple(r["given"]) for r in N.parse("Zelig Horowitz", lex)} == {("~z:zelig",), ("~h:araviT",)}
    assert lex.near("וואלפפ") == "זאב" and lex.near("qqq") is None


def test_names_outside_any_list_link(spark, monkeypatch):
    """Equal strings, other orders, slips and initials are found whether or not a word is in the list."""
    records = spark.createDataFrame([(1, ["Zelig Horowitz"]), (2, ["Hillel Paritcher"]), (3, ["Moshe Sofer"]), (4, ["Gimpel"]), (5, [None, ""]), (None, ["Zelig Horowitz"])], "rec_id bigint, names_he array<string>")
    typed = ["Zelig Horowitz", "Horowitz Zelig", "Hilel Paritcher", "Paritcher, H.", "Moshe Sofer", "Gimpel", "Zelig Paritcher", None, " "]
    mentions = spark.createDataFrame(list(enumerate(typed)) + [(0, "Zelig Horowitz")], "review_id bigint, name string")
    want = {(0, 1), (1, 1), (2, 2), (3, 2), (4, 3), (5, 4)}
    for known in (N.GIVEN, {}):
        monkeypatch.setattr(N, "GIVEN", known)
        assert {(r.review_id, r.rec_id) for r in N.same_person(mentions, "review_id", "name", records, "rec_id", ["names_he"]).collect()} == want


def test_given_names_are_learnt(spark, monkeypatch):
    """Words beside many rarer words are given names, and forms that records use for one person are one name."""
    monkeypatch.setattr(N, "GIVEN", {})
    rng = random.Random(2)
    surnames = ["".join(rng.choice(["ba", "ko", "lim", "ter", "zu", "fen", "gro"]) for _ in range(4)) for _ in range(60)]
    rows = [(i, n) for i, s in enumerate(surnames) for n in ((f"Aron {s}", f"Orele {s}") if i % 2 else (f"Bendet {s}", f"Bendet {s}x"))]
    forms = N.learn(spark.createDataFrame([(n,) for _, n in rows] + [("מחבר Aron sefer",)], "name string"), spark.createDataFrame(rows, "rec bigint, name string"))
    assert set(forms) == {"aron", "orele", "bendet"} and forms["aron"] == forms["orele"] != forms["bendet"]


def test_similar_names_against_brute_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abdegiklmnrstuvzXST") for _ in range(rng.randint(3, 16))) for _ in range(60)]

    def slip(s):
        i, k = rng.randrange(len(s) - 1), rng.randrange(4)
        return [s[:i] + s[i + 1] + s[i] + s[i + 2 :], s[:i] + s[i + 1 :], s[:i] + "m" + s[i:], s[:i] + "r" + s[i + 1 :]][k]

    a = list(dict.fromkeys(base + [slip(s) for s in base] + [slip(slip(s)) for s in base] + [slip(slip(slip(s))) for s in base]))
    most = lambda n: 0 if n < 4 else 1 if n < 8 else 2 if n < 14 else 3
    want = {(x, y) for x in a for y in a if edits(x, y, 3) <= most(max(len(x), len(y)))}
    df = spark.createDataFrame([(s, "g", ["g"]) for s in a] + [(s, "h", ["h"]) for s in a[:5]], "surname string, gkey string, called array<string>")
    got = {(r.sa, r.sb) for r in N.similar_names(df.where("gkey = 'g'"), df).collect()}
    assert got == want and len(want) > 2 * len(a)


def test_same_person(spark):
    records = spark.createDataFrame([(1, ["הרב זאב געסאבמיהאלץ"], ["Zeev Gesabmiholts"]), (2, ["וואלף געסאבמיהאלץ", None, ""], None), (3, ["דוב געסאבמיהאלץ"], None), (4, None, None), (1, ["הרב זאב געסאבמיהאלץ"], ["Zeev Gesabmiholts"])], "rec_id bigint, names_he array<string>, names_en array<string>")
    typed = [(10, "זאב געסאבמיהאלץ"), (11, "R. Zeev Gesabmiholts"), (12, "דוב געסאבמיהאלץ"), (13, "משה געסאבמיהאלץ"), (14, None), (15, ""), (16, "טבעת"), (10, "זאב געסאבמיהאלץ"), (17, "זאב געאסבמיהאלץ ז\"ל"), (18, "x" * 20000)]
    mentions = spark.createDataFrame(typed, "review_id bigint, name string").withColumn("rec", F.lit("clash"))
    got = {}
    for r in N.same_person(mentions, "review_id", "name", records, "rec_id", ["names_he", "names_en"]).collect():
        got.setdefault(r.review_id, set()).add(r.rec_id)
    assert got == {10: {1, 2}, 11: {1, 2}, 12: {3}, 17: {1, 2}}
    assert N.same_person(mentions.limit(0), "review_id", "name", records, "rec_id", ["names_he"]).count() == 0


def test_no_table_that_grows_is_broadcast(spark, monkeypatch):
    """Sizes are guessed, arrays as one element, so every join of names and records is told to shuffle."""
    plans, real = [], N.cut

    def spy(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(N, "cut", spy)
    monkeypatch.setattr(N, "learn", lambda names, records: N.listed())
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 1_000_000
    records = spark.createDataFrame([(1, ["משה סופר אב\"ד טבערשטאל"]), (2, ["סופר, משה"]), (3, ["זאב געסאבמיהאלץ"])], "rec_id bigint, names_he array<string>")
    mentions = spark.createDataFrame([(7, "משה סופר"), (8, "זאב געסאבמיהאלץ")], "review_id bigint, name string")
    found = N.same_person(mentions, "review_id", "name", records, "rec_id", ["names_he"])
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert {(r.review_id, r.rec_id) for r in found.collect()} == {(7, 1), (7, 2), (8, 3)}
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not any("Broadcast" in p for p in plans)


# --- p2 ----------------------------------------------------------------------------------------------------------

PLACE = "names array<string>, lat double, lon double, extra map<string,string>"


def test_match_places(spark):
    xml = spark.createDataFrame([("a", ["קעלצושאפאליע", "Keltsushapolye"], 49.08, 22.3, {}), ("b", ["Old Debtsashitshin"], 52.71, 18.88, {}), ("c", ["New Debtsashitshin"], 52.73, 18.93, {}), ("d", ["", None], None, None, None)], "xml_id string, " + PLACE)
    rows = [(1, ["Keltsushapolye"], 49.081, 22.301, {}), (2, ["Nowy Debtsashitshin"], 52.73, 18.93, {}), (3, ["קעלצושאפאליע"], 22.3, 49.08, {}), (4, ["Nothing"], 10.0, 10.0, {}), (5, None, None, None, None), (6, ["Keltsushapolye"], None, None, {}), (7, ["Keltsushapolye"], 20.0, 40.0, {}), (1, ["Keltsushapolye"], 49.081, 22.301, {})]
    got = {int(r.csv_row): r.xml_id for r in P.match_places(spark.createDataFrame(rows, "csv_row bigint, " + PLACE), "csv_row", xml, "xml_id").collect()}
    assert got == {1: "a", 2: "c", 3: "a", 6: "a"}
    empty = spark.createDataFrame([], "csv_row bigint, " + PLACE)
    assert P.match_places(empty, "csv_row", xml, "xml_id").count() == 0



def test_misspelt_places_without_coordinates(spark):
    """Every pair of names within the edits is a candidate, whichever letters are changed."""
    rng = random.Random(3)
    stock = ["".join(rng.choice("abdgklmnprstvz") for _ in range(rng.randint(3, 12))) for _ in range(60)]
    stock += ["deSankutski", "ananananan"]

    def spoilt(s, edits):
        for _ in range(edits):
            i = rng.randrange(1, len(s) - 1)
            s = rng.choice([s[:i] + "X" + s[i + 1 :], s[:i] + s[i + 1 :], s[:i] + "X" + s[i:], s[: i - 1] + s[i] + s[i - 1] + s[i + 1 :]])
        return s

    parsed = "k string, parsed array<struct<sound string, sense string, district string>>, lat double, lon double, coarse boolean, d string"
    rows = lambda names, kind, lat, d: [(f"{kind}{i}", [(s, "", None)], lat, lat, False, d) for i, s in enumerate(names)]
    listed = rows([spoilt(s, rng.randint(1, max(1, len(s) * 3 // 10))) for s in stock for _ in range(3) if len(s) > 3] + ["deXankutski"], "l", None, "nart")
    places = rows(stock, "p", 50.0, "nart")
    got = {(r.l, r.p) for r in P.candidates(spark.createDataFrame(listed, parsed), spark.createDataFrame(places, parsed)).collect()}
    full = {(a[0], b[0]): (edits(x, y, 9), max(len(x), len(y))) for a in listed for b in places for x, y in [(a[1][0][0], b[1][0][0])]}
    assert got == {k for k, (d, n) in full.items() if d <= n / 3 + 1e-9} and len(got) > 150
    xs, ys = (spark.createDataFrame([(v,) for v in col], "s string").toPandas().s for col in zip(*[(a[1][0][0], b[1][0][0]) for a in listed[:40] for b in places]))
    assert P._edits.func(xs, ys).tolist() == [edits(x, y, 30) for x, y in zip(xs, ys)]



def test_all_pairs_the_rules_reach(spark):
    """Misspelt names, places beyond the neighbouring cell, rough and exchanged coordinates."""
    rng = random.Random(4)
    names = ["debtsaSitSin", "deXtsaSitXin", "deXtXaSXtXin", "kaltin", "kXlXin"]
    parsed = "k string, parsed array<struct<sound string, sense string, district string>>, lat double, lon double, coarse boolean, d string"
    row = lambda kind, i, far: (f"{kind}{i}", [(rng.choice(names), "", None)], *rng.choice([(60.04 + far * rng.random(), 23.013 + far * rng.random()), (-17.0 + far * rng.random(), 179.9 + far * rng.random() - (360 if rng.random() < 0.5 else 0))]), i % 5 == 0, None)
    listed, places = [row("l", i, 0.8) for i in range(60)], [row("p", i, 0.8) for i in range(60)]
    listed += [(f"t{k}", p, lon, lat, c, d) for k, p, lat, lon, c, d in listed if lat > 0]

    def km(a, b, c, d):
        a, b, c, d = map(np.radians, (a, b, c, d))
        return 12742 * np.arcsin(np.sqrt(np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2))

    want = set()
    for a in listed:
        for b in places:
            far = min(km(a[2], a[3], b[2], b[3]), km(a[3], a[2], b[2], b[3])) - (6 if a[4] else 0)
            if far <= 30 and P.name_likeness(*([dict(zip(("sound", "sense"), n)) for n in x[1]] for x in (a, b))) >= 0.55:
                want.add((a[0], b[0]))
    assert {(r.l, r.p) for r in P.candidates(spark.createDataFrame(listed, parsed), spark.createDataFrame(places, parsed)).collect()} == want and len(want) > 300
    place = spark.createDataFrame([("a", ["Keltsushapolye"], 60.0, 22.3, {"district": "nart"})], "xml_id string, " + PLACE)
    rows = spark.createDataFrame([(1, ["Keltsushapolye"], 60.0, 22.66, {"district": "nart"})], "csv_row bigint, " + PLACE)
    assert [r.xml_id for r in P.match_places(rows, "csv_row", place, "xml_id").collect()] == ["a"]


def test_unknown_coordinates_are_not_near(spark):
    """A row at 0/0 or a rough one is at no distance of a place without coordinates, nor of any at all at 0/0."""
    places = spark.createDataFrame([("a", ["Keltsushapolye"], 49.08, 22.3, {}), ("b", ["Barlukhune"], None, None, {})], "xml_id string, " + PLACE)
    rows = [(1, ["Keltsuzhabnle"], 0.0, 0.0, {}), (2, ["Keltsushapolye"], 0.0, 0.0, {}), (3, ["Barlukhznn"], 50.5, 27.1, {}), (4, ["Barlukhune"], 50.5, 27.1, {})]
    found = P.match_places(spark.createDataFrame(rows, "csv_row bigint, " + PLACE), "csv_row", places, "xml_id").collect()
    assert {(int(r.csv_row), r.xml_id, r.km) for r in found} == {(2, "a", None), (4, "b", None)}


def test_likeness_of_a_pair_is_that_of_its_likest_names(spark):
    """Over several names, senses and both ways of finding a pair."""
    rng = random.Random(6)
    sounds = ["debtsaSitSin", "deXtsaSitSin", "debtXaSitXin", "kaltin", "kXltin"]
    parsed = "k string, parsed array<struct<sound string, sense string, district string>>, lat double, lon double, coarse boolean, d string"
    row = lambda kind, i: (f"{kind}{i}", [(rng.choice(sounds), rng.choice(["", "old"]), None) for _ in range(3)], *rng.choice([(50.0, 20.0), (50.1, 20.1), (None, None)]), i % 4 == 0, None)
    listed, places = [row("l", i) for i in range(25)], [row("p", i) for i in range(25)]
    names = {k: [dict(zip(("sound", "sense"), n)) for n in parts] for k, parts, *_ in listed + places}
    got = P.candidates(spark.createDataFrame(listed, parsed), spark.createDataFrame(places, parsed)).collect()
    assert len(got) > 200 and all(abs(r.likeness - P.name_likeness(names[r.l], names[r.p])) < 1e-12 for r in got)
    unknown = {k for k, _, lat, *_ in listed + places if lat is None}
    assert all((r.km is None) == bool({r.l, r.p} & unknown) for r in got)


# --- p3 ----------------------------------------------------------------------------------------------------------


def test_components(spark):
    random.seed(2)
    edges = [(f"n{random.randint(0, 300)}", f"n{random.randint(0, 300)}") for _ in range(200)] + [(f"c{i}", f"c{i + 1}") for i in range(70)] + [("hub", f"h{i}") for i in range(300)] + [(None, "x"), ("  ", "y"), (" solo ", "solo"), ("c1", "c2")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a.strip() and b.strip():
            a, b = find(a.strip()), find(b.strip())
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a string, b string").withColumn("node", F.lit(1))
    for hub in (100_000, 40):
        got = {r.node: r.group_node for r in components(df, "a", "b", nodes=spark.createDataFrame([("lone",), (None,)], "n string"), node="n", hub=hub).collect()}
        assert got == {x: find(x) for x in parent} | {"lone": "lone"}
    assert components(df.limit(0), "a", "b").count() == 0


# --- p4 ----------------------------------------------------------------------------------------------------------


def test_consensus_beats_the_majority(spark):
    rng = np.random.default_rng(3)
    truth, rows = rng.random(300) < 0.5, []
    skill = {"good1": 0.95, "good2": 0.95, "coin1": 0.5, "coin2": 0.5, "liar": 0.1}
    for i, t in enumerate(truth):
        for who, p in skill.items():
            rows.append((i, who, "yes" if (rng.random() < p) == t else "no"))
    rows += [(None, "good1", "yes"), (0, None, "yes"), (0, "good1", None), rows[0]]
    items, rated = C.consensus(spark.createDataFrame(rows, "item bigint, who string, given string"), ["item"], "who", "given", ["yes"])
    got = {int(r.item): r.label == "yes" for r in items.collect()}
    assert np.mean([got[i] == t for i, t in enumerate(truth)]) > 0.93
    assert {r.annotator: r.sensitivity for r in rated.collect()}["liar"] < 0.3
    empty, _ = C.consensus(spark.createDataFrame([], "item bigint, who string, given string"), ["item"], "who", "given", ["yes"])
    assert empty.count() == 0


def test_answers(spark):
    df = spark.createDataFrame([(" True",), ("לא",), ("?",), (None,), ("does not apply",)], "a string")
    assert [r[0] for r in df.select(C.answer(F.col("a"))).collect()] == ["yes", "no", None, None, "no"]


# --- p6 ----------------------------------------------------------------------------------------------------------


def test_trie_finds_all_within_the_distance():
    random.seed(5)
    words = {"".join(random.choice("abcd") for _ in range(random.randint(2, 7))) for _ in range(150)}
    trie = Z.Trie()
    for i, w in enumerate(sorted(words)):
        trie.add(w, i)
    for _ in range(40):
        q = "".join(random.choice("abcd") for _ in range(random.randint(1, 7)))
        for k in (0, 1, 2, 3):
            assert trie.search(q, k) == {i: edits(q, w, k) for i, w in enumerate(sorted(words)) if edits(q, w, k) <= k}


def test_link(spark):
    ref = spark.createDataFrame([(1, "דוטקעאווקע (שאדלע)", "Dutkeovke (Shadle)"), (2, "פוטבינע (גרעניץ)", None), (3, "פוטבינע (שאדלע)", None), (None, "x", None)], "id bigint, he string, ro string")
    typed = [(1, "דוטקעאוקוע", None), (2, 'ק"ק דוטקעאווקע', None), (3, "Dutkeovke", None), (4, "פוטבינע בשאדלע", None), (5, "פוטבינע", 3), (6, "די גרויסע שטאט מיט בריק", 2), (7, "די גרויסע שטאט מיט בריק", 2), (8, "די גרויסע שטאט מיט בריק", None), (9, None, None), (10, "--", None), (11, "טבעת", 9), (12, "עקוואעקטוד", None), (13, "ד" * 5000, None)]
    df = spark.createDataFrame(typed, "row bigint, name string, given bigint").withColumn("form", F.lit(0))
    got = {r.row: r.entry_id for r in Z.link(df, "name", "given", ref, "id", ["he", "ro"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 3, 5: 3, 6: 2, 7: 2, 8: 2, 9: -1, 10: -1, 11: -1, 12: 1, 13: -1}
    assert {r.entry_id for r in Z.link(df, "name", "given", ref.limit(0), "id", ["he"]).collect()} == {-1}


def test_entries_near_over_several_shards_and_blocks(spark, monkeypatch):
    """An exact entry hides none of the others, whatever the shards."""
    entries = spark.createDataFrame([(i, f"abcdef{c}", None) for i, c in enumerate("ghijklmnop")] + [(50, "zzzzzz", "far")], "e bigint, name string, district string")
    forms = spark.createDataFrame([(f,) for f in ("abcdefg", "abcdeg", "zzzzzz", "q")], "form string")
    want = {(r.form, r.entry, r.cost) for r in Z.entries_near(forms, entries).collect()}
    assert len({e for f, e, _ in want if f == "abcdefg"}) == 10 and {(e, c) for f, e, c in want if f == "zzzzzz"} == {(50, 0.0)} and "q" not in {f for f, _, _ in want}
    monkeypatch.setattr(Z, "SHARD", 3)
    monkeypatch.setattr(Z, "BLOCK", 2)
    assert {(r.form, r.entry, r.cost) for r in Z.entries_near(forms, entries).collect()} == want
    assert Z.entries_near(forms.limit(0), entries).count() == 0


# --- p7 ----------------------------------------------------------------------------------------------------------


def test_fm_index_against_brute_force():
    r = np.random.default_rng(1)
    for _ in range(60):
        lens = r.integers(1, 30, r.integers(1, 8))
        w = r.integers(0, 4, lens.sum()) * 7919 - 3
        starts = np.cumsum(lens) - lens
        index, k = K.FMIndex(w, starts), int(r.integers(1, 4))
        phrases = r.integers(0, 5, (6, k)) * 7919 - 3
        phrase, at = index.search(phrases)
        text = np.searchsorted(index.starts, at, side="right") - 1
        got = sorted(zip(phrase.tolist(), text.tolist(), (at - index.starts[text]).tolist()))
        assert got == sorted((i, d, j) for i in range(6) for d, (a, n) in enumerate(zip(starts, lens)) for j in range(n - k + 1) if (w[a + j : a + j + k] == phrases[i]).all())


def test_leaks(spark):
    passage = " ".join(f"word{i}" for i in range(40))
    items = spark.createDataFrame([(1, passage), (2, "too short"), (3, None), (1, passage), (None, passage)], "item_id bigint, text string")
    docs = [(1, "start " + passage + " end"), (2, "x " + ", ".join(f"WORD{i}" for i in range(10, 25)).replace("WORD12", "W'ORD12") + " y"), (3, " ".join(f"word{i}" for i in range(14))), (4, None), (5, ""), (6, "z " * 30000 + passage), (1, "start " + passage + " end")]
    got = sorted(map(tuple, K.leaks(spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(9)), "doc_id", "text", items, "item_id", "text").collect()))
    assert got == [(1, 1, 1, 41), (2, 1, 1, 16), (6, 1, 30000, 30040)]
    assert K.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


# --- p8 ----------------------------------------------------------------------------------------------------------


def test_fill_keeps_caps_and_budget():
    got = M.fill({"a": (0.5, 100, 1), "b": (0.3, 1000, 2), "c": (0.2, 0, 3), "d": (0.0, 50, 3)}, 1000)
    assert got["a"] == 100 and got["b"] == pytest.approx(900) and got["c"] == 0 and got["d"] == 0
    assert sum(M.fill({"a": (1.0, 10, 2)}, 1000).values()) == 20


def test_mix(spark):
    docs = [(i, f"text number {i} " * 5, "a" if i < 300 else "b") for i in range(400)] + [(900, None, "a"), (901, "", "a"), (902, "other", None), (903, "text number 0 " * 5, "b"), (904, "lost", "zz")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("n_tokens", F.lit(0))
    goal = spark.createDataFrame([("a", 0.5, 1), ("b", 2.0, 2), ("none", 0.1, 3), ("a", None, None)], "source string, target_share double, max_repeats int")
    chosen, report = M.mix(df, "doc_id", "text", "source", goal, "target_share", "max_repeats")
    rows, shares = chosen.collect(), {r.source: r for r in report.collect()}
    assert all(r.repeats <= (1 if r.source == "a" else 2) for r in rows) and 903 not in {r.doc_id for r in rows}
    assert shares["b"].capped and shares["none"].actual_share == 0
    assert sorted((r.doc_id, r.repeats) for r in rows) == sorted((r.doc_id, r.repeats) for r in M.mix(df, "doc_id", "text", "source", goal, "target_share", "max_repeats")[0].collect())


# --- p9 ----------------------------------------------------------------------------------------------------------


def test_aligned_end():
    long = "The king of the old town went to the river and sat there for a day. Then he came back to the house of his father and slept until the morning came."
    whole = "The king of the old town went to the river and sat there for a day."
    assert T.aligned_end(long[: long.index(" until")] + "...", long) == 1
    assert T.aligned_end(long[: long.index("father") + 3], long) == 1
    assert T.aligned_end(whole, whole + "\nEnd of tale") == 0
    assert T.aligned_end(whole, long) == 0
    assert T.aligned_end(long, long) is None
    assert T.aligned_end("entirely other words stand in this text here", long) is None


def test_word_hashes_and_stops():
    h = T._word_hashes(["The King's, house -- the", "", "kings the\nHOUSE", "\ud800 x"])
    assert [len(x) for x in h] == [4, 0, 3, 1] and h[0][0] == h[0][3] == h[2][1] and h[0][1] == h[2][0] and h[0][2] == h[2][2]
    assert T._signature(h[0]) == [] and len(T._signature(np.arange(9, dtype=np.uint64))) == T.BANDS
    text = "First. " + "word " * 3000
    assert len(T.last_sentence(text)[0]) == 3000 and T.last_sentence("One. Two words")[0] == ["two", "words"]
    assert T.stripped("end. ..\n* …") == "end." and T.stripped("end.") == "end." and T.stripped(" .. ") == ""


def test_copies_meet_every_longer_text(spark):
    """The longest text of a bucket, though it decides nothing, does not hide the copy that does."""
    rng = random.Random(7)
    tale = [" ".join(rng.choice("abcdefghijklmnop") * 3 + str(rng.randint(0, 99)) for _ in range(12)) + "." for _ in range(12)]
    whole = " ".join(tale)
    cut_ = whole[: whole.index(tale[10]) + 25]
    other = " ".join(" ".join(rng.sample(x[:-1].split(), 12)) + "." for x in tale * 3)
    rows = [(1, whole), (2, cut_), (3, other), (4, whole + " " + tale[0])]
    signed = spark.createDataFrame([(i, str(i), n, [1, 2]) for i, n in ((1, 144), (2, 125), (3, 432), (4, 156))], "doc_id bigint, key string, n int, sigs array<bigint>")
    got = {r.key: r.aligned for r in T._copies(signed, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {"2": 1, "1": 0}
    assert T._copies(signed.limit(0), spark.createDataFrame(rows, "doc_id bigint, text string")).count() == 0


def test_broken_off(spark):
    random.seed(1)
    people, things, places = ["Anna", "Boris", "Clara", "David"], ["bread", "a lamp", "the letter", "a coat"], ["the mill", "the river", "the market", "the inn"]
    sentence = lambda: random.choice([f"{random.choice(people)} brought {random.choice(things)} to {random.choice(places)} before the evening.", f"Then {random.choice(people)} asked {random.choice(people)} for {random.choice(things)} and went away again.", f"Nobody near {random.choice(places)} had seen {random.choice(things)} since the winter."])
    docs, cut = [], set()
    for i in range(400):
        t = " ".join(sentence() for _ in range(random.randint(4, 9)))
        if i % 10 == 0:
            t = t[: random.randint(len(t) // 2, len(t) - 25)]
            if t.rstrip()[-1] != ".":
                cut.add(i)
        docs.append((i, t, f"s{i % 3}"))
    docs += [(1000, None, "s1"), (1001, "", None), (1002, " \n", "s1"), (5, docs[5][1], "s2")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("key", F.lit(1))
    rows = T.broken_off(df, "doc_id", "text", "source").collect()
    assert len(rows) == 403
    got = {r.doc_id for r in rows if r.broken}
    assert not got & {1000, 1001, 1002}
    assert len(got & cut) >= 0.8 * len(cut) and len(got - cut) <= 0.2 * len(cut) + 2
    assert T.broken_off(df.limit(0), "doc_id", "text", "source").count() == 0


def test_common_ends_count_all_texts(spark, monkeypatch):
    """Which closing words are common does not rest on the sample; equal texts count once."""
    docs = [(f"k{i}", f"Tale {i} is told here.\nso it was told {'thus' if i % 100 == 0 else i}") for i in range(1000)] + [("k1", "Tale 1 is told here.\nso it was told 1")] * 30
    monkeypatch.setattr(T, "SAMPLE_TEXTS", 20)
    df = spark.createDataFrame([(k, T.closing(t)) for k, t in docs], "key string, words string")
    assert T.common_ends(df) == {"was told thus"}
    assert T.common_ends(df.limit(0)) == set()
    few = ["One came. Two went.\nso it was told thus"]
    assert sum(y for _, y in T._examples(few[0], {"was told thus"}, 1)) == 1 and sum(y for _, y in T._examples(few[0], set(), 1)) == 0


def test_entry_lists_every_problem():
    import __spark_entry__

    found = {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 9)} | {"p8_mix"}
    assert found <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
