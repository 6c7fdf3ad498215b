import pytest
from pyspark.sql import functions as F

from loomstead.functions import text as X
from loomstead.operators import analytics, graph, linkage, ordered, sets
from loomstead.operators.packed import parses, unpack, whole_number
from loomstead.sources import tables, tei

CELLS = [(1, "A/A_1; B/B_2; C/C_3"), (2, '"A; part 3/A_4"; B/B_5'), (3, '["C/C_6", "D/D_7"]'), (4, "E/E_8"), (5, None), (6, " ; "), (7, "A/A_9, B/B_10"), (8, 'x "the ""small"""'), (1, "A/A_1; B/B_2; C/C_3")]


def unpacked(spark, rows):
    df = spark.createDataFrame(rows, "key bigint, cell string").withColumn("pos", F.lit("clash"))
    out = {}
    for r in unpack(df, "key", "cell", "f").orderBy("row_key", "pos").collect():
        out.setdefault(r.row_key, []).append(r.item_value)
    return out


def test_unpack_cells(spark):
    got = unpacked(spark, CELLS * 1 + [(k, f"A/A_{k}; B/B_{k}") for k in range(20, 60)] + [(k, f"A/A_{k}, B/B_{k}") for k in range(60, 80)])
    assert got[1] == ["A/A_1", "B/B_2", "C/C_3"]
    assert got[2] == ["A; part 3/A_4", "B/B_5"]
    assert got[3] == ["C/C_6", "D/D_7"] and got[4] == ["E/E_8"]
    assert 5 not in got and 6 not in got
    assert got[7] == ["A/A_9", "B/B_10"]


def test_unpack_edges(spark):
    assert unpacked(spark, []) == {}
    long = "; ".join(f"A/A_{i}" for i in range(3000))
    got = unpacked(spark, [(None, "A/A_1; B/B_2"), (1, long), (2, "A/A_1; B/B_2")])
    assert got[None] == ["A/A_1", "B/B_2"] and len(got[1]) == 3000


def test_parses_undo_quotes():
    assert any(p["items"] == ['A "small"/A_1', "B"] for p in parses('"A ""small""/A_1"; B'))
    assert parses(None) == [] and parses("  ") == []
    assert any(p["items"] == ['a "b"', "c"] for p in parses('["a \\"b\\"", "c"]'))


def test_whole_number(spark):
    df = spark.createDataFrame([("46049.0",), ("007",), ("x1",), (None,)], "v string")
    assert [r[0] for r in df.select(whole_number(F.col("v"))).collect()] == ["46049", "7", "x1", None]


def test_connected_equals_union_find(spark):
    import random

    random.seed(4)
    edges = [(random.randint(0, 400), random.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.connected(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}


def test_rename_closure_stops_at_cycles(spark):
    rules = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("d", "DROP")], "o string, n string")
    got = dict(graph.rename_closure(rules, "o", "n").collect())
    assert got["a"] == "c" and got["d"] == "DROP" and got["x"] in ("y", "x")


def test_similarity_is_symmetric_and_guarded(spark):
    rows = [("Warsaw", "Warszawa"), ("ab", "ab c"), ("", "x"), (None, "x"), ("Łódź", "lodz"), ("É a", "e  A")]
    df = spark.createDataFrame(rows, "a string, b string").select(X.name_similarity(F.col("a"), F.col("b")).alias("x"), X.name_similarity(F.col("b"), F.col("a")).alias("y"))
    got = [(r.x, r.y) for r in df.collect()]
    assert all(x == pytest.approx(y) for x, y in got)
    assert got[1][0] == pytest.approx(0.5) and got[2][0] == 0 and got[3][0] == 0 and got[4][0] < 1 and got[5][0] == 1


def test_name_candidates_lose_no_pair(spark):
    names = ["Anna", "Ann", "ab", "ab cd", "Johann", "Johanna", "xy", "Maria"]
    t = spark.createDataFrame(list(enumerate(names)), "key int, name string")
    got = {(r.l, r.r) for r in linkage.name_candidates(t, t).collect()}
    a, b = t.withColumnsRenamed({"key": "l", "name": "x"}), t.withColumnsRenamed({"key": "r", "name": "y"})
    need = {(r.l, r.r) for r in a.crossJoin(b).where(X.name_similarity(F.col("x"), F.col("y")) > 0).collect()}
    assert need <= got


def test_greedy_spans_per_document(spark):
    s = spark.createDataFrame([("d", 0, 5), ("d", 0, 9), ("d", 8, 12), ("d", 9, 11), ("e", 3, 4), ("e", None, 4)], "doc string, start int, end int")
    assert sorted(map(tuple, ordered.greedy_spans(s, "doc", "start", "end").collect())) == [("d", 0, 9), ("d", 9, 11), ("e", 3, 4)]


def test_locate_in_order(spark):
    t = "the cat and the dog and The end"
    e = spark.createDataFrame([("d", 0, "the", t), ("d", 1, "the", t), ("d", 2, "dog", t), ("d", 3, "cat", t), ("d", 4, "zebra", t), ("d", 5, None, t)], "doc string, ord int, needle string, text string")
    got = [r.start for r in ordered.locate_in_order(e, "doc", "ord", "needle", "text").orderBy("ord").collect()]
    assert got == [0, 12, 16, 4, None, None]


def test_reconcile_parts_are_disjoint_and_guard_raises(spark):
    p = lambda *x: spark.createDataFrame([(i, "t") for i in x] or [(0, "")], "s int, t string").where("t <> ''")
    r = sets.reconcile(p(1, 2, 3), p(2, 4, 5), p(3, 5), ["s", "t"])
    assert sorted((x.s, x.source) for x in r.collect()) == [(1, "direct"), (2, "direct"), (4, "propagated")]
    with pytest.raises(ValueError):
        sets.guard(p(1), p(1, 2))
    sets.guard(p(1), p(2))


def test_merge_fields_keeps_what_stands(spark):
    base = spark.createDataFrame([("a", ["x"], {"k": "1"}, "")], "id string, names array<string>, ids map<string,string>, geo string")
    extra = spark.createDataFrame([("a", ["x", "y"], {"k": "2", "m": "3"}, "5")], "id string, names array<string>, ids map<string,string>, geo string")
    r = linkage.merge_fields(base, extra, "id", ["names"], ["ids"], ["geo"]).first()
    assert r.names == ["x", "y"] and r.ids == {"k": "1", "m": "3"} and r.geo == "5"


def test_context_rules_first_rule_wins(spark):
    m = spark.createDataFrame([(1, "Lublin", "near the river", None), (2, "Lublin", "far", None), (3, "Lublin", "near the river", "by hand")], "mention_id int, name string, context string, decision string")
    r = spark.createDataFrame([(2, "Lub.*", "river", 20), (1, "L.*", "near", 10)], "rule_no int, name_pattern string, cue string, target int")
    assert [tuple(x) for x in linkage.context_rules(m, r).collect()] == [(1, 10, 1)]


def test_cosine_pairs_do_not_depend_on_blocks(spark):
    v = spark.range(60).select(F.col("id"), F.array(*[F.sin(F.col("id") * (i + 1)).cast("float") for i in range(6)]).alias("v"))
    got = [{(r.a, r.b) for r in linkage.cosine_pairs(v, "id", "v", 0.8, blocks=b).collect()} for b in (1, 5)]
    assert got[0] == got[1] and got[0]


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div type="story" xml:id="s_1"><span ana="a:b; c:d"/><p>In <placeName ref="#p1">Lublin</placeName> lived <persName>Reb <name type="work">X</name></persName>.</p></div>
<div type="story"><p>No tags</p></div></body></text></TEI>"""
LIST = """<listPlace><place xml:id="p1"><placeName>A</placeName><placeName> </placeName><location><geo>51.2,22.5</geo></location><idno type="wikidata">Q1</idno></place><place xml:id="p2"><placeName>B</placeName><location><geo>1,2,3</geo></location></place></listPlace>"""


def test_tei_tables(spark):
    t = spark.createDataFrame([("ed", TEI), ("bad", "<a>"), ("none", None)], "edition string, xml string")
    s = tei.stories(t).orderBy("ord").collect()
    assert [(r.edition, r.story_id, r.tokens) for r in s] == [("ed", "s_1", ["a:b", "c:d"]), ("ed", None, [])]
    m = tei.mentions(t).orderBy("ord").collect()
    assert [(r.kind, r.surface, r.ref, r.story_id) for r in m] == [("placeName", "Lublin", "#p1", "s_1"), ("persName", "Reb X", None, "s_1"), ("name", "X", None, "s_1")]
    a = tei.authority(spark.createDataFrame([("l", LIST)], "edition string, xml string")).orderBy("ord").collect()
    assert a[0].names == ["A"] and (a[0].lat, a[0].lon) == (51.2, 22.5) and a[0].ids == {"Wikidata": "Q1"} and a[1].lat is None


def test_delimited_round_trip(spark, tmp_path):
    (tmp_path / "in.tsv").write_text('﻿Name\tLat\tlon\tnote\nA|B\t51.5\tx\thello\n', encoding="utf-8")
    df = tables.read_delimited(spark, str(tmp_path / "in.tsv"))
    assert df.columns == ["Name", "Lat", "lon", "note"]
    r = tables.typed_places(df, tables.guess_mapping(df.columns)).first()
    assert r.names == ["A", "B"] and r.lat == 51.5 and r.lon is None and r.extra == {"note": "hello"}
    tables.write_delimited(spark.createDataFrame([(1, ["a", "b"])], "id int, names array<string>"), str(tmp_path / "out"))
    assert tables.read_delimited(spark, str(tmp_path / "out"), "\t").first().names == "a | b"


def test_verdict_stream_keeps_the_latest(spark, tmp_path):
    from loomstead.streaming.verdicts import keep_latest, verdict_stream

    (tmp_path / "log").mkdir()
    line = '{"story_id":"s","tag":"t","prompt_hash":"h","model":"m","applies":"%s","ts":"2025-01-0%dT00:00:00Z"}\n'
    (tmp_path / "log/a.json").write_text(line % ("yes", 1) + line % ("no", 2))
    keep_latest(verdict_stream(spark, str(tmp_path / "log")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    (tmp_path / "log/b.json").write_text(line % ("yes", 3))
    keep_latest(verdict_stream(spark, str(tmp_path / "log")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "t")).collect()
    assert [(r.story_id, r.applies) for r in got] == [("s", "yes")]


def test_numbering_flags(spark):
    u = spark.createDataFrame([("e", 1, 1), ("e", 2, 2), ("e", 3, 4), ("e", 4, 1), ("e", 5, None), ("e", 6, 9)], "e string, o int, n int")
    assert [r.flag for r in ordered.numbering_flags(u, "e", "o", "n").orderBy("o").collect()] == [None, None, "gap", "restart", None, None]


def test_expected_counts_sum(spark):
    t = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x")], "r string, c string")
    got = analytics.expected_counts(t, "r", "c").collect()
    assert len(got) == 4 and sum(x.observed for x in got) == 3 and sum(x.expected for x in got) == pytest.approx(3)


def test_markup_round_trip(spark):
    from loomstead.sources import markup

    places = spark.createDataFrame([("p1", ["A & B", "ב"], 51.2, 22.5, {"Wikidata": "Q1"}), ("p2", [], None, None, {})], "xml_id string, names array<string>, lat double, lon double, ids map<string,string>")
    xml = markup.place_elements(places).select(F.col("xml_id").alias("edition"), F.concat(F.lit("<l>"), "xml", F.lit("</l>")).alias("xml"))
    back = {r.xml_id: r for r in tei.authority(xml).collect()}
    assert back["p1"].names == ["A & B", "ב"] and back["p1"].lat == 51.2 and back["p1"].ids == {"Wikidata": "Q1"} and back["p2"].names == []
    t = spark.createDataFrame([("Lublin & Rome", [(0, 6, "placeName", "#p1"), (3, 8, "x", None), (9, 13, "placeName", None)]), (None, None)], "t string, s array<struct<start:int,end:int,tag:string,ref:string>>")
    got = t.select(markup.render_spans("t", "s").alias("x")).collect()
    assert got[0].x == '<placeName ref="#p1">Lublin</placeName> &amp; <placeName>Rome</placeName>' and got[1].x is None
    x = spark.createDataFrame([('<p>zloty <q>zloty</q> <b n="zloty">two zloty</b></p>',)], "x string")
    assert x.select(markup.wrap_terms(F.col("x"), ["zloty"], "m", ["q"]).alias("x")).first().x == '<p><m>zloty</m> <q>zloty</q> <b n="zloty">two <m>zloty</m></b></p>'
    assert x.select(markup.unwrap(F.col("x"), "b").alias("x")).first().x == "<p>zloty <q>zloty</q> two zloty</p>"


def test_ask_stops_after_errors_and_cache_prefers_models(spark):
    from loomstead.operators import funnel

    def client(text):
        if text.startswith("bad"):
            raise RuntimeError("no")
        return text.upper()

    r = spark.createDataFrame([(i, "bad" if i > 1 else "ok") for i in range(6)], "id int, prompt string").coalesce(1)
    got = funnel.ask(r, "prompt", client, "m", retries=1, most_errors=2).orderBy("id").collect()
    assert [(x.reply, x.error) for x in got] == [("OK", None)] * 2 + [(None, "no")] * 2 + [(None, "stopped")] * 2
    v = spark.createDataFrame([("s", "b", "no", 2), ("s", "a", "yes", 1), ("q", "z", "no", 1)], "story string, model string, applies string, ts int")
    hit, miss = funnel.cached(spark.createDataFrame([("s",), ("q",)], "story string"), v, ["story"], ["a", "b"])
    assert [(x.story, x.applies) for x in hit.collect()] == [("s", "yes")] and [x.story for x in miss.collect()] == ["q"]


def test_retained_guard(spark):
    from loomstead.operators import funnel

    b = spark.createDataFrame([("d", i) for i in range(4)] + [("e", 0), ("e", 1)], "doc string, x int")
    got = funnel.retained(b, spark.createDataFrame([("d", 0), ("e", 0)], "doc string, x int"), "doc", 0.5).groupBy("doc").count().collect()
    assert {r.doc: r["count"] for r in got} == {"d": 4, "e": 1}


def test_name_geo_match_reports_new(spark):
    place = "key string, name string, lat double, lon double"
    left = spark.createDataFrame([("a", "Lublin", 51.2, 22.5), ("b", "Qqq", 51.2, 22.5), ("c", None, None, None), ("d", "Lublin", 10.0, 100.0)], place)
    right = spark.createDataFrame([("x", "Lublin", 51.2, 22.5), ("y", "Vilna", 54.7, 25.3)], place)
    got = {r.l: (r.r, r.status) for r in linkage.name_geo_match(left, right).collect()}
    assert got == {"a": ("x", "MATCHED"), "b": (None, "NEW"), "c": (None, "NEW"), "d": ("x", "MATCHED")}
    assert {r.status for r in linkage.name_geo_match(left, right.limit(0)).collect()} == {"NEW"}


def test_name_geo_match_against_all_pairs(spark):
    """Names of few letters, short ones, all bands, spots on both sides of the date line and at a pole, ties, repeats."""
    import random

    rng = random.Random(5)
    stock = ["".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 5, 7]))) for _ in range(10)] + ["ab cd", "cd ab c", "", " ", None]
    stock += [s[:i] + rng.choice("abc") + s[i + 1 :] for s in ["abcdefghijk", "mnopqrstu", "vwxyzabc"] for i in range(len(s))]
    bases = [(50.0, 20.0), (0.0, 179.99), (0.0, -179.99), (89.99, 10.0), (89.99, -170.0), (None, 20.0), (None, None)]

    def spot():
        y, x = rng.choice(bases)
        step = rng.choice([0.0, 0.03, 0.06, 0.4, 3.0])
        return (y and y - step, x)

    place = "key int, name string, lat double, lon double"
    left, right = (spark.createDataFrame([(rng.randrange(n), rng.choice(stock[side::2]), *spot()) for _ in range(n)], place).distinct() for side, n in ((0, 70), (1, 90)))
    left = left.dropDuplicates(["key"]).localCheckpoint()
    right = right.localCheckpoint()
    km = linkage.haversine_km(F.col("lat"), F.col("lon"), F.col("y"), F.col("x"))
    every = left.crossJoin(right.select(F.col("key").alias("r"), F.col("name").alias("b"), F.col("lat").alias("y"), F.col("lon").alias("x")))
    rated = every.select(F.col("key").alias("l"), "r", linkage.geo_band_score(X.name_similarity(F.col("name"), F.col("b")), km).alias("score")).where("score is not null")
    want = {}
    for r in rated.collect():
        want[r.l] = min(want.get(r.l, (9, 0)), (-round(r.score, 6), r.r))
    got = {r.l: r for r in linkage.name_geo_match(left, right).collect()}
    assert {k: (-r.score, r.r) for k, r in got.items() if r.r is not None} == want and len(want) > 10
    assert len(got) == left.count() and {r.status for r in got.values()} >= {"CONFLICT", "NEW"}


def test_bands_beyond_the_nearest_ask_for_a_likely_name(spark):
    bands = [(0.4, 4.0), (0.3, 4.0), (0.4, 20.0), (0.4, 60.0), (0.4, 300.0), (0.4, None), (0.6, 20.0), (0.6, 60.0), (0.6, 300.0), (0.6, None)]
    got = spark.createDataFrame(bands, "sim double, km double").select(linkage.geo_band_score(F.col("sim"), F.col("km")).alias("s")).collect()
    assert [r.s and round(r.s, 6) for r in got] == [0.7, None, None, None, None, None, 0.75, 0.6, 0.45, 0.6]
