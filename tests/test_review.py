import zipfile

from pyspark.sql import functions as F

from loomstead.functions import text as X
from loomstead.operators import graph, linkage, ordered, review, sets
from loomstead.sources import tables


def test_equal_numbers_are_gaps_and_nulls_start_anew(spark):
    u = spark.createDataFrame([(1, i, n, k) for i, (n, k) in enumerate([(1, "story"), (9, "note"), (2, "story"), (2, "unclear"), (None, "story"), (7, "story"), (3, "story")])], "e int, o int, n int, kind string")
    got = [(r.n, r.flag) for r in ordered.numbering_flags(u, "e", "o", "n", F.col("kind").isin("story", "unclear")).orderBy("o").collect()]
    assert got == [(1, None), (2, None), (2, "gap"), (None, None), (7, None), (3, "restart")]


def test_propagated_decisions(spark):
    s = spark.createDataFrame([("a", "t", "confirm"), ("b", "t", "reject"), ("c", "t", None)], "story string, tag string, decision string")
    twins = spark.createDataFrame([("a", "x", 0.9), ("x", "a", 0.8), ("y", "b", 0.9), ("a", "z", None)], "a string, b string, sim double")
    own = spark.createDataFrame([("x", "t", "reject"), ("y", "t", "reject")], "story string, tag string, decision string")
    assert {(r.twin, r.sim, r.action) for r in linkage.propagate(s, twins, own).collect()} == {("x", 0.9, "conflict"), ("y", 0.9, "auto-reject"), ("z", None, "auto-confirm")}


def test_only_given_letters_may_be_attached(spark):
    rows = [("והמלכים", True), ("צצצמלך", False), ("מלך", True), ("המלכצ", False), ("a מלך!", True)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert all(r.got == r.want for r in df.where("t <> 'והמלכים'").select("want", X.term_in_text(F.col("t"), F.lit("מלך")).alias("got")).collect())


def test_far_pairs_stay_conflicts_and_none_is_new(spark):
    left = spark.createDataFrame([(1, "alexandria", 0.0, 0.0), (2, "zzz", 0.0, 0.0)], "key int, name string, lat double, lon double")
    right = spark.createDataFrame([(7, "alexandrio", 0.0, 3.0)], "key int, name string, lat double, lon double")
    got = {r.l: (r.r, r.status) for r in linkage.name_geo_match(left, right).collect()}
    assert got == {1: (7, "CONFLICT"), 2: (None, "NEW")}


def test_removals_have_four_reasons(spark):
    old = spark.createDataFrame([("a", "k:t", "direct", None), ("b", "k:t", "direct", None), ("c", "k:t", "propagated", "a"), ("d", "k:t", "propagated", "q"), ("e", "k:t", "direct", None), ("f", "other:t", "direct", None)], "story_id string, tag string, source string, source_story string")
    pair = lambda *s: spark.createDataFrame([(x, "k:t") for x in s], "story_id string, tag string")
    got = {r.story_id: r.reason for r in sets.removals(old, pair("e"), pair("a"), pair("a"), ["k"]).collect()}
    assert got == {"a": "direct: rejected", "b": "direct: no longer a candidate", "c": "propagated: source rejected", "d": "propagated: source no longer confirmed"}


def test_links_never_overwrite(spark):
    m = spark.createDataFrame([(1, "x", None), (2, "x", 5), (3, "x", 6), (4, "bx", None), (5, "q", None), (6, "x", None)], "mention_id int, name string, ref int")
    own, names = spark.createDataFrame([(6, 9)], "mention_id int, target int"), spark.createDataFrame([("x", 5)], "name string, target int")
    got = {r.mention_id: (r.target, r.action) for r in review.applied_links(m, own, names, "name", F.regexp_replace("name", "^b", "")).collect()}
    assert got == {1: (5, "write"), 2: (5, "noop"), 3: (5, "conflict"), 4: (5, "write"), 5: (None, "none"), 6: (9, "write")}


def test_duplicate_entities_merge_unless_far(spark):
    e = spark.createDataFrame([("P_3", ["c"], 0.0, 0.0), ("P_1", ["a", "b"], 0.0, 0.1), ("P_2", None, None, None), ("P_8", ["h"], 0.0, 0.0), ("P_9", ["i"], 9.0, 0.0), ("P_7", ["x"], 0.0, 0.0)], "id string, names array<string>, lat double, lon double")
    v = spark.createDataFrame([("P_3", "w", "1"), ("P_1", "w", "1"), ("P_1", "k", "2"), ("P_2", "k", "2"), ("P_8", "w", "5"), ("P_9", "w", "5"), ("P_7", "w", "")], "entity string, kind string, value string")
    g = review.duplicate_groups(e, "id", v, X.id_suffix_number(F.col("id")), "lat", "lon")
    assert {(r.id, r.canonical, r.far) for r in g.collect()} == {("P_1", "P_1", False), ("P_2", "P_1", False), ("P_3", "P_1", False), ("P_8", "P_8", True), ("P_9", "P_8", True)}
    merged, moves = review.merged_groups(g, e, "id", "names")
    assert [(r.canonical, r.names) for r in merged.collect()] == [("P_1", ["a", "b", "c"])] and dict(moves.collect()) == {"P_2": "P_1", "P_3": "P_1"}


def test_tags_are_renamed_in_order(spark):
    s = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, []), (3, ["a"])], "s int, tags array<string>")
    rules = spark.createDataFrame([("a", "drop", None), ("b", "split", ["d", "e"]), ("c", "rename", ["e"])], "tag string, action string, targets array<string>")
    assert {r.s: r.tags for r in review.renamed_tags(s, rules, "s", "tags").collect()} == {1: ["d", "e"], 2: [], 3: []}


def test_free_ids_fill_gaps(spark):
    rows, used = spark.createDataFrame([("c",), ("a",), ("b",)], "n string"), spark.createDataFrame([("P_1",), ("P_3",), ("Q_2",)], "id string")
    assert dict(ordered.mint_free_ids(rows, "n", used, "id", "P_").collect()) == {"a": "P_2", "b": "P_4", "c": "P_5"}
    assert dict(ordered.mint_ids(rows, "n", used, "id", "P_").collect()) == {"a": "P_4", "b": "P_5", "c": "P_6"}


def test_long_chains_and_components(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(20)] + [("n0", "zz")], "o string, n string")
    assert dict(graph.rename_closure(chain, "o", "n").collect())["n0"] == "n20"
    assert {r.component for r in graph.connected(spark.createDataFrame([(i, i + 1) for i in range(200)], "a int, b int"), "a", "b").collect()} == {0}


def test_workbook_latin_and_log(spark, tmp_path):
    cells = '<c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>x</t></is></c>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>name</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row>{cells}</row><row><c r="A2"><v>7</v></c></row></sheetData></worksheet>')
    df = tables.read_workbook(spark, str(tmp_path / "b.xlsx"))
    assert df.columns == ["name", "col_1", "x"] and [tuple(r) for r in df.collect()] == [("7", "", "")]
    (tmp_path / "l.csv").write_bytes("name,b\ncafé,1\n".encode("latin-1"))
    assert tables.read_delimited(spark, str(tmp_path / "l.csv")).first()[0] == "café"
    for i in range(2):
        tables.append_log(spark.createDataFrame([(i,)], "i int"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_upsert_keeps_the_latest_and_survives_a_crash(spark, tmp_path):
    path, row = str(tmp_path / "t"), lambda k, v, ts: spark.createDataFrame([(k, v, ts)], "k int, v string, ts int")
    tables.upsert_table(spark, path, row(1, "new", 10), ["k"], "ts")
    tables.upsert_table(spark, path, row(1, "late", 5), ["k"], "ts")
    (tmp_path / "t").rename(tmp_path / "t.before")
    tables.upsert_table(spark, path, row(2, "two", 1), ["k"], "ts")
    assert {(r.k, r.v) for r in tables.read_table(spark, path).collect()} == {(1, "new"), (2, "two")}


def test_flags_of_marked_names(spark):
    rows = [("אב", "placeName", ["short_fragment"]), ("--", "x", ["punct_only"]), ("Hatov_0001", "x", ["xmlid_leak"]), ("משהלידרביאברהם", "persName", ["fused_entity"]), ("רבימשהאברהם", "persName", []), ("", "x", [])]
    df = spark.createDataFrame(rows, "t string, k string, want array<string>")
    assert all(r.got == r.want for r in df.select("want", X.entity_flags(F.col("t"), F.col("k")).alias("got")).collect())


def test_cells_with_many_delimiters_and_equal_cells(spark):
    from loomstead.operators.packed import parses, unpack

    assert ["11", "12", "13", "14"] in [p["items"] for p in parses("11; 12 | 13,14")] and ["1", "2", "3", "4", "5"] in [p["items"] for p in parses("1;2|3,4/5")]
    rows = [(i, f"{i + 100}; {i + 200}") for i in range(40)] + [(501, "7; 8"), (502, "7; 8"), (502, "7; 8"), (503, None), (None, "7; 8")]
    got = {}
    for r in unpack(spark.createDataFrame(rows, "k bigint, c string").withColumn("digest", F.lit(1)), "k", "c", "f").collect():
        got.setdefault(r.row_key, {})[r.pos] = r.item_value
    assert got[501] == got[502] == got[None] == {1: "7", 2: "8"} and len(got) == 43
