"""Queries of the core operators on the test tables, each with its SQL where one exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.functions import numeric as N
from loomstead.functions import text as X
from loomstead.operators import analytics as A
from loomstead.operators import funnel as U
from loomstead.operators import graph as G
from loomstead.operators import linkage as L
from loomstead.operators import ordered as O
from loomstead.operators import sets as S
from loomstead.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# --- functions ---------------------------------------------------------------------------------------------------


@query(r"""SELECT c_custkey, strip_accents(lower(trim(regexp_replace(c_name, '\s+', ' ', 'g')))) AS name, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS key,
CASE WHEN lower(c_mktsegment) LIKE 'tbd%' THEN 'tbd' WHEN regexp_matches(c_mktsegment, '[,/|]') THEN 'bad-sep' WHEN c_mktsegment NOT LIKE '%:%' THEN 'no-colon' ELSE 'ok' END AS tag_class, substr(md5(c_name), 1, 8) AS hash FROM customer""")
def f01_f05_f07_f35_names(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", X.normalize_name(F.col("c_name")).alias("name"), X.alnum_key(F.col("c_name")).alias("key"), X.classify_tag(F.col("c_mktsegment")).alias("tag_class"), X.short_hash(F.col("c_name")).alias("hash"))


@query(r"""SELECT csv_row, CAST(coalesce(nullif(regexp_extract(kima, '[?&]id=(\d+)', 1), ''), nullif(regexp_extract(kima, '/Details/(\d+)', 1), ''), nullif(regexp_extract(kima, '^kima:(\d+)$', 1), ''), nullif(regexp_extract(kima, '^\s*(\d+)(?:\.0*)?\s*$', 1), '')) AS BIGINT) AS kima_number FROM (SELECT DISTINCT csv_row, kima FROM place_csv)""")
def f13_gazetteer_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "place_csv").select("csv_row", "kima").distinct().select("csv_row", X.gazetteer_number(F.col("kima")).alias("kima_number"))


@query(r"""SELECT xml_id, nullif(regexp_extract(wikidata, '(Q\d+)\s*/?$', 1), '') AS item, CAST(coalesce(nullif(regexp_extract(xml_id, '(\d+)$', 1), ''), '999999') AS INT) AS natural_order FROM (SELECT DISTINCT xml_id, wikidata FROM place_xml)""")
def f13_t05_item_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "place_xml").select("xml_id", "wikidata").distinct().select("xml_id", X.item_number(F.col("wikidata")).alias("item"), X.id_suffix_number(F.col("xml_id")).alias("natural_order"))


@query("""SELECT doc_id, CAST(i AS INT) AS chunk_offset, substr(text, CAST(i AS INT) + 1, 1000) AS chunk FROM (SELECT doc_id, text, unnest(CASE WHEN length(text) <= 1000 THEN [0] ELSE range(0, length(text), 800) END) AS i FROM documents WHERE text IS NOT NULL)""")
def f16_chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.explode(X.chunks(F.col("text"))).alias("c")).select("doc_id", F.col("c.offset").alias("chunk_offset"), "c.chunk")


@query("""SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(6371.0 * 2 * atan2(sqrt(h), sqrt(1 - h)), 6) AS km FROM (SELECT n_nationkey, n_nationkey * 3.5 - 40 AS lat, n_nationkey * 7.0 - 80 AS lon FROM nation) a JOIN (SELECT n_nationkey, n_nationkey * 3.5 - 40 AS lat, n_nationkey * 7.0 - 80 AS lon FROM nation) b ON a.n_nationkey < b.n_nationkey, LATERAL (SELECT pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h)""")
def m01_haversine(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 3.5 - 40).alias("lat"), (F.col("n_nationkey") * 7.0 - 80).alias("lon"))
    a, b = (n.select(F.col("n_nationkey").alias(s), F.col("lat").alias(f"{s}1"), F.col("lon").alias(f"{s}2")) for s in ("a", "b"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(N.haversine_km(F.col("a1"), F.col("a2"), F.col("b1"), F.col("b2")), 6).alias("km"))


@query(r"""SELECT label_id, CASE WHEN lower(trim(applies)) IN ('true','yes','y','1','applies') THEN 'yes' WHEN lower(trim(applies)) IN ('false','no','n','0','does not apply') THEN 'no' END AS answer FROM (SELECT DISTINCT label_id, applies FROM human_labels)""")
def f27_tri_state(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "human_labels").select("label_id", "applies").distinct().select("label_id", F.when(X.tri_state(F.col("applies")), "yes").when(~X.tri_state(F.col("applies")), "no").alias("answer"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def m09_json_column(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


# --- aggregations ------------------------------------------------------------------------------------------------

TYPES = ["click", "view", "purchase", "login", "logout", "signup", "error", "search"]


@query("""SELECT t.category, t.ord, coalesce(n, 0) AS n, round_even(100.0 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 1) AS pct FROM (SELECT unnest(['F','O','P','X']) AS category, unnest([0,1,2,3]) AS ord) t LEFT JOIN (SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1) c ON c.o_orderstatus = t.category""")
def a01_category_distribution(spark: SparkSession, d: str) -> DataFrame:
    return A.distribution(table(spark, d, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P", "X"])


@query("""SELECT *, round_even(100.0 * n_he / nullif(n_he + n_yi + n_en, 0), 1) AS pct_he, round_even(100.0 * n_yi / nullif(n_he + n_yi + n_en, 0), 1) AS pct_yi, round_even(100.0 * n_en / nullif(n_he + n_yi + n_en, 0), 1) AS pct_en FROM (SELECT source, count(DISTINCT doc_id) FILTER (lang = 'he') AS n_he, count(DISTINCT doc_id) FILTER (lang = 'yi') AS n_yi, count(DISTINCT doc_id) FILTER (lang = 'en') AS n_en FROM documents WHERE source IS NOT NULL GROUP BY 1)""")
def a02_w12_category_pivot(spark: SparkSession, d: str) -> DataFrame:
    return A.pivot_counts(table(spark, d, "documents"), "source", "lang", "doc_id", ["he", "yi", "en"])


SIDES = "(SELECT p_type AS topic, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS a, count(DISTINCT CASE WHEN NOT (l_returnflag = 'R') THEN l_orderkey END) AS b FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"


def _topics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_type").alias("topic"), "l_orderkey", "l_returnflag", "l_quantity")


@query(f"""SELECT topic, a, b, difference FROM (SELECT *, a - b AS difference, row_number() OVER (ORDER BY a - b DESC, topic) AS h, row_number() OVER (ORDER BY a - b, topic DESC) AS l FROM {SIDES}) WHERE h <= 25 OR l <= 25""")
def a03_w07_topic_difference(spark: SparkSession, d: str) -> DataFrame:
    return A.topic_difference(_topics(spark, d), "topic", "l_orderkey", F.col("l_returnflag") == "R", 25)


@query(f"""SELECT topic, a, b, round(1000.0 * a / aw - 1000.0 * b / bw, 6) AS rate_difference FROM {SIDES}, (SELECT sum(l_quantity) FILTER (l_returnflag = 'R') AS aw, sum(l_quantity) FILTER (l_returnflag <> 'R') AS bw FROM lineitem) WHERE a + b >= 5""")
def a04_topic_rate_per_1000(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "lineitem").agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("a_words"), F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))).alias("b_words"))
    return A.rate_per_thousand(_topics(spark, d), "topic", "l_orderkey", F.col("l_returnflag") == "R", words, 5)


@query(f"""SELECT topic, a, b, round(a / (a + b), 6) AS share FROM {SIDES} WHERE a + b >= 5""")
def a05_a06_relative_frequency(spark: SparkSession, d: str) -> DataFrame:
    return A.relative_frequency(_topics(spark, d), "topic", "l_orderkey", F.col("l_returnflag") == "R", 5)


@query("""SELECT *, round(present / nullif(total, 0), 6) AS present_share, round(agents / nullif(present, 0), 6) AS agent_share FROM (SELECT count(DISTINCT o_orderkey) AS total, count(DISTINCT o_orderkey) FILTER (o_orderpriority <> '5-LOW') AS present, count(DISTINCT o_orderkey) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS agents FROM orders)""")
def a08_agency_funnel(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return A.funnel(o, "o_orderkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"], ["1-URGENT", "2-HIGH"])


@query("""SELECT CAST(date_part('year', o_orderdate) AS INT) AS year, count(*) AS n, round_even(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS pct FROM orders GROUP BY 1 HAVING count(*) >= 5""")
def a10_diachronic_share(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), N.share(F.count_if(F.col("o_orderstatus") == "F"), F.count("*")).alias("pct")).where("n >= 5")


@query("""SELECT lang, count(*) AS n, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.75) AS q3 FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL GROUP BY 1""")
def a11_m04_length_quartiles(spark: SparkSession, d: str) -> DataFrame:
    q = F.percentile("n_chars", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return table(spark, d, "documents").where("lang is not null and n_chars is not null").groupBy("lang").agg(F.count("*").alias("n"), q.alias("q")).select("lang", "n", *[F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])


@query("""WITH once AS (SELECT DISTINCT tag, story_id AS item, split_part(story_id, '_', 1) AS edition FROM quality_results WHERE tag IS NOT NULL), freq AS (SELECT tag, count(DISTINCT item) AS n, count(DISTINCT edition) AS editions FROM once GROUP BY 1), pairs AS (SELECT a.tag, b.tag AS other, count(*) AS c FROM (SELECT DISTINCT tag, item FROM once) a JOIN (SELECT DISTINCT tag, item FROM once) b ON a.item = b.item AND a.tag <> b.tag GROUP BY 1, 2), best AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY c DESC, other) AS r FROM pairs) SELECT freq.tag, n, editions, coalesce((SELECT string_agg(other || '(' || c || ')', ', ' ORDER BY r) FROM best WHERE best.tag = freq.tag AND r <= 5), '') AS cooccurring FROM freq""")
def a13_a14_tag_inventory(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "quality_results").withColumn("edition", F.split("story_id", "_")[0])
    return A.inventory(t, "tag", "story_id", "edition")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("lang = 'en' and text is not null").select("doc_id", F.coalesce(F.col("source") == "ocr_scan", F.lit(False)).alias("yes"), F.explode(X.latin_words(F.col("text"))).alias("word"))


TOKENS = "(SELECT doc_id, coalesce(source = 'ocr_scan', false) AS yes, unnest(list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda w: length(w) >= 2)) AS word FROM documents WHERE lang = 'en' AND text IS NOT NULL)"


@query(f"""WITH t AS {TOKENS}, tot AS (SELECT count(*) FILTER (yes) AS wt, count(*) FILTER (NOT yes) AS vt FROM t) SELECT word, w, v, round((w / wt + 1e-6) / (v / vt + 1e-6), 6) AS ratio FROM (SELECT word, count(*) FILTER (yes) AS w, count(*) FILTER (NOT yes) AS v FROM t GROUP BY 1), tot WHERE w >= 5""")
def a31_f23_vocabulary_by_tokens(spark: SparkSession, d: str) -> DataFrame:
    return A.token_ratio(_tokens(spark, d), "word", F.col("yes"), 5)


@query(f"""WITH t AS {TOKENS}, n AS (SELECT count(*) FILTER (coalesce(source = 'ocr_scan', false)) AS y, count(*) FILTER (NOT coalesce(source = 'ocr_scan', false)) AS o FROM documents WHERE lang = 'en' AND text IS NOT NULL) SELECT word, w, v, round((w / y) / ((v + 0.5) / o), 6) AS ratio FROM (SELECT word, count(DISTINCT doc_id) FILTER (yes) AS w, count(DISTINCT doc_id) FILTER (NOT yes) AS v FROM t GROUP BY 1), n WHERE w >= 5 ORDER BY ratio DESC, word LIMIT 80""")
def a32_t03_vocabulary_by_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("lang = 'en' and text is not null").agg(F.count_if(F.coalesce(F.col("source") == "ocr_scan", F.lit(False))).alias("yes_n"), F.count_if(~F.coalesce(F.col("source") == "ocr_scan", F.lit(False))).alias("no_n"))
    return A.document_prevalence(_tokens(spark, d), "word", "doc_id", F.col("yes"), docs, 5, 80)


@query("""WITH c AS (SELECT lang, source, count(*) AS observed FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2), r AS (SELECT lang, sum(observed) AS r FROM c GROUP BY 1), k AS (SELECT source, sum(observed) AS c FROM c GROUP BY 1), t AS (SELECT sum(observed) AS t FROM c) SELECT r.lang, k.source, coalesce(observed, 0) AS observed, round(r.r * k.c / t.t, 6) AS expected, round(pow(coalesce(observed, 0) - r.r * k.c / t.t, 2) / (r.r * k.c / t.t), 6) AS part FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.lang = r.lang AND c.source = k.source""")
def a28_chi_square_expected(spark: SparkSession, d: str) -> DataFrame:
    return A.expected_counts(table(spark, d, "documents"), "lang", "source")


ANSWER = "CASE WHEN lower(trim({0})) IN ('true','yes','y','1','applies') THEN true WHEN lower(trim({0})) IN ('false','no','n','0','does not apply') THEN false END"


@query(f"""WITH q AS (SELECT DISTINCT story_id, tag, {ANSWER.format('sonnet_applies')} AS a, {ANSWER.format('opus_applies')} AS b FROM quality_results) SELECT "both", only_a, only_b, neither, "open", round(("both" + neither) / nullif("both" + neither + only_a + only_b, 0), 6) AS accuracy FROM (SELECT count(*) FILTER (a AND b) AS "both", count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither, count(*) FILTER (a IS NULL OR b IS NULL) AS "open" FROM q)""")
def a24_model_agreement(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "quality_results").select("story_id", "tag", X.tri_state(F.col("sonnet_applies")).alias("a"), X.tri_state(F.col("opus_applies")).alias("b")).distinct()
    return A.agreement(q, "a", "b")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "story_duplicates").where("trim(story_a) <> '' and trim(story_b) <> ''").select(F.trim("story_a").alias("a"), F.trim("story_b").alias("b"), "edition_a", "edition_b", "sim").distinct()


PAIRS = "(SELECT DISTINCT trim(story_a) AS a, trim(story_b) AS b, edition_a, edition_b, sim FROM story_duplicates WHERE trim(story_a) <> '' AND trim(story_b) <> '')"


@query(f"""SELECT least(edition_a, edition_b) AS left_group, greatest(edition_a, edition_b) AS right_group, count(*) AS weight FROM {PAIRS} WHERE edition_a <> edition_b GROUP BY 1, 2""")
def a20_edge_weights(spark: SparkSession, d: str) -> DataFrame:
    return A.edge_weights(_pairs(spark, d), "edition_a", "edition_b")


CUTS = [0.999, 0.995, 0.99, 0.985, 0.98, 0.97, 0.96, 0.95]


@query(f"""SELECT threshold, count(*) FILTER (sim >= threshold) AS all_pairs, count(*) FILTER (sim >= threshold AND edition_a <> edition_b) AS cross_pairs FROM {PAIRS}, (SELECT unnest({CUTS}::DOUBLE[]) AS threshold) GROUP BY 1""")
def a22_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return A.threshold_sweep(_pairs(spark, d), "sim", "edition_a", "edition_b", CUTS)


@query("""WITH p AS (SELECT DISTINCT xml_id, wikidata, tsadikim, jewishgen FROM place_xml), h AS (SELECT xml_id, 'wikidata' AS kind, wikidata AS value FROM p UNION ALL SELECT xml_id, 'tsadikim', tsadikim FROM p UNION ALL SELECT xml_id, 'jewishgen', jewishgen FROM p) SELECT kind, value, count(DISTINCT xml_id) AS n, string_agg(DISTINCT xml_id, ', ' ORDER BY xml_id) AS entities FROM h WHERE value <> '' GROUP BY 1, 2 HAVING count(DISTINCT xml_id) > 1""")
def a18_shared_identifiers(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "place_xml").select("xml_id", F.create_map(*[x for c in ("wikidata", "tsadikim", "jewishgen") for x in (F.lit(c), F.col(c))]).alias("ids"))
    return A.shared_values(p, "xml_id", "ids")


@query("""SELECT (CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) + (CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END) + (CASE WHEN o_orderpriority = '1-URGENT' THEN 4 ELSE 0 END) AS mask, count(*) AS n FROM orders GROUP BY 1""")
def a38_region_counts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select((F.col("o_totalprice") > 100000).alias("a"), (F.col("o_orderstatus") == "F").alias("b"), (F.col("o_orderpriority") == "1-URGENT").alias("c"))
    return A.cells_of_three(o, ["a", "b", "c"])


@query("""SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)) WHERE r = 1""")
def a33_m07_dominant(spark: SparkSession, d: str) -> DataFrame:
    return A.dominant(table(spark, d, "events"), "user_id", "event_type", "event_id")


@query("""SELECT name_heb AS name, count(*) AS occurrences, count(DISTINCT kind) AS kinds, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS kind_list FROM (SELECT DISTINCT row_id, name_heb, kind FROM auto_confirmed WHERE name_heb IS NOT NULL) GROUP BY 1""")
def a15_a16_name_report(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "auto_confirmed").where("name_heb is not null").select("row_id", "name_heb", "kind").distinct()
    return t.groupBy(F.col("name_heb").alias("name")).agg(F.count("*").alias("occurrences"), F.countDistinct("kind").alias("kinds"), F.array_join(F.sort_array(F.collect_set("kind")), ", ").alias("kind_list"))


@query("""SELECT match_method, status, count(*) AS n FROM match_results GROUP BY 1, 2""")
def a27_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "match_results").groupBy("match_method", "status").agg(F.count("*").alias("n"))


# --- windows and order -------------------------------------------------------------------------------------------


@query("""SELECT user_id, event_id, n, CASE WHEN n < p THEN 'restart' WHEN n <> p + 1 THEN 'gap' END AS flag FROM (SELECT *, lag(n) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM (SELECT user_id, event_id, CASE WHEN event_id % 11 <> 0 THEN event_id % 3 END AS n FROM events WHERE event_type <> 'error'))""")
def w01_numbering_flags(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_id") % 11 != 0, F.col("event_id") % 3).alias("n"))
    return O.numbering_flags(e, "user_id", "event_id", "n", F.col("event_type") != "error").drop("event_type")


@query("""SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS unit FROM events""")
def w02_segment_units(spark: SparkSession, d: str) -> DataFrame:
    return O.segment(table(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "click").select("user_id", "event_id", "unit")


@query("""SELECT o_custkey, o_orderkey, printf('%s_%04d', CAST(o_custkey AS VARCHAR), row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) AS unit_id FROM orders""")
def w03_unit_ids(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return O.unit_ids(o.withColumn("part", F.col("o_custkey").cast("string")), "part", "o_orderkey").drop("part")


@query("""SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS INT) AS occurrence FROM events""")
def w04_occurrence_counter(spark: SparkSession, d: str) -> DataFrame:
    return O.occurrence(table(spark, d, "events"), ["user_id", "event_type"], "event_id").select("event_id", "occurrence")


@query("""SELECT source, doc_id, CAST(turn AS INT) AS turn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) AS turn FROM documents WHERE source IS NOT NULL) ORDER BY turn, source LIMIT 50""")
def w11_t02_stratified_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return O.round_robin(table(spark, d, "documents").where("source is not null").select("source", "doc_id"), "source", "doc_id", 50)


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_returnflag AS old_label FROM lineitem WHERE l_quantity < 40), a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.05 THEN 'X' ELSE l_returnflag END AS new_label FROM lineitem WHERE l_quantity > 10) SELECT coalesce(b.l_orderkey, a.l_orderkey) AS l_orderkey, coalesce(b.l_linenumber, a.l_linenumber) AS l_linenumber, old_label, new_label, CASE WHEN old_label IS NULL THEN 'added' WHEN new_label IS NULL THEN 'removed' WHEN old_label <> new_label THEN 'reclassified' ELSE 'kept' END AS action FROM b FULL JOIN a ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber""")
def a30_n06_correction_diff(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    return O.correction_diff(t.where("l_quantity < 40"), t.where("l_quantity > 10").withColumn("l_returnflag", F.when(F.col("l_tax") > 0.05, "X").otherwise(F.col("l_returnflag"))), ["l_orderkey", "l_linenumber"], "l_returnflag")


# --- sets --------------------------------------------------------------------------------------------------------


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    q = table(spark, d, "quality_results")
    h = table(spark, d, "human_labels")
    yes = h.where(X.tri_state(F.col("applies"))).select("story_id", "tag")
    no = h.where(~X.tri_state(F.col("applies"))).select("story_id", "tag")
    sonnet = q.where(X.tri_state(F.col("sonnet_applies"))).select("story_id", "tag")
    opus = q.where(X.tri_state(F.col("opus_applies"))).select("story_id", "tag")
    return yes, no, sonnet, opus


def _side_sql() -> str:
    return f"yes AS (SELECT story_id, tag FROM human_labels WHERE {ANSWER.format('applies')}), no AS (SELECT story_id, tag FROM human_labels WHERE NOT {ANSWER.format('applies')}), sonnet AS (SELECT story_id, tag FROM quality_results WHERE {ANSWER.format('sonnet_applies')}), opus AS (SELECT story_id, tag FROM quality_results WHERE {ANSWER.format('opus_applies')})"


@query(f"WITH {_side_sql()} (SELECT * FROM sonnet UNION SELECT * FROM opus) EXCEPT SELECT * FROM no")
def u01_surviving_pairs(spark: SparkSession, d: str) -> DataFrame:
    _, no, sonnet, opus = _sides(spark, d)
    return S.surviving([sonnet, opus], [no])


@query(f"WITH {_side_sql()} (SELECT * FROM yes EXCEPT SELECT * FROM no) EXCEPT (SELECT * FROM sonnet INTERSECT SELECT * FROM yes)")
def u02_original_pairs(spark: SparkSession, d: str) -> DataFrame:
    yes, no, sonnet, _ = _sides(spark, d)
    return S.original(yes, no, sonnet)


@query(f"WITH {_side_sql()} SELECT *, 'direct' AS source FROM (SELECT * FROM sonnet EXCEPT SELECT * FROM no) UNION ALL SELECT *, 'propagated' FROM ((SELECT * FROM opus EXCEPT SELECT * FROM no) EXCEPT SELECT * FROM sonnet)")
def u03_verdict_reconcile(spark: SparkSession, d: str) -> DataFrame:
    _, no, sonnet, opus = _sides(spark, d)
    return S.reconcile(sonnet, opus, no, ["story_id", "tag"])


@query(f"WITH {_side_sql()} (SELECT tag, 'left' AS side FROM (SELECT DISTINCT tag FROM yes EXCEPT SELECT tag FROM sonnet)) UNION ALL (SELECT tag, 'right' FROM (SELECT DISTINCT tag FROM sonnet EXCEPT SELECT tag FROM yes))")
def u05_u10_gaps(spark: SparkSession, d: str) -> DataFrame:
    yes, _, sonnet, _ = _sides(spark, d)
    return S.gaps(yes.select("tag"), sonnet.select("tag"))


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def u07_s17_latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return S.first_by_rank(table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], F.col("ts").desc(), F.col("event_id").desc()).drop("ts")


@query(f"WITH {_side_sql()} SELECT DISTINCT story_id, tag FROM quality_results EXCEPT SELECT * FROM yes")
def u08_remaining_work(spark: SparkSession, d: str) -> DataFrame:
    yes, *_ = _sides(spark, d)
    return S.remaining(table(spark, d, "quality_results").select("story_id", "tag").distinct(), yes, ["story_id", "tag"])


# --- linkage -----------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT c_custkey AS l, 'n' || c_nationkey AS v FROM customer WHERE c_custkey <= 100000000), r AS (SELECT min(s_suppkey) AS r, 'n' || s_nationkey AS v, count(*) AS n FROM supplier GROUP BY 2) SELECT l, r, 'nation' AS kinds, CASE WHEN n = 1 THEN 'MATCHED' ELSE 'CONFLICT' END AS status, CASE WHEN n = 1 THEN 1.0 ELSE 0.9 END AS confidence FROM l JOIN r USING (v)""")
def j01_identifier_match(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit("nation").alias("kind"), F.concat(F.lit("n"), "c_nationkey").alias("value"))
    right = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.lit("nation").alias("kind"), F.concat(F.lit("n"), "s_nationkey").alias("value"))
    return L.identifier_match(left, right)


@query()
def j02_name_geo_match(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "place_csv").select(F.col("csv_row").alias("key"), F.get("names", F.lit(0)).alias("name"), "lat", "lon").dropDuplicates(["key"])
    right = table(spark, d, "place_xml").select(F.col("xml_id").alias("key"), F.explode("names").alias("name"), "lat", "lon").where("trim(name) <> ''").distinct()
    return L.name_geo_match(left, right)


@query()
def j03_j04_name_match(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "edition_metadata").select(F.col("edition_no").alias("key"), F.col("title_en").alias("name")).dropDuplicates(["key"])
    return L.name_match(left, table(spark, d, "edition_list").select(F.col("edition").alias("key"), F.col("edition").alias("name")))


@query("""WITH t AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus FROM orders) SELECT t.*, coalesce(a.target, b.target) AS target, CAST(CASE WHEN a.target IS NOT NULL THEN 1 WHEN b.target IS NOT NULL THEN 2 END AS INT) AS source_rank FROM t LEFT JOIN (SELECT c_custkey AS o_custkey, c_name AS target FROM customer WHERE c_acctbal > 5000) a USING (o_custkey) LEFT JOIN (SELECT * FROM (VALUES ('1-URGENT', 'urgent'), ('2-HIGH', 'high')) v(o_orderpriority, target)) b USING (o_orderpriority)""")
def j07_j09_j14_precedence(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    a = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("target"))
    b = spark.createDataFrame([("1-URGENT", "urgent"), ("2-HIGH", "high")], "o_orderpriority string, target string")
    return L.precedence(o, [(a, ["o_custkey"]), (b, ["o_orderpriority"])], "target")


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label <> b.label WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35""")
def j18_cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return L.cosine_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.35, group="label").withColumn("sim", F.round("sim", 4))


@query(f"""WITH t AS (SELECT a AS story, b AS twin, sim FROM {PAIRS} UNION ALL SELECT b, a, sim FROM {PAIRS}) SELECT story, twin, sim FROM (SELECT *, row_number() OVER (PARTITION BY story ORDER BY sim DESC NULLS LAST, twin) AS r FROM t WHERE story <> twin) WHERE r = 1""")
def j22_w05_closest_twin(spark: SparkSession, d: str) -> DataFrame:
    return L.closest_twin(_pairs(spark, d))


@query(f"""WITH g AS (SELECT story_id AS story, tag, CASE WHEN bool_or({ANSWER.format('sonnet_applies')}) THEN 'confirm' WHEN bool_or({ANSWER.format('sonnet_applies')}) IS NOT NULL THEN 'reject' END AS decision FROM quality_results GROUP BY 1, 2), v AS (SELECT story_id AS story, tag, CASE WHEN bool_or({ANSWER.format('opus_applies')}) THEN 'confirm' WHEN bool_or({ANSWER.format('opus_applies')}) IS NOT NULL THEN 'reject' END AS existing FROM quality_results GROUP BY 1, 2), t AS (SELECT story, twin, max(sim) AS sim FROM (SELECT a AS story, b AS twin, sim FROM {PAIRS} UNION ALL SELECT b, a, sim FROM {PAIRS} UNION ALL SELECT story_id, story_id, 1.0 FROM quality_results) GROUP BY 1, 2) SELECT g.story, g.tag, t.twin, t.sim, g.decision, CASE WHEN v.existing <> g.decision THEN 'conflict' ELSE 'auto-' || g.decision END AS action FROM g JOIN t USING (story) LEFT JOIN v ON v.story = t.twin AND v.tag = g.tag WHERE g.decision IS NOT NULL""")
def j20_propagate(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "quality_results")
    decision = lambda c: F.when(F.bool_or(X.tri_state(F.col(c))), "confirm").when(F.bool_or(X.tri_state(F.col(c))).isNotNull(), "reject").alias("decision")
    own = q.select(F.col("story_id").alias("a"), F.col("story_id").alias("b"), F.lit(1.0).alias("sim"))  # a story's other judge stands in for a twin with a verdict
    sides = q.select(F.col("story_id").alias("story"), "tag", "sonnet_applies", "opus_applies").groupBy("story", "tag")
    return L.propagate(sides.agg(decision("sonnet_applies")), _pairs(spark, d).select("a", "b", "sim").union(own), sides.agg(decision("opus_applies")))


@query("""WITH m AS (SELECT label, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, d, avg(x) AS m FROM m GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM c GROUP BY 1) SELECT c.label, CAST(c.d AS INT) AS d, round(m / n, 6) AS x FROM c JOIN n USING (label)""")
def a34_centroids(spark: SparkSession, d: str) -> DataFrame:
    c = L.centroids(table(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("d", "x")).select("label", (F.col("d") + 1).alias("d"), F.round("x", 6).alias("x"))


# --- graphs ------------------------------------------------------------------------------------------------------


@query()
def g01_a23_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    c = G.connected(_pairs(spark, d), "a", "b")
    return c.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")


RULES = [("click", "view"), ("view", "look"), ("search", "find"), ("purchase", "DROP"), ("find", "search")]


@query("""SELECT * FROM (VALUES ('click', 'look'), ('view', 'look'), ('search', 'find'), ('purchase', 'DROP'), ('find', 'search')) v(name, target)""")
def g04_rename_closure(spark: SparkSession, d: str) -> DataFrame:
    return G.rename_closure(spark.createDataFrame(RULES, "old string, new string"), "old", "new")


@query("""WITH v AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings), u AS (SELECT vec_id, label, d, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM v), c AS (SELECT label, d, avg(x) AS m FROM u GROUP BY 1, 2), k AS (SELECT label AS tag, d, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS m FROM c), s AS (SELECT tag, vec_id, label, round(sum(x * m), 6) AS sim FROM u JOIN k USING (d) GROUP BY 1, 2, 3), q AS (SELECT tag, quantile_cont(sim, 0.1) AS lo, quantile_cont(sim, 0.4) AS hi FROM s WHERE label = tag GROUP BY 1), j AS (SELECT s.tag, vec_id, sim, CASE WHEN label = s.tag AND sim < lo THEN 'false_positive' WHEN label <> s.tag AND sim >= hi THEN 'candidate' WHEN label <> s.tag THEN 'control' END AS role FROM s JOIN q USING (tag)), r AS (SELECT *, row_number() OVER (PARTITION BY tag, role ORDER BY CASE WHEN role = 'control' THEN md5('0:' || tag || ':' || vec_id) ELSE '' END, sim DESC, vec_id) AS r FROM j WHERE role IS NOT NULL) SELECT tag, vec_id, role, sim FROM r WHERE role = 'false_positive' OR (role = 'candidate' AND r <= 60) OR (role = 'control' AND r <= 10)""")
def l01_l02_t01_audit_funnel(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return U.audit_funnel(e, "vec_id", "embedding", e.select("vec_id", F.col("label").alias("tag")), "tag")
