"""Queries of the review, annotation and authority operators on the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstead.functions import numeric as N
from loomstead.functions import text as X
from loomstead.operators import funnel as U
from loomstead.operators import linkage as L
from loomstead.operators import ordered as O
from loomstead.operators import review as R
from loomstead.operators import sets as S
from loomstead.plans.reference_queries import ANSWER, PAIRS, _pairs
from loomstead.session import table
from loomstead.sources.tei import ID_TYPES

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _stories(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "quality_results").where("tag is not null")
    return q.groupBy("story_id").agg(F.sort_array(F.collect_set("tag")).alias("tags")).withColumn("edition", F.split("story_id", "_")[0])


STORIES = "stories AS (SELECT story_id, list_sort(list_distinct(list(tag))) AS tags, split_part(story_id, '_', 1) AS edition FROM quality_results WHERE tag IS NOT NULL GROUP BY 1)"
YES = ANSWER.format("opus_applies")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """One row per item with both models' answers."""
    q = table(spark, d, "quality_results").groupBy("story_id", "tag")
    return q.agg(F.bool_or(X.tri_state(F.col("sonnet_applies"))).alias("sonnet"), F.bool_or(X.tri_state(F.col("opus_applies"))).alias("opus"), F.max("opus_confidence").alias("confidence")).withColumn("category", F.substring_index("tag", ":", 1)).withColumn("edition", F.split("story_id", "_")[0])


ITEMS = f"items AS (SELECT *, split_part(tag, ':', 1) AS category, split_part(story_id, '_', 1) AS edition FROM (SELECT story_id, tag, bool_or({ANSWER.format('sonnet_applies')}) AS sonnet, bool_or({YES}) AS opus, max(opus_confidence) AS confidence FROM quality_results GROUP BY 1, 2))"


# --- filters and projections -------------------------------------------------------------------------------------


@query(f"WITH {STORIES} SELECT story_id, list_contains(tags, 'speech:oath') AS positive FROM stories")
def proj_p04_tag_split(spark: SparkSession, d: str) -> DataFrame:
    return _stories(spark, d).select("story_id", F.array_contains("tags", "speech:oath").alias("positive"))


@query(f"WITH {STORIES} SELECT story_id, array_to_string(list_filter(tags, lambda t: contains(t, ':') AND NOT starts_with(upper(t), 'TBD') AND NOT starts_with(t, 'speech:')), ';') AS topics FROM stories")
def proj_p05_f06_topic_filter(spark: SparkSession, d: str) -> DataFrame:
    return _stories(spark, d).select("story_id", F.array_join(X.topics(F.col("tags"), "speech"), ";").alias("topics"))


@query(f"WITH {ITEMS} SELECT story_id, tag, edition FROM items WHERE edition IN (SELECT edition FROM items WHERE opus AND tag = 'speech:oath')")
def proj_p06_annotated_editions(spark: SparkSession, d: str) -> DataFrame:
    return R.only_groups_with(_answers(spark, d).select("story_id", "tag", "edition", "opus"), "edition", F.col("opus") & (F.col("tag") == "speech:oath")).select("story_id", "tag", "edition")


@query(f"WITH {STORIES}, {ITEMS} SELECT story_id, array_to_string(list_filter(tags, lambda t: NOT list_contains(coalesce(x, []), t)), ';') AS kept FROM stories LEFT JOIN (SELECT story_id, list(tag) AS x FROM items WHERE opus GROUP BY 1) USING (story_id)")
def proj_p07_n10_provenance(spark: SparkSession, d: str) -> DataFrame:
    return R.without_pairs(_stories(spark, d), _answers(spark, d).where("opus").select("story_id", "tag"), "story_id", "tags", "tag").select("story_id", F.array_join("tags", ";").alias("kept"))


@query(f"WITH {ITEMS}, h AS (SELECT story_id, tag, bool_or({ANSWER.format('applies')}) AS v FROM human_labels GROUP BY 1, 2) SELECT story_id, tag, coalesce(v, opus) AS applies FROM items LEFT JOIN h USING (story_id, tag)")
def proj_p08_override(spark: SparkSession, d: str) -> DataFrame:
    human = table(spark, d, "human_labels").groupBy("story_id", "tag").agg(F.bool_or(X.tri_state(F.col("applies"))).alias("applies"))
    return R.overridden(_answers(spark, d).select("story_id", "tag", F.col("opus").alias("applies")), human, ["story_id", "tag"], "applies")


@query(f"WITH {ITEMS} SELECT s.story_id, tag, opus, confidence FROM (SELECT DISTINCT trim(story_a) AS story_id FROM story_duplicates) s JOIN items USING (story_id) WHERE confidence = 'high'")
def proj_p09_tier_restrict(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "story_duplicates").select(F.trim("story_a").alias("story_id")).distinct()
    return s.join(_answers(spark, d), "story_id").where("confidence = 'high'").select("story_id", "tag", "opus", "confidence")


def _routed(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fuzzy_review").select("review_id", "flag", "reason", "name", "confidence", "occurrences").where("name is not null").distinct()
    return f.withColumn("status", F.when(F.col("flag") == "HIGH", "name_ambiguous").when(F.col("flag") == "MEDIUM", "fuzzy").otherwise("name_exact")).withColumn("candidates", F.filter(F.split("name", " "), lambda x: x != ""))


ROUTED = "routed AS (SELECT *, CASE WHEN flag = 'HIGH' THEN 'name_ambiguous' WHEN flag = 'MEDIUM' THEN 'fuzzy' ELSE 'name_exact' END AS status, list_filter(string_split(name, ' '), lambda x: x <> '') AS candidates FROM (SELECT DISTINCT review_id, flag, reason, name, confidence, occurrences FROM fuzzy_review WHERE name IS NOT NULL))"


@query(f"WITH {ROUTED} SELECT review_id, coalesce(status = 'name_ambiguous', false) OR coalesce(contains(reason, 'phonetic_mismatch'), false) OR (status = 'fuzzy' AND len(candidates) > 1) AS route FROM routed")
def proj_p10_needs_context(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d).select("review_id", X.needs_context(F.col("status"), F.col("reason"), F.col("candidates")).alias("route"))


@query("SELECT p_partkey, nullif(regexp_extract(p_name, '(ring|widget)', 1), '') AS token FROM part")
def proj_p11_implausible(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.nullif(F.regexp_extract("p_name", "(ring|widget)", 1), F.lit("")).alias("token"))


FLAGS = r"""flags AS (SELECT review_id, kind, edition, flag FROM (SELECT review_id, kind, edition, unnest(list_filter([CASE WHEN length(t) <= 2 THEN 'short_fragment' END, CASE WHEN regexp_matches(t, '^[\s׳״"''.,:;!?()–—\-/\\|]+$') THEN 'punct_only' END, CASE WHEN regexp_matches(t, '_0[0-9]') THEN 'xmlid_leak' END, CASE WHEN NOT regexp_matches(t, '\s') AND length(regexp_replace(t, '[^א-ת]', '', 'g')) > 6 AND NOT regexp_matches(t, '^(ר׳|הרב|רבי|מהר|מורנו|ה״ה|כ״ק|ר")') AND regexp_matches(t, '.(ר׳|הרב|רבי|מהר|מורנו|ה״ה|כ״ק|ר").*[א-ת]') THEN 'fused_entity' END], lambda x: x IS NOT NULL)) AS flag FROM (SELECT DISTINCT review_id, trim(name) AS t, CASE WHEN flag = 'HIGH' THEN 'placeName' ELSE 'persName' END AS kind, source_edition AS edition FROM fuzzy_review WHERE trim(name) <> '' UNION SELECT DISTINCT row_id + 1000000000, replace(trim(name_heb), ' ', '') || '_0' || (row_id % 20)::VARCHAR, 'placeName', 'auto' FROM auto_linked WHERE trim(name_heb) <> '')))"""


def _flags(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fuzzy_review").select("review_id", F.trim("name").alias("t"), F.when(F.col("flag") == "HIGH", "placeName").otherwise("persName").alias("kind"), F.col("source_edition").alias("edition"))
    a = table(spark, d, "auto_linked").where("trim(name_heb) <> ''").select((F.col("row_id") + 1000000000).alias("review_id"), F.concat(F.replace(F.trim("name_heb"), F.lit(" "), F.lit("")), F.lit("_0"), (F.col("row_id") % 20).cast("string")).alias("t"), F.lit("placeName").alias("kind"), F.lit("auto").alias("edition"))
    return f.where("t <> ''").union(a).distinct().select("review_id", "kind", "edition", F.explode(X.entity_flags(F.col("t"), F.col("kind"))).alias("flag"))


@query(f"WITH {FLAGS} SELECT review_id, kind, flag FROM flags")
def proj_p13_quality_flags(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).select("review_id", "kind", "flag")


@query(f"WITH {FLAGS} SELECT flag, edition, count(*) AS n FROM flags GROUP BY 1, 2")
def a36_flag_counts(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).groupBy("flag", "edition").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (trim(coalesce(dbid, '')) = '') AS no_work_number, count(*) FILTER (title_he IS NULL) AS no_title, count(*) AS editions FROM (SELECT DISTINCT edition_no, dbid, title_he FROM edition_metadata)")
def proj_p16_missing_values(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edition_metadata").select("edition_no", "dbid", "title_he").distinct()
    return e.agg(F.count_if(F.trim(F.coalesce("dbid", F.lit(""))) == "").alias("no_work_number"), F.count_if(F.col("title_he").isNull()).alias("no_title"), F.count("*").alias("editions"))


@query("SELECT story_id, tag, verdict FROM (SELECT DISTINCT story_id, tag, verdict FROM quality_results) WHERE verdict NOT IN ('', 'ERROR')")
def proj_p17_without_errors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "quality_results").select("story_id", "tag", "verdict").distinct().where(~F.col("verdict").isin("", "ERROR"))


@query(f"WITH {ITEMS} SELECT DISTINCT tag FROM items WHERE category IN ('speech', 'dreams', 'wonders') AND tag NOT IN (SELECT tag FROM human_labels WHERE NOT contains(tag, '_'))")
def proj_p18_weak_definitions(spark: SparkSession, d: str) -> DataFrame:
    curated = table(spark, d, "human_labels").where("not contains(tag, '_')").select("tag").distinct()
    return _answers(spark, d).where(F.col("category").isin("speech", "dreams", "wonders")).select("tag").distinct().join(curated, "tag", "left_anti")


@query("WITH v AS (SELECT DISTINCT label_id, tag, CASE WHEN label_id % 3 = 0 THEN substr(md5(tag), 1, 8) ELSE 'outdated' END AS prompt_hash FROM human_labels) SELECT label_id, tag, prompt_hash FROM v SEMI JOIN (SELECT DISTINCT tag, substr(md5(tag), 1, 8) AS prompt_hash FROM quality_results) USING (tag, prompt_hash)")
def proj_p19_f35_current_hash(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "human_labels").select("label_id", "tag").distinct().withColumn("prompt_hash", F.when(F.col("label_id") % 3 == 0, X.short_hash(F.col("tag"))).otherwise("outdated"))
    return R.at_current_hash(v, table(spark, d, "quality_results").select("tag", X.short_hash(F.col("tag")).alias("prompt_hash")), "tag", "prompt_hash").select("label_id", "tag", "prompt_hash")


@query("SELECT row_id, name_heb FROM (SELECT DISTINCT row_id, name_heb FROM auto_linked) WHERE trim(name_heb) <> '' AND name_heb NOT IN ('גשר', 'נהר', 'מפתח')")
def proj_p20_skip_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "auto_linked").select("row_id", "name_heb").distinct().where((F.trim("name_heb") != "") & ~F.col("name_heb").isin("גשר", "נהר", "מפתח"))


@query("SELECT list_name, count(*) FILTER (lat IS NULL) AS without_place, count(*) FILTER (kima IS NOT NULL) AS decided, count(*) AS n FROM (SELECT DISTINCT csv_row, list_name, lat, kima FROM place_csv) GROUP BY 1")
def proj_p22_overview(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "place_csv").select("csv_row", "list_name", "lat", "kima").distinct()
    return p.groupBy("list_name").agg(F.count_if(F.col("lat").isNull()).alias("without_place"), F.count_if(F.col("kima").isNotNull()).alias("decided"), F.count("*").alias("n"))


# --- sources as tables -------------------------------------------------------------------------------------------


@query("SELECT edition_no, CAST(n AS BIGINT) AS number FROM (SELECT edition_no, unnest(regexp_extract_all(dbid, '[0-9]+')) AS n FROM (SELECT DISTINCT edition_no, dbid FROM edition_metadata)) WHERE length(n) > 1")
def s16_j28_bibliography_index(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edition_metadata").select("edition_no", "dbid").distinct()
    return e.select("edition_no", F.explode(F.regexp_extract_all("dbid", F.lit("[0-9]+"), F.lit(0))).alias("n")).where("length(n) > 1").select("edition_no", F.col("n").cast("bigint").alias("number"))


@query("SELECT variant, arg_min(xml_id, (o, xml_id)) AS entity FROM (SELECT xml_id, unnest(names) AS variant, generate_subscripts(names, 1) AS o FROM (SELECT DISTINCT xml_id, names FROM place_xml)) WHERE trim(variant) <> '' GROUP BY 1")
def s10_variant_index(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "place_xml").select("xml_id", "names").distinct().select("xml_id", F.posexplode("names").alias("o", "variant")).where("trim(variant) <> ''")
    return v.groupBy("variant").agg(F.min_by("xml_id", F.struct("o", "xml_id")).alias("entity"))


@query("SELECT xml_id, array_to_string(list_sort(list_filter(names, lambda n: regexp_matches(n, '[א-ת]'))), ';') AS names_he, array_to_string(list_sort(list_filter(names, lambda n: NOT regexp_matches(n, '[א-ת]'))), ';') AS names_en FROM (SELECT DISTINCT xml_id, list_filter(names, lambda n: trim(n) <> '') AS names FROM place_xml)")
def s12_f10_names_by_script(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "place_xml").select("xml_id", F.filter("names", lambda n: F.trim(n) != "").alias("names")).distinct()
    side = lambda c: F.array_join(F.sort_array(F.filter("names", c)), ";")
    return p.select("xml_id", side(lambda n: X.script(n) == "he").alias("names_he"), side(lambda n: X.script(n) == "en").alias("names_en"))


@query("SELECT kima_id, primary_heb_full, primary_rom_full FROM gazetteer SEMI JOIN (SELECT DISTINCT kima_id FROM auto_confirmed) USING (kima_id)")
def s18_s26_gazetteer_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gazetteer").join(table(spark, d, "auto_confirmed").select("kima_id").distinct(), "kima_id", "left_semi").select("kima_id", "primary_heb_full", "primary_rom_full")


@query(f"SELECT story, twin, max(sim) AS sim FROM (SELECT a AS story, b AS twin, sim FROM {PAIRS} UNION ALL SELECT b, a, sim FROM {PAIRS}) WHERE sim >= 0.98 AND story <> twin GROUP BY 1, 2")
def s21_s22_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return L.symmetric(_pairs(spark, d).where("sim >= 0.98 and a <> b"))


@query("SELECT xml_id, CAST(regexp_extract(xml_id, '(\\d+)$', 1) AS INT) AS number, regexp_extract(xml_id, '^([A-Za-z-]+)_', 1) AS family FROM (SELECT DISTINCT xml_id FROM place_xml)")
def s14_id_families(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "place_xml").select("xml_id").distinct().select("xml_id", X.id_suffix_number(F.col("xml_id")).alias("number"), F.regexp_extract("xml_id", "^([A-Za-z-]+)_", 1).alias("family"))


@query("SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 0 ELSE len(list_filter(string_split(regexp_replace(text, '[ \\n\\t\\r]+', ' ', 'g'), ' '), lambda w: w <> '')) END AS n_words, CASE WHEN lang = 'he' THEN 'he' ELSE 'other' END AS category FROM documents")
def s08_s09_word_counts(spark: SparkSession, d: str) -> DataFrame:
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \n\t\r]+"), lambda w: w != ""))
    return table(spark, d, "documents").select("doc_id", F.when(F.trim(F.coalesce("text", F.lit(""))) == "", 0).otherwise(words).alias("n_words"), F.when(F.col("lang") == "he", "he").otherwise("other").alias("category"))


# --- links and authority -----------------------------------------------------------------------------------------

PLACE_NAMES = r"gaz AS (SELECT trim(regexp_replace(primary_heb_full, '\s*\([^)]*\)\s*$', '')) AS variant, min(kima_id) AS entity FROM gazetteer GROUP BY 1)"
MENTIONS = "mentions AS (SELECT DISTINCT row_id AS mention_id, name_heb AS name, kima_id AS ref FROM auto_confirmed WHERE trim(name_heb) <> '')"


def _gazetteer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gazetteer").groupBy(F.trim(F.regexp_replace("primary_heb_full", r"\s*\([^)]*\)\s*$", "")).alias("variant")).agg(F.min("kima_id").alias("entity"))


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "auto_confirmed").where("trim(name_heb) <> ''").select(F.col("row_id").alias("mention_id"), F.col("name_heb").alias("name"), F.col("kima_id").alias("ref")).distinct()


@query(f"WITH {PLACE_NAMES}, {MENTIONS} SELECT name, entity, count(*) AS n, min(mention_id) AS first_mention FROM mentions LEFT JOIN gaz ON gaz.variant = mentions.name GROUP BY 1, 2")
def j06_variant_lookup(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d).groupBy("name").agg(F.count("*").alias("n"), F.min("mention_id").alias("first_mention"))
    return m.join(_gazetteer(spark, d).withColumnRenamed("variant", "name"), "name", "left").select("name", "entity", "n", "first_mention")


@query(f"WITH {PLACE_NAMES}, {MENTIONS} SELECT mention_id, coalesce(ref::VARCHAR, entity::VARCHAR, 'ED::' || name) AS key, CASE WHEN ref IS NOT NULL THEN 'ref' WHEN entity IS NOT NULL THEN 'variant' ELSE 'edition_only' END AS kind FROM mentions LEFT JOIN gaz ON gaz.variant = mentions.name")
def j08_mention_resolution(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d).withColumn("ref", F.col("ref").cast("string"))
    return R.resolved_mentions(m, _gazetteer(spark, d).withColumn("entity", F.col("entity").cast("string")), "name", "ref").select("mention_id", "key", "kind")


@query(rf"WITH {PLACE_NAMES}, {MENTIONS}, own AS (SELECT row_id AS mention_id, max(kima_id) + (max(occurrences) = 1)::INT AS target FROM auto_confirmed WHERE match_method = 'wikidata' AND kima_id IS NOT NULL GROUP BY 1), j AS (SELECT m.*, coalesce(own.target, g1.entity, g2.entity) AS target FROM mentions m LEFT JOIN own USING (mention_id) LEFT JOIN gaz g1 ON g1.variant = m.name LEFT JOIN gaz g2 ON g2.variant = CASE WHEN length(m.name) > 2 AND substr(m.name, 1, 1) IN ('ב','ל','מ','ה','ו','כ','ש') AND regexp_matches(substr(m.name, 2, 1), '[א-ת]') THEN substr(m.name, 2) ELSE m.name END) SELECT mention_id, name, ref, target, CASE WHEN target IS NULL THEN 'none' WHEN ref IS NULL THEN 'write' WHEN ref = target THEN 'noop' ELSE 'conflict' END AS action FROM j")
def j07_j09_apply_links(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d)
    own = table(spark, d, "auto_confirmed").where("match_method = 'wikidata' and kima_id is not null").groupBy(F.col("row_id").alias("mention_id")).agg((F.max("kima_id") + (F.max("occurrences") == 1).cast("int")).alias("target"))
    return R.applied_links(m, own, _gazetteer(spark, d).select(F.col("variant").alias("name"), F.col("entity").alias("target")), "name", X.hebrew_prefix(F.col("name"))["bare"])


@query("WITH a AS (SELECT DISTINCT name_heb AS name, kima_id AS target FROM auto_confirmed WHERE match_method = 'wikidata' AND kima_id IS NOT NULL AND name_heb IS NOT NULL), b AS (SELECT DISTINCT name_heb, kima_id FROM auto_confirmed WHERE kima_id IS NOT NULL AND name_heb IS NOT NULL), c AS (SELECT primary_heb_full, kima_id FROM gazetteer) SELECT name, target, min(s) AS source_no FROM (SELECT *, 1 AS s FROM a UNION ALL SELECT *, 2 FROM b UNION ALL SELECT *, 3 FROM c) GROUP BY 1, 2")
def j11_first_of_sources(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "auto_confirmed").where("kima_id is not null and name_heb is not null")
    c = table(spark, d, "gazetteer").select(F.col("primary_heb_full").alias("name"), F.col("kima_id").alias("target"))
    named = lambda t: t.select(F.col("name_heb").alias("name"), F.col("kima_id").alias("target"))
    return R.first_of_sources([named(b.where("match_method = 'wikidata'")), named(b), c], ["name", "target"])


@query("SELECT row_id, CASE WHEN name_heb IN ('גשר', 'נהר') THEN 'skip' WHEN kima_id IS NULL THEN '' WHEN NOT (match_method = 'name_exact' OR confidence >= 0.9) THEN '' WHEN g.entity IS NOT NULL THEN 'map_to:' || g.entity ELSE 'new' END AS action FROM (SELECT DISTINCT row_id, name_heb, kima_id, coalesce(match_method, '') AS match_method, coalesce(confidence, 0) AS confidence FROM auto_confirmed) LEFT JOIN (SELECT kima_id, 'H-' || kima_id AS entity FROM gazetteer WHERE contains(primary_rom_full, 'Milgard')) g USING (kima_id)")
def j12_determine_action(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "auto_confirmed").select("row_id", "name_heb", "kima_id", F.coalesce("match_method", F.lit("")).alias("match_method"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")).distinct()
    g = table(spark, d, "gazetteer").where("contains(primary_rom_full, 'Milgard')").select("kima_id", F.concat(F.lit("H-"), F.col("kima_id").cast("string")).alias("entity"))
    sure = (F.col("match_method") == "name_exact") | (F.col("confidence") >= 0.9)
    action = F.when(F.col("name_heb").isin("גשר", "נהר"), "skip").when(F.col("kima_id").isNull() | ~sure, "").when(F.col("entity").isNotNull(), F.concat(F.lit("map_to:"), "entity")).otherwise("new")
    return t.join(g, "kima_id", "left").select("row_id", action.alias("action"))


@query("WITH v AS (SELECT vec_id // 5 AS story, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT story, d, avg(x) AS m FROM v GROUP BY 1, 2), u AS (SELECT story, list(m / n ORDER BY d) AS e FROM c JOIN (SELECT story, sqrt(sum(m * m)) AS n FROM c GROUP BY 1) USING (story) GROUP BY 1) SELECT a.story AS a, b.story AS b, round(list_inner_product(a.e, b.e), 4) AS sim FROM u a JOIN u b ON a.story < b.story WHERE list_inner_product(a.e, b.e) >= 0.3")
def j19_a34_story_mean_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = L.centroids(table(spark, d, "embeddings").withColumn("story", F.floor(F.col("vec_id") / 5)), "story", "embedding")
    return L.cosine_pairs(c, "story", "centroid", 0.3).withColumn("sim", F.round("sim", 4))


@query("SELECT csv_row, CAST(pos AS INT) AS pos, id FROM (SELECT csv_row, id, row_number() OVER (PARTITION BY csv_row ORDER BY o) - 1 AS pos FROM (SELECT csv_row, id, min(o) AS o FROM (SELECT csv_row, unnest(l) AS id, generate_subscripts(l, 1) AS o FROM (SELECT csv_row, list_concat([csv_row::VARCHAR], regexp_extract_all(coalesce(kima, ''), '[0-9]+')) AS l FROM (SELECT DISTINCT csv_row, kima FROM place_csv))) GROUP BY 1, 2))")
def j23_candidate_ids(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "place_csv").select("csv_row", "kima").distinct()
    ids = F.array_distinct(F.concat(F.array(F.col("csv_row").cast("string")), F.regexp_extract_all(F.coalesce("kima", F.lit("")), F.lit("[0-9]+"), F.lit(0))))
    return p.select("csv_row", F.posexplode(ids).alias("pos", "id"))


@query("WITH k AS (SELECT name_heb AS t, CASE WHEN row_id % 2 = 0 THEN 'GPE' ELSE 'LOC' END AS l, max(kima_id) AS r FROM auto_confirmed WHERE kima_id IS NOT NULL AND name_heb IS NOT NULL GROUP BY 1, 2), n AS (SELECT DISTINCT row_id, name_heb AS t, CASE WHEN row_id % 3 = 0 THEN 'GPE' WHEN row_id % 3 = 1 THEN 'LOC' ELSE 'PER' END AS l FROM auto_linked WHERE name_heb IS NOT NULL) SELECT n.row_id, n.t AS text, n.l AS label, coalesce(a.r, b.r) AS ref FROM n LEFT JOIN k a ON a.t = n.t AND a.l = n.l LEFT JOIN k b ON b.t = n.t AND b.l = CASE n.l WHEN 'GPE' THEN 'LOC' WHEN 'LOC' THEN 'GPE' END")
def j25_preserved_refs(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "auto_confirmed").where("kima_id is not null and name_heb is not null").select(F.col("name_heb").alias("text"), F.when(F.col("row_id") % 2 == 0, "GPE").otherwise("LOC").alias("label"), F.col("kima_id").alias("ref"))
    rows = table(spark, d, "auto_linked").where("name_heb is not null").select("row_id", F.col("name_heb").alias("text"), F.when(F.col("row_id") % 3 == 0, "GPE").when(F.col("row_id") % 3 == 1, "LOC").otherwise("PER").alias("label")).distinct()
    return R.reference_labels(rows, known, "text", "label", {"GPE": "LOC", "LOC": "GPE"})


@query(f"WITH {ITEMS}, h AS (SELECT story_id, tag, annotator, bool_or({ANSWER.format('applies')}) AS human FROM human_labels GROUP BY 1, 2, 3) SELECT annotator, count(*) AS judged, count(*) FILTER (human = opus) AS agree, count(*) FILTER (human AND NOT opus) AS model_missed, count(*) FILTER (opus AND NOT human) AS model_added FROM h JOIN items USING (story_id, tag) WHERE human IS NOT NULL AND opus IS NOT NULL GROUP BY 1")
def j27_a24_human_against_model(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "human_labels").groupBy("story_id", "tag", "annotator").agg(F.bool_or(X.tri_state(F.col("applies"))).alias("human"))
    j = h.join(_answers(spark, d), ["story_id", "tag"]).where("human is not null and opus is not null")
    return j.groupBy("annotator").agg(F.count("*").alias("judged"), F.count_if(F.col("human") == F.col("opus")).alias("agree"), F.count_if(F.col("human") & ~F.col("opus")).alias("model_missed"), F.count_if(F.col("opus") & ~F.col("human")).alias("model_added"))


RULE_TAGS = "SELECT DISTINCT tag FROM quality_results WHERE tag IS NOT NULL"


@query(f"WITH t AS ({RULE_TAGS}) SELECT tag AS old, CASE WHEN tag LIKE '%a%' AND tag LIKE 's%' THEN 'tax:' || tag WHEN tag LIKE '%a%' THEN 'tax:' || tag ELSE upper(tag) END AS new FROM t WHERE tag LIKE '%a%' OR tag LIKE 's%'")
def j29_merged_rules(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "quality_results").where("tag is not null").select(F.col("tag").alias("old")).distinct()
    return R.merged_rules(t.where("old like 's%'").withColumn("new", F.upper("old")), t.where("old like '%a%'").withColumn("new", F.concat(F.lit("tax:"), "old")))


@query("SELECT DISTINCT p.xml_id, v.variant FROM (SELECT DISTINCT xml_id, names FROM place_xml) p, (SELECT DISTINCT unnest(names) AS variant FROM place_csv) v WHERE list_contains(p.names, v.variant) AND trim(v.variant) <> ''")
def j30_known_variants(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "place_xml").select("xml_id", F.explode("names").alias("variant")).distinct()
    return held.join(table(spark, d, "place_csv").select(F.explode("names").alias("variant")).distinct(), "variant", "left_semi").where("trim(variant) <> ''").select("xml_id", "variant")


@query(f"WITH {ITEMS} SELECT story_id, tag, CASE WHEN opus IS NULL THEN 'pending' WHEN opus = sonnet THEN 'match' ELSE 'mismatch' END AS status FROM items WHERE sonnet IS NOT NULL")
def j31_l05_evaluate_view(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d)
    return R.status_of(a.where("sonnet is not null").select("story_id", "tag", "sonnet"), a.where("opus is not null").select("story_id", "tag", "opus"), ["story_id", "tag"], "sonnet", "opus").select("story_id", "tag", "status")


@query("WITH n AS (SELECT DISTINCT ps_name, row_number() OVER (ORDER BY ps_name) AS n FROM (SELECT DISTINCT s_name AS ps_name FROM supplier)), used AS (SELECT DISTINCT p_partkey AS id FROM part WHERE p_size > 25), free AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM (SELECT range AS id FROM range(1, (SELECT (SELECT count(*) FROM n) + (SELECT count(*) FROM used) + 1))) WHERE id NOT IN (SELECT id FROM used)) SELECT ps_name AS s_name, 'H-LOC_' || id AS new_id FROM n JOIN free USING (n)")
def j17_free_ids(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "part").where("p_size > 25").select(F.concat(F.lit("H-LOC_"), F.col("p_partkey").cast("string")).alias("id"))
    return O.mint_free_ids(table(spark, d, "supplier").select("s_name").distinct(), "s_name", used, "id", "H-LOC_")


@query("SELECT s_suppkey, array_to_string(CASE WHEN s_acctbal > 5000 THEN [s_name, 'Alt ' || s_suppkey] ELSE [s_name] END, ';') AS names, CASE WHEN s_nationkey > 12 THEN s_nationkey::VARCHAR WHEN s_acctbal > 5000 THEN 'x' || s_nationkey ELSE NULL END AS code FROM supplier")
def j15_j16_m08_enrichment(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").withColumn("n", F.col("s_nationkey").cast("string"))
    base = s.select("s_suppkey", F.array("s_name").alias("names"), F.when(F.col("s_nationkey") > 12, F.col("n")).otherwise("").alias("code"))
    extra = s.where("s_acctbal > 5000").select("s_suppkey", F.array("s_name", F.concat(F.lit("Alt "), F.col("s_suppkey").cast("string"))).alias("names"), F.concat(F.lit("x"), "n").alias("code"))
    return L.merge_fields(base, extra, "s_suppkey", ["names"], [], ["code"]).withColumn("names", F.array_join("names", ";"))


@query("SELECT doc_id AS mention_id, CASE WHEN contains(text, 'מפתח') THEN 't1' ELSE 't2' END AS target, CAST(CASE WHEN contains(text, 'מפתח') THEN 1 ELSE 2 END AS INT) AS rule_no FROM documents WHERE (edition LIKE '%a%' AND contains(text, 'מפתח')) OR (edition LIKE 'S%' AND contains(text, 'נהר') AND NOT (edition LIKE '%a%' AND contains(text, 'מפתח')))")
def j24_context_rules(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").select(F.col("doc_id").alias("mention_id"), F.col("edition").alias("name"), F.col("text").alias("context"), F.lit(None).cast("string").alias("decision"))
    rules = spark.createDataFrame([(1, "a", "מפתח", "t1"), (2, "^S", "נהר", "t2")], "rule_no int, name_pattern string, cue string, target string")
    return L.context_rules(m, rules)


GEO = """WITH l AS (SELECT n_nationkey AS key, n_name AS name, n_nationkey * 1.5 AS lat, n_nationkey * 2.0 AS lon FROM nation), r AS (SELECT n_nationkey AS key, n_name || CASE WHEN n_nationkey % 3 = 0 THEN '' WHEN n_nationkey % 3 = 1 THEN 'a' ELSE ' (old town of it)' END AS name, CASE WHEN n_nationkey % 7 <> 6 THEN n_nationkey * 1.5 + (n_nationkey % 5) * 0.3 END AS lat, n_nationkey * 2.0 AS lon FROM nation), g AS (SELECT l.key AS l, r.key AS r, lower(l.name) AS a, lower(r.name) AS b, l.lat AS y1, l.lon AS x1, r.lat AS y2, r.lon AS x2 FROM l, r), s AS (SELECT l, r, CASE WHEN a = b THEN 1.0 ELSE len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb)))::DOUBLE END AS sim, 6371.0 * 2 * atan2(sqrt(h), sqrt(1 - h)) AS km FROM (SELECT *, list_distinct(list_transform(range(1, length(a) - 1), lambda i: substr(a, i, 3))) AS ga, list_distinct(list_transform(range(1, length(b) - 1), lambda i: substr(b, i, 3))) AS gb, pow(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * pow(sin(radians(x2 - x1) / 2), 2) AS h FROM g)), c AS (SELECT *, CASE WHEN km IS NULL THEN CASE WHEN sim >= 0.55 THEN sim END WHEN km <= 5 THEN CASE WHEN sim >= 0.35 THEN least(1.0, sim + 0.3) END WHEN sim < 0.55 THEN NULL WHEN km <= 30 THEN least(1.0, sim + 0.15) WHEN km <= 100 THEN sim ELSE greatest(0.0, sim - 0.15) END AS score FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY score DESC, r) AS n FROM c WHERE score IS NOT NULL)"""


@query(GEO + " SELECT l.key AS l, r, round(score, 6) AS score, round(km, 6) AS km, CASE WHEN score >= 0.8 THEN 'MATCHED' WHEN score IS NOT NULL THEN 'CONFLICT' ELSE 'NEW' END AS status FROM l LEFT JOIN (SELECT * FROM b WHERE n = 1) b ON b.l = l.key")
def j02_f02_m02_geo_bands(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    key, third = F.col("n_nationkey"), F.col("n_nationkey") % 3
    left = n.select(key.alias("key"), F.col("n_name").alias("name"), (key * 1.5).alias("lat"), (key * 2.0).alias("lon"))
    right = n.select(key.alias("key"), F.concat("n_name", F.when(third == 0, "").when(third == 1, "a").otherwise(" (old town of it)")).alias("name"), F.when(key % 7 != 6, key * 1.5 + (key % 5) * 0.3).alias("lat"), (key * 2.0).alias("lon"))
    return L.name_geo_match(left, right)


# --- aggregations ------------------------------------------------------------------------------------------------


@query(f"WITH {ITEMS} SELECT DISTINCT split_part(tag, ':', 1) AS category FROM (SELECT tag FROM items WHERE opus AND contains(tag, ':') GROUP BY 1 HAVING count(*) >= 8)")
def a07_eligible_categories(spark: SparkSession, d: str) -> DataFrame:
    return R.eligible_prefixes(_answers(spark, d).where("opus"), "tag", 8)


@query("WITH t AS (SELECT o_custkey % 40 AS topic, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS \"n_F\", count(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS \"n_O\", count(DISTINCT CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) AS \"n_P\", count(DISTINCT o_orderkey) AS total, count(DISTINCT CASE WHEN o_orderstatus IN ('F', 'P') THEN o_orderkey END) AS s FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1 HAVING count(DISTINCT o_orderkey) >= 6), r AS (SELECT *, round(s / total, 6) AS share FROM t) SELECT topic, \"n_F\", \"n_O\", \"n_P\", total, share FROM (SELECT *, row_number() OVER (ORDER BY share, topic) AS l, row_number() OVER (ORDER BY share DESC, topic DESC) AS h FROM r) WHERE l <= 9 OR h <= 9")
def a09_w07_agency_by_topic(spark: SparkSession, d: str) -> DataFrame:
    return R.composition(table(spark, d, "orders").withColumn("topic", F.col("o_custkey") % 40), "topic", "o_orderkey", "o_orderstatus", ["F", "O", "P"], ["F", "P"], 6, 9)


@query("SELECT o_totalprice > 100000 AS flagged, o_orderpriority AS tier, count(DISTINCT o_orderkey) AS n, round_even(100.0 * count(DISTINCT o_orderkey) / sum(count(DISTINCT o_orderkey)) OVER (PARTITION BY o_totalprice > 100000), 1) AS pct FROM orders GROUP BY 1, 2")
def a12_two_groups(spark: SparkSession, d: str) -> DataFrame:
    return R.two_groups(table(spark, d, "orders"), F.col("o_totalprice") > 100000, "o_orderpriority", "o_orderkey")


@query("WITH u AS (SELECT name_heb AS t, kind FROM auto_confirmed UNION ALL SELECT name_heb, 'linked' FROM auto_linked) SELECT norm, kind, count(*) AS n, arg_max(t, (length(t), t)) AS display FROM (SELECT *, trim(regexp_replace(t, '[׳״\"'']', '', 'g')) AS norm FROM u) WHERE norm <> '' GROUP BY 1, 2")
def a17_f04_grouped_occurrences(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "auto_confirmed").select("name_heb", "kind")
    b = table(spark, d, "auto_linked").select("name_heb", F.lit("linked").alias("kind"))
    return R.grouped_occurrences([a, b], "name_heb", "kind", X.group_key(F.col("name_heb")))


@query("SELECT count(*) FILTER (wikidata IS NOT NULL) AS wikidata, count(*) FILTER (tsadikim IS NOT NULL) AS tsadikim, count(*) FILTER (jewishgen IS NOT NULL) AS jewishgen, CAST(sum(len(names)) AS BIGINT) AS name_variants, count(*) AS places FROM (SELECT DISTINCT xml_id, names, wikidata, tsadikim, jewishgen FROM place_xml)")
def a19_identifier_coverage(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "place_xml").select("xml_id", "names", "wikidata", "tsadikim", "jewishgen").distinct()
    return p.agg(*[F.count(c).alias(c) for c in ("wikidata", "tsadikim", "jewishgen")], F.sum(F.size("names")).alias("name_variants"), F.count("*").alias("places"))


@query("SELECT kima_id, count(DISTINCT name_heb) AS variants, string_agg(DISTINCT match_method, ';' ORDER BY match_method) AS methods FROM auto_confirmed WHERE kima_id IS NOT NULL AND trim(name_heb) <> '' GROUP BY 1")
def a21_donations(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "auto_confirmed").where("kima_id is not null and trim(name_heb) <> ''")
    return t.groupBy("kima_id").agg(F.countDistinct("name_heb").alias("variants"), F.nullif(F.array_join(F.sort_array(F.collect_set("match_method")), ";"), F.lit("")).alias("methods"))


@query(f"WITH {ITEMS} SELECT category, old_n, old_true, new_n, new_true, flips, round(100.0 * new_true / nullif(new_n, 0) - 100.0 * old_true / nullif(old_n, 0), 4) AS change FROM (SELECT category, count(sonnet) AS old_n, count(*) FILTER (sonnet) AS old_true, count(opus) AS new_n, count(*) FILTER (opus) AS new_true, count(*) FILTER (sonnet <> opus) AS flips FROM items GROUP BY 1)")
def a25_run_comparison(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d)
    one = lambda c: a.select("story_id", "tag", F.col(c).alias("applies"))
    return R.run_comparison(one("sonnet"), one("opus"), ["story_id", "tag"], F.substring_index("tag", ":", 1))


@query(f"WITH {ITEMS} SELECT tag, count(*) FILTER (NOT opus) AS rejected, count(*) AS judged, round_even(100.0 * count(*) FILTER (NOT opus) / count(*), 1) AS pct FROM items WHERE opus IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (NOT opus) >= 3 ORDER BY rejected DESC, tag LIMIT 20")
def a26_t03_worst_tags(spark: SparkSession, d: str) -> DataFrame:
    return R.worst(_answers(spark, d), "tag", "opus")


@query(f"WITH {ITEMS} SELECT category, string_agg(DISTINCT story_id, ';' ORDER BY story_id) AS stories FROM items WHERE opus GROUP BY 1")
def a29_story_lists(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).where("opus").groupBy("category").agg(F.array_join(F.sort_array(F.collect_set("story_id")), ";").alias("stories"))


@query("WITH s AS (SELECT vec_id // 10 AS story, vec_id % 10 AS chunk_offset, round(embedding[1]::DOUBLE, 6) AS sim FROM embeddings) SELECT story, max(sim) AS sim, arg_max(chunk_offset, (sim, -chunk_offset)) AS chunk_offset FROM s GROUP BY 1")
def a35_max_pooled(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("story"), (F.col("vec_id") % 10).alias("chunk_offset"), F.round(F.col("embedding")[0].cast("double"), 6).alias("sim"))
    return R.max_pooled(e, "story", "chunk_offset", "sim")


@query(f"WITH {ITEMS}, c AS (SELECT edition, category, CASE WHEN opus THEN 'insert' WHEN NOT opus THEN 'remove' END AS action FROM items) SELECT edition, category, count(*) FILTER (action = 'insert') AS inserted, count(*) FILTER (action = 'remove') AS removed, count(*) FILTER (action = 'insert') - count(*) FILTER (action = 'remove') AS net FROM c GROUP BY 1, 2")
def a37_account(spark: SparkSession, d: str) -> DataFrame:
    return R.account(_answers(spark, d).withColumn("action", F.when(F.col("opus"), "insert").when(~F.col("opus"), "remove")), "edition", "category")


@query("SELECT source_edition AS edition, count(*) AS units, count(*) FILTER (person_id IS NOT NULL) AS linked, count(*) FILTER (person_id IS NULL) AS unlinked FROM (SELECT DISTINCT review_id, source_edition, person_id FROM fuzzy_review) GROUP BY 1")
def a39_s11_unit_report(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fuzzy_review").select("review_id", "source_edition", "person_id").distinct()
    return f.groupBy(F.col("source_edition").alias("edition")).agg(F.count("*").alias("units"), F.count("person_id").alias("linked"), F.count_if(F.col("person_id").isNull()).alias("unlinked"))


@query(f"WITH {ITEMS} SELECT coalesce(sonnet::VARCHAR, 'open') AS old, coalesce(opus::VARCHAR, 'open') AS new, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM items GROUP BY 1, 2")
def a40_cross_table(spark: SparkSession, d: str) -> DataFrame:
    c = _answers(spark, d).groupBy(F.coalesce(F.col("sonnet").cast("string"), F.lit("open")).alias("old"), F.coalesce(F.col("opus").cast("string"), F.lit("open")).alias("new")).agg(F.count("*").alias("n"))
    return c.withColumn("pct", N.share(F.col("n"), F.sum("n").over(Window.partitionBy())))


@query("SELECT p_name AS word, p_size AS stored, round_even(CAST(p_retailprice / 7 AS DOUBLE), 2) AS ratio FROM part ORDER BY p_partkey LIMIT 60")
def a41_m06_keyword_exhibit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").orderBy("p_partkey").limit(60).select(F.col("p_name").alias("word"), F.col("p_size").alias("stored"), F.bround(F.col("p_retailprice").cast("double") / 7, 2).alias("ratio"))


# --- order -------------------------------------------------------------------------------------------------------

RISK = r"""CASE WHEN regexp_matches(coalesce(r, ''), 'Milgard') THEN 'HIGH' WHEN h IN ('גשר', 'נהר') THEN 'HIGH' WHEN contains(m, 'wikidata') THEN 'LOW' WHEN h <> '' AND length(regexp_replace(h, '[^א-ת]', '', 'g')) <= 4 THEN 'HIGH' WHEN h = '' AND contains(m, 'name_exact') THEN 'LOW' ELSE 'MED' END"""


@query(f"WITH t AS (SELECT DISTINCT row_id, trim(coalesce(name_heb, '')) AS h, lower(coalesce(match_method, '')) AS m, occurrences, primary_rom_full AS r FROM auto_confirmed LEFT JOIN gazetteer USING (kima_id)), s AS (SELECT *, {RISK} AS risk FROM t) SELECT row_id, risk, row_number() OVER (ORDER BY CASE risk WHEN 'HIGH' THEN 0 WHEN 'MED' THEN 1 ELSE 2 END, occurrences DESC NULLS LAST, row_id) AS n FROM s")
def w06_f29_risk_sheet(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "auto_confirmed").join(table(spark, d, "gazetteer"), "kima_id", "left").select("row_id", "occurrences", X.risk(F.col("name_heb"), F.col("match_method"), F.col("primary_rom_full"), ["Milgard"], ["גשר", "נהר"])["risk"].alias("risk")).distinct()
    order = F.when(F.col("risk") == "HIGH", 0).when(F.col("risk") == "MED", 1).otherwise(2)
    return O.numbered(t, order, F.col("occurrences").desc_nulls_last(), "row_id").select("row_id", "risk", "n")


@query("SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM events")
def w08_cumulative_sum(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("user_id", "event_id", F.round(F.sum("value").over(w), 4).alias("total"))


@query(f"WITH {ITEMS} SELECT story_id, tag, row_number() OVER (PARTITION BY category ORDER BY coalesce(opus, false) DESC, length(tag) DESC, tag, story_id) AS n FROM items")
def t04_l09_report_order(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("category").orderBy(F.coalesce("opus", F.lit(False)).desc(), F.length("tag").desc(), "tag", "story_id")
    return _answers(spark, d).select("story_id", "tag", F.row_number().over(w).alias("n"))


@query(f"SELECT a, b, sim FROM {PAIRS} WHERE sim IS NOT NULL ORDER BY md5('0:' || a || '|' || b || '|' || edition_a || edition_b || sim::VARCHAR), a, b LIMIT 50")
def t06_sampled_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).where("sim is not null")
    return p.orderBy(F.md5(F.concat(F.lit("0:"), "a", F.lit("|"), "b", F.lit("|"), "edition_a", "edition_b", F.col("sim").cast("string"))), "a", "b").limit(50).select("a", "b", "sim")


@query("SELECT source_edition AS edition, coalesce(print_year, 9999) AS year, count(*) AS n, CAST(dense_rank() OVER (ORDER BY coalesce(print_year, 9999), source_edition) AS INT) AS place FROM (SELECT DISTINCT review_id, source_edition FROM fuzzy_review WHERE source_edition IS NOT NULL) LEFT JOIN edition_list ON edition = source_edition GROUP BY 1, 2")
def t07_a02_editions_by_year(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fuzzy_review").where("source_edition is not null").select("review_id", F.col("source_edition").alias("edition")).distinct().groupBy("edition").agg(F.count("*").alias("n"))
    j = f.join(table(spark, d, "edition_list"), "edition", "left").withColumn("year", F.coalesce("print_year", F.lit(9999)))
    return j.withColumn("place", F.row_number().over(Window.orderBy("year", "edition"))).select("edition", "year", "n", "place")


@query("""WITH RECURSIVE s AS (SELECT l_orderkey, CAST(l_linenumber * 3 AS BIGINT) AS a, CAST(l_linenumber * 3 + CAST(floor(l_quantity) AS INT) % 7 + 1 AS BIGINT) AS b FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY a, b DESC) AS n FROM s), k AS (SELECT l_orderkey, n, a, b, true AS kept, b AS last FROM r WHERE n = 1 UNION ALL SELECT r.l_orderkey, r.n, r.a, r.b, r.a >= k.last, CASE WHEN r.a >= k.last THEN r.b ELSE k.last END FROM k JOIN r ON r.l_orderkey = k.l_orderkey AND r.n = k.n + 1) SELECT l_orderkey, a AS "start", b AS "end" FROM k WHERE kept""")
def w09_greedy_spans(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 3).cast("bigint").alias("start"), (F.col("l_linenumber") * 3 + F.floor("l_quantity").cast("int") % 7 + 1).cast("bigint").alias("end"))
    return O.greedy_spans(s, "l_orderkey", "start", "end")


# --- sets and graphs ---------------------------------------------------------------------------------------------


@query(f"""WITH {ITEMS}, old AS (SELECT story_id, tag, CASE WHEN length(story_id) % 2 = 0 THEN 'direct' ELSE 'propagated' END AS source, story_id AS source_story, category FROM items), yes AS (SELECT story_id, tag FROM items WHERE opus AND sonnet), no AS (SELECT story_id, tag FROM items WHERE NOT opus), asked AS (SELECT story_id, tag FROM items WHERE sonnet) SELECT story_id, tag, source, source_story, CASE WHEN source = 'direct' AND (story_id, tag) IN (SELECT * FROM no) THEN 'direct: rejected' WHEN source = 'direct' AND (story_id, tag) NOT IN (SELECT * FROM asked) THEN 'direct: no longer a candidate' WHEN source <> 'direct' AND (story_id, tag) IN (SELECT * FROM no) THEN 'propagated: source rejected' WHEN source <> 'direct' AND (story_id, tag) NOT IN (SELECT * FROM yes) AND (story_id, tag) NOT IN (SELECT * FROM asked) THEN 'propagated: source no longer confirmed' END AS r FROM old WHERE category IN ('speech', 'dreams', 'wonders', 'food', 'kin', 'music') AND (story_id, tag) NOT IN (SELECT * FROM yes) QUALIFY r IS NOT NULL""".replace(" AS r FROM old", " AS reason FROM old").replace("QUALIFY r IS NOT NULL", "AND CASE WHEN (story_id, tag) IN (SELECT * FROM no) THEN true ELSE (story_id, tag) NOT IN (SELECT * FROM asked) END"))
def u03_removals(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d)
    old = a.select("story_id", "tag", F.when(F.length("story_id") % 2 == 0, "direct").otherwise("propagated").alias("source"), F.col("story_id").alias("source_story"))
    pairs = lambda c: a.where(c).select("story_id", "tag")
    return S.removals(old, pairs("opus and sonnet"), pairs("not opus"), pairs("sonnet"), ["speech", "dreams", "wonders", "food", "kin", "music"])


@query("SELECT word, min(s) AS source_no FROM (SELECT DISTINCT name_heb AS word, 1 AS s FROM auto_confirmed WHERE kima_id IS NULL AND trim(name_heb) <> '' UNION ALL SELECT DISTINCT name_heb, 2 FROM auto_linked WHERE occurrences = 1 AND trim(name_heb) <> '') GROUP BY 1")
def u06_u09_stoplist_merge(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "auto_confirmed").where("kima_id is null and trim(name_heb) <> ''").select(F.col("name_heb").alias("word"))
    b = table(spark, d, "auto_linked").where("occurrences = 1 and trim(name_heb) <> ''").select(F.col("name_heb").alias("word"))
    return R.first_of_sources([a, b], ["word"])


DUPLICATES = """WITH RECURSIVE p AS (SELECT DISTINCT csv_row, lat, lon, lower(trim(names[1])) AS v1, trim(kima) AS v2 FROM place_csv), v AS (SELECT csv_row, 'n' || v1 AS v FROM p WHERE v1 <> '' UNION SELECT csv_row, 'k' || v2 FROM p WHERE v2 <> ''), e AS (SELECT DISTINCT a.csv_row AS x, b.csv_row AS y FROM v a JOIN v b USING (v)), r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y), c AS (SELECT x AS csv_row, min(y) AS canonical, count(DISTINCT y) AS members FROM r GROUP BY 1 HAVING count(DISTINCT y) > 1), f AS (SELECT a.canonical, max(6371.0 * 2 * atan2(sqrt(h), sqrt(1 - h))) AS km FROM (SELECT c1.canonical, pow(sin(radians(p2.lat - p1.lat) / 2), 2) + cos(radians(p1.lat)) * cos(radians(p2.lat)) * pow(sin(radians(p2.lon - p1.lon) / 2), 2) AS h FROM c c1 JOIN c c2 USING (canonical) JOIN p p1 ON p1.csv_row = c1.csv_row JOIN p p2 ON p2.csv_row = c2.csv_row) a GROUP BY 1)"""


def _groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "place_csv").select(F.col("csv_row").cast("string").alias("entity"), "names", "lat", "lon", F.trim("kima").alias("kima")).distinct()
    values = p.select("entity", F.lit("name").alias("kind"), F.lower(F.trim(F.get("names", F.lit(0)))).alias("value")).union(p.select("entity", F.lit("kima"), "kima"))
    return p, R.duplicate_groups(p, "entity", values, F.col("entity").cast("bigint"), "lat", "lon")


@query(DUPLICATES + " SELECT c.csv_row, c.canonical, c.members, coalesce(f.km > 50, false) AS far FROM c LEFT JOIN f USING (canonical)")
def g02_g01_duplicate_entities(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d)[1].select(F.col("entity").cast("bigint").alias("csv_row"), F.col("canonical").cast("bigint").alias("canonical"), "members", "far")


@query(DUPLICATES + ", g AS (SELECT c.* FROM c LEFT JOIN f USING (canonical) WHERE NOT coalesce(f.km > 50, false) AND members <= 3) SELECT m.csv_row, coalesce(g.canonical, m.csv_row) AS ref FROM (SELECT DISTINCT csv_row FROM match_results) m LEFT JOIN g USING (csv_row)")
def g03_g08_proj_p21_rewritten_refs(spark: SparkSession, d: str) -> DataFrame:
    p, groups = _groups(spark, d)
    skip = groups.where("members > 3").select("canonical").distinct()
    _, moves = R.merged_groups(groups, p, "entity", "names", skip)
    m = table(spark, d, "match_results").select("csv_row").distinct().withColumn("ref", F.col("csv_row").cast("string"))
    return R.rewritten_refs(m, "ref", moves).select("csv_row", F.col("ref").cast("bigint").alias("ref"))


@query(f"WITH {ROUTED}, one AS (SELECT *, CASE WHEN len(candidates) = 1 THEN candidates[1] END AS c FROM routed) SELECT review_id, c AS candidate, CASE WHEN c IN (SELECT c FROM one WHERE c IS NOT NULL AND status IN ('fuzzy', 'name_exact') AND confidence >= 0.6) THEN 'auto' ELSE 'manual' END AS bucket FROM one")
def g05_trusted_siblings(spark: SparkSession, d: str) -> DataFrame:
    return R.trusted_siblings(_routed(spark, d), "review_id", "status", "confidence", "candidates", 0.6)


@query("WITH m AS (SELECT label, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, d, avg(x) AS m FROM m GROUP BY 1, 2), u AS (SELECT label, list(m / n ORDER BY d) AS e FROM c JOIN (SELECT label, sqrt(sum(m * m)) AS n FROM c GROUP BY 1) USING (label) GROUP BY 1) SELECT a.label AS a, b.label AS b, round(list_inner_product(a.e, b.e), 6) AS sim FROM u a JOIN u b ON a.label < b.label")
def g06_m03_centroid_matrix(spark: SparkSession, d: str) -> DataFrame:
    return R.stacked_pairs(L.centroids(table(spark, d, "embeddings"), "label", "embedding"), "label", "centroid").withColumn("sim", F.round("sim", 6))


@query(f"WITH t AS ({RULE_TAGS}), x AS (SELECT tag, CASE WHEN tag LIKE 'speech:%' THEN [] WHEN tag LIKE 'dreams:%' THEN ['dreams', tag] WHEN tag LIKE 'food:%' THEN ['meals'] ELSE [tag] END AS y FROM t), {STORIES}, e AS (SELECT story_id, n, unnest(y) AS z, generate_subscripts(y, 1) AS k FROM (SELECT story_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS n FROM stories) JOIN x USING (tag)), f AS (SELECT story_id, z, min(n * 10 + k) AS o FROM e GROUP BY 1, 2) SELECT story_id, coalesce((SELECT string_agg(z, ';' ORDER BY o) FROM f WHERE f.story_id = s.story_id), '') AS tags FROM stories s")
def f30_f33_renamed_tags(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "quality_results").where("tag is not null").select("tag").distinct()
    action = F.when(F.col("tag").startswith("speech:"), "drop").when(F.col("tag").startswith("dreams:"), "split").when(F.col("tag").startswith("food:"), "rename")
    targets = F.when(F.col("tag").startswith("dreams:"), F.array(F.lit("dreams"), "tag")).otherwise(F.array(F.lit("meals")))
    rules = t.select("tag", action.alias("action"), targets.alias("targets")).where("action is not null")
    return R.renamed_tags(_stories(spark, d).select("story_id", "tags"), rules, "story_id", "tags").select("story_id", F.array_join("tags", ";").alias("tags"))


# --- functions ---------------------------------------------------------------------------------------------------


@query(r"""SELECT row_id, regexp_replace(regexp_replace(trim(regexp_replace(name_heb, '\s+', ' ', 'g')), '^[׳״"''., ]+', ''), '[׳״"''., ]+$', '') AS place_key, regexp_matches(name_heb, '[א-ת][״"][א-ת]') AS acronym, length(regexp_replace(name_heb, '[^א-ת]', '', 'g')) AS heb_len, CASE WHEN length(name_heb) > 2 AND substr(name_heb, 1, 1) IN ('ב','ל','מ','ה','ו','כ','ש') AND regexp_matches(substr(name_heb, 2, 1), '[א-ת]') THEN substr(name_heb, 2) ELSE name_heb END AS bare FROM (SELECT DISTINCT row_id, name_heb FROM auto_linked WHERE name_heb IS NOT NULL)""")
def f03_f10_f11_f12_hebrew_forms(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "auto_linked").where("name_heb is not null").select("row_id", "name_heb").distinct()
    c = F.col("name_heb")
    return n.select("row_id", X.place_key(c).alias("place_key"), X.is_acronym(c).alias("acronym"), X.hebrew_length(c).alias("heb_len"), X.hebrew_prefix(c)["bare"].alias("bare"))


TERM = "(^|[^֐-׿])[והבלמכשדיתנא]{0,3}%s[יהםותןךנ]{0,3}($|[^֐-׿])"


@query(f"SELECT doc_id, regexp_matches(text, '{TERM % 'נהר'}') AS river, regexp_matches(text, '{TERM % 'מלך'}') AS king, contains(text, 'א ב') AS phrase FROM documents WHERE text IS NOT NULL")
def f08_term_in_text(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", *[X.term_in_text(F.col("text"), F.lit(w)).alias(a) for w, a in (("נהר", "river"), ("מלך", "king"), ("א ב", "phrase"))])


@query("WITH l(tag, term, term_no, homograph) AS (VALUES ('water', 'נהר', 1, false), ('water', 'גשר', 2, true), ('home', 'חלון', 1, true), ('home', 'מפתח', 2, true)), w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[֐-׿]+')) AS term FROM documents WHERE text IS NOT NULL) SELECT doc_id, tag, string_agg(term, ', ' ORDER BY term_no) AS terms, bool_and(homograph) AS only_homograph FROM w JOIN l USING (term) GROUP BY 1, 2")
def f09_f23_lexical_hits(spark: SparkSession, d: str) -> DataFrame:
    lexicon = spark.createDataFrame([("water", "נהר", 1, False), ("water", "גשר", 2, True), ("home", "חלון", 1, True), ("home", "מפתח", 2, True)], "tag string, term string, term_no int, homograph boolean")
    t = table(spark, d, "documents").where("text is not null").select("doc_id", X.hebrew_words(F.col("text")).alias("words"))
    return R.lexical_hits(t, "doc_id", "words", lexicon)


@query("SELECT doc_id, length(text) AS n, CASE WHEN length(text) <= 130 THEN text ELSE regexp_replace(substr(text, 1, 130), ' [^ ]*$', '') || '…' END AS clipped FROM (SELECT doc_id, regexp_replace(text, '[\\n\\r]+', ' ', 'g') AS text FROM documents WHERE text IS NOT NULL)")
def f18_clipped(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.regexp_replace("text", r"[\n\r]+", " ").alias("text"))
    return t.select("doc_id", F.length("text").alias("n"), X.clip(F.col("text")).alias("clipped"))


@query("WITH t AS (SELECT doc_id, text, instr(text, 'ה') AS p FROM documents WHERE contains(text, 'ה')) SELECT doc_id, CASE WHEN p - 1 > 20 THEN '…' ELSE '' END || substr(text, greatest(p - 20, 1), least(p + 20, length(text)) - greatest(p - 21, 0)) || CASE WHEN p + 20 < length(text) THEN '…' ELSE '' END AS context, substr(text, greatest(p - 10, 1), 30) AS excerpt FROM t")
def f20_f21_context_window(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where(F.contains(F.col("text"), F.lit("ה"))).withColumn("p", F.instr("text", F.lit("ה")))
    return t.select("doc_id", X.context_window(F.col("text"), F.col("p") - 1, F.col("p"), 20).alias("context"), X.excerpt(F.col("text"), F.lit("ה"), 10, 30).alias("excerpt"))


@query("SELECT p_partkey, CASE WHEN l = '' AND r = '' THEN '' ELSE l || m || r END AS word FROM (SELECT p_partkey, regexp_extract(substr(p_name, 1, 4), '([^ ]*)$', 1) AS l, substr(p_name, 5, 2) AS m, regexp_extract(substr(p_name, 7), '^([^ ]*)', 1) AS r FROM part)")
def f22_containing_word(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.containing_word(F.col("p_name"), F.lit(4), F.lit(6)).alias("word"))


@query("SELECT event_id, CASE WHEN s >= 3600 THEN printf('%dh%02dm', s // 3600, s % 3600 // 60) WHEN s >= 60 THEN printf('%dm%02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS took FROM (SELECT event_id, event_id * 37 % 9000 AS s FROM events)")
def f42_durations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", X.duration(F.col("event_id") * 37 % 9000).alias("took"))


@query("SELECT DISTINCT tag, replace(CASE WHEN contains(tag, ':') THEN regexp_extract(tag, ':([^:]*)$', 1) ELSE tag END, '_', ' ') AS label, CASE WHEN lower(split_part(tag, ':', 1)) = 'food' THEN 'meals' ELSE split_part(tag, ':', 1) END AS family FROM quality_results WHERE tag IS NOT NULL")
def f39_f42_labels(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "quality_results").where("tag is not null").select("tag").distinct()
    return t.select("tag", X.humanized(F.col("tag")).alias("label"), X.mapped(F.substring_index("tag", ":", 1), {"food": "meals"}).alias("family"))


@query(f"WITH {STORIES} SELECT story_id, CASE WHEN list_contains(tags, 'wonders:talking_well') THEN 'talking' WHEN list_contains(tags, 'speech:oath') THEN 'oath' WHEN list_contains(tags, 'kin:orphan') THEN 'orphan' ELSE 'none' END AS category FROM stories")
def f28_derived_category(spark: SparkSession, d: str) -> DataFrame:
    top = X.highest(F.col("tags"), ["kin:orphan", "speech:oath", "wonders:talking_well"], "none")
    return _stories(spark, d).select("story_id", X.mapped(top, {"kin:orphan": "orphan", "speech:oath": "oath", "wonders:talking_well": "talking"}).alias("category"))


@query("WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'major' WHEN 1 THEN 'minor' ELSE 'major+minor' END AS a, CASE l_suppkey % 4 WHEN 0 THEN 'major' WHEN 1 THEN 'minor' WHEN 2 THEN 'major+minor' ELSE 'no' END AS b FROM lineitem) SELECT l_orderkey, l_linenumber, a = b OR (a = 'major+minor' AND b IN ('major', 'minor')) OR (b = 'major+minor' AND a IN ('major', 'minor')) AS near FROM t")
def f26_near_equal(spark: SparkSession, d: str) -> DataFrame:
    m, k = F.col("l_linenumber") % 3, F.col("l_suppkey") % 4
    a = F.when(m == 0, "major").when(m == 1, "minor").otherwise("major+minor")
    b = F.when(k == 0, "major").when(k == 1, "minor").when(k == 2, "major+minor").otherwise("no")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.near_equal(a, b).alias("near"))


@query("SELECT t AS raw, CASE lower(t) WHEN 'wikidata' THEN 'Wikidata' WHEN 'kima' THEN 'Kima' WHEN 'jewishgen' THEN 'JewishGen' WHEN 'disjestdb' THEN 'DiJeStDB' ELSE t END AS kind FROM (SELECT DISTINCT CASE n_nationkey % 5 WHEN 0 THEN 'WIKIDATA' WHEN 1 THEN 'kima' WHEN 2 THEN 'Jewishgen' WHEN 3 THEN 'DisJestDB' ELSE n_name END AS t FROM nation)")
def f14_id_types(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey") % 5
    t = table(spark, d, "nation").select(F.when(k == 0, "WIKIDATA").when(k == 1, "kima").when(k == 2, "Jewishgen").when(k == 3, "DisJestDB").otherwise(F.col("n_name")).alias("raw")).distinct()
    known = F.create_map(*[F.lit(x) for kv in ID_TYPES.items() for x in kv])
    return t.select("raw", F.coalesce(F.element_at(known, F.lower("raw")), "raw").alias("kind"))


@query("SELECT doc_id, replace(replace(text, 'נהר', '**נהר**'), 'river', '**river**') AS marked FROM documents WHERE text IS NOT NULL")
def f38_highlights(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.highlighted(F.col("text"), ["נהר", "river"]).alias("marked"))


@query("SELECT story_id, tag, regexp_matches(tag, '^[a-z]+:[a-z_]+$') AS well_formed, tag IN (SELECT tag FROM human_labels) AS listed FROM (SELECT DISTINCT story_id, tag FROM quality_results WHERE tag IS NOT NULL)")
def f37_topic_validation(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "quality_results").where("tag is not null").select("story_id", "tag").distinct()
    known = table(spark, d, "human_labels").select("tag").where("tag is not null").distinct().withColumn("_k", F.lit(True))
    return q.join(known, "tag", "left").select("story_id", "tag", F.col("tag").rlike("^[a-z]+:[a-z_]+$").alias("well_formed"), F.coalesce("_k", F.lit(False)).alias("listed"))


@query("WITH c(tag, d) AS (VALUES ('speech:oath', 'A vow is taken')), m(tag, d) AS (VALUES ('speech:oath', 'unused'), ('kin:orphan', 'A child alone')) SELECT tag, coalesce(c.d, m.d, replace(regexp_replace(tag, '^[^:]*:', ''), '_', ' ')) AS definition FROM (SELECT DISTINCT tag FROM quality_results WHERE tag IS NOT NULL) LEFT JOIN c USING (tag) LEFT JOIN m USING (tag)")
def f36_definitions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "quality_results").where("tag is not null").select("tag").distinct()
    curated = spark.createDataFrame([("speech:oath", "A vow is taken")], "tag string, definition string")
    merged = spark.createDataFrame([("speech:oath", "unused"), ("kin:orphan", "A child alone")], "tag string, definition string")
    return L.precedence(t, [(curated, ["tag"]), (merged, ["tag"])], "definition").select("tag", F.coalesce("definition", X.humanized(F.col("tag"))).alias("definition"))


@query("SELECT l_orderkey, l_linenumber, s + 800 * l_linenumber AS absolute_start, s + 800 * l_linenumber + 5 AS absolute_end, s BETWEEN 2 AND 6 AS inside FROM (SELECT l_orderkey, l_linenumber, l_partkey % 10 AS s FROM lineitem)")
def m10_m11_offsets(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("l_partkey") % 10
    skip = F.array(F.struct(F.lit(2).alias("start"), F.lit(7).alias("end")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (s + 800 * F.col("l_linenumber")).alias("absolute_start"), (s + 800 * F.col("l_linenumber") + 5).alias("absolute_end"), N.overlaps(s, s + 1, skip).alias("inside"))


@query("SELECT c_custkey, round(1000.0 * c_acctbal / nullif(c_nationkey, 0), 6) AS per_thousand, round((c_custkey + 1e-6) / (c_nationkey + 0.5), 6) AS smoothed FROM customer")
def m05_rates(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.round(F.try_divide(1000.0 * F.col("c_acctbal"), F.col("c_nationkey")), 6).alias("per_thousand"), F.round((F.col("c_custkey") + 1e-6) / (F.col("c_nationkey") + 0.5), 6).alias("smoothed"))


# --- model in the loop -------------------------------------------------------------------------------------------


@query(f"WITH {ITEMS} SELECT category, count(*) AS calls FROM items WHERE opus IS NULL GROUP BY 1")
def l06_u08_calls_needed(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d)
    return R.work_left(a, a.where("opus is not null"), ["story_id", "tag"], F.col("category"))


@query(f"WITH {ITEMS} SELECT story_id, tag FROM items WHERE sonnet AND NOT opus")
def l07_false_positives(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).where("sonnet and not opus").select("story_id", "tag")


@query(f"WITH {ITEMS} SELECT category, count(*) AS pairs, count(*) FILTER (opus) AS confirmed, count(*) FILTER (NOT opus) / nullif(count(opus), 0) >= 0.3 AS leaky FROM items GROUP BY 1")
def l08_review_summary(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).groupBy("category").agg(F.count("*").alias("pairs"), F.count_if("opus").alias("confirmed"), (F.try_divide(F.count_if(~F.col("opus")), F.count("opus")) >= 0.3).alias("leaky"))


@query(f"WITH {ITEMS}, v AS (SELECT story_id, tag, 'opus' AS model, opus AS applies FROM items WHERE opus IS NOT NULL UNION ALL SELECT story_id, tag, 'sonnet', sonnet FROM items WHERE sonnet IS NOT NULL) SELECT story_id, tag, model, applies FROM v QUALIFY row_number() OVER (PARTITION BY story_id, tag ORDER BY model) = 1")
def l03_u07_preferred_model(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d)
    v = a.where("opus is not null").select("story_id", "tag", F.lit("opus").alias("model"), F.col("opus").alias("applies"), F.lit(None).cast("timestamp").alias("ts"))
    v = v.union(a.where("sonnet is not null").select("story_id", "tag", F.lit("sonnet"), "sonnet", F.lit(None).cast("timestamp")))
    return U.cached(a.select("story_id", "tag"), v, ["story_id", "tag"], ["opus", "sonnet"])[0].select("story_id", "tag", "model", "applies")
