"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.llm.components import components
from loomstead.llm.consensus import answer, consensus
from loomstead.llm.gazetteer import link
from loomstead.llm.leakage import leaks
from loomstead.llm.mixing import mix
from loomstead.llm.names import same_person
from loomstead.llm.places import match_places
from loomstead.llm.truncation import broken_off
from loomstead.operators.packed import unpack
from loomstead.session import cut, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions with every record of the person they name."""
    return same_person(table(spark, sf_dir, "fuzzy_review"), "review_id", "name", table(spark, sf_dir, "person_records"), "rec_id", ["names_he", "names_en"]).select("review_id", "rec_id")


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed places with the place they mean, confidence and distance."""
    matches = match_places(table(spark, sf_dir, "place_csv"), "csv_row", table(spark, sf_dir, "place_xml"), "xml_id")
    return matches.withColumn("csv_row", F.col("csv_row").cast("bigint"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed places with the place of the authority file they mean."""
    return p2_matches(spark, sf_dir).select("csv_row", "xml_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories with the smallest story of their group, from pairs and from cells of several members."""
    members = unpack(table(spark, sf_dir, "story_clusters"), "cluster_id", "members", "members")
    members = cut(members.select("row_key", F.regexp_replace(F.regexp_extract("item_value", r"([^/]*)$", 1), r"^\s+|\s+$", "").alias("story")).where("story <> ''"))
    heads = members.groupBy("row_key").agg(F.min("story").alias("head"))
    pairs = table(spark, sf_dir, "story_duplicates").select("story_a", "story_b").unionByName(members.join(heads, "row_key").select(F.col("head").alias("story_a"), F.col("story").alias("story_b")))
    return components(pairs, "story_a", "story_b").select(F.col("node").alias("story_id"), F.col("group_node").alias("group_story"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every person's and model's answer to an item, spelt ``yes`` or ``no``; open answers are left out."""
    people = table(spark, sf_dir, "human_labels").dropDuplicates(["label_id"]).select("story_id", "tag", F.concat(F.lit("person:"), "annotator").alias("who"), answer(F.col("applies")).alias("given"))
    quality = table(spark, sf_dir, "quality_results")
    for model in ("sonnet", "opus"):
        people = people.unionByName(quality.select("story_id", "tag", F.lit(f"model:{model}").alias("who"), answer(F.col(f"{model}_applies")).alias("given")))
    items = quality.select("story_id", "tag").distinct()
    return people.where("given is not null").join(items, ["story_id", "tag"], "left_semi")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose consensus is that the tag applies."""
    items, _ = consensus(_answers(spark, sf_dir), ["story_id", "tag"], "who", "given", ["yes"])
    return items.where("label = 'yes'").select("story_id", "tag")


def p4_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with its consensus, posterior and agreement, beside the stored verdict."""
    items, _ = consensus(_answers(spark, sf_dir), ["story_id", "tag"], "who", "given", ["yes"])
    verdicts = table(spark, sf_dir, "quality_results").groupBy("story_id", "tag").agg(F.max(F.upper(F.nullif(F.trim("verdict"), F.lit("")))).alias("verdict"))
    return verdicts.join(items, ["story_id", "tag"], "left").select("story_id", "tag", "verdict", (F.coalesce("label", F.lit("no")) == "yes").alias("applies"), F.round("posterior", 6).alias("posterior"), F.round("agreement", 6).alias("agreement"), F.coalesce("answers", F.lit(0)).alias("answers"))


def p4_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitivity and specificity per annotator."""
    _, rated = consensus(_answers(spark, sf_dir), ["story_id", "tag"], "who", "given", ["yes"])
    return rated


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = None
    for name in ("auto_confirmed", "auto_linked"):
        t = table(spark, sf_dir, name)
        given = F.col("kima_id") if "kima_id" in t.columns else F.lit(None)
        one = t.select(F.lit(name).alias("list_name"), F.col("row_id").cast("bigint").alias("row_id"), "name_heb", given.cast("bigint").alias("kima_given")).dropDuplicates(["list_name", "row_id"])
        lists = one if lists is None else lists.unionByName(one)
    return link(lists.where("name_heb is not null"), "name_heb", "kima_given", table(spark, sf_dir, "gazetteer"), "kima_id", ["primary_heb_full", "primary_rom_full"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of both lists with the gazetteer entry their name means, -1 for none."""
    return _linked(spark, sf_dir).select("list_name", "row_id", F.col("entry_id").alias("kima_id"))


def p6_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names near no entry with the number of rows, per list."""
    return _linked(spark, sf_dir).where("entry_id = -1").groupBy("list_name", "name_heb").agg(F.count("*").alias("rows"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the items that leaked into them."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked passages as spans of words, to be removed."""
    return _leaks(spark, sf_dir)


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source", table(spark, sf_dir, "source_targets"), "target_share", "max_repeats")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the mix with the times each is used."""
    return _mix(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source in the mix."""
    return _mix(spark, sf_dir)[1]


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_off(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was broken off."""
    return _broken(spark, sf_dir).where("broken").select("doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of broken texts per source."""
    return _broken(spark, sf_dir).where("score is not null").groupBy("source").agg(F.count("*").alias("texts"), F.count_if("broken").alias("broken"), F.round(F.count_if("broken") / F.count("*"), 6).alias("share"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_matches": p2_matches, "p3_found": p3_found, "p4_found": p4_found, "p4_consensus": p4_consensus, "p4_reliability": p4_reliability, "p6_found": p6_found, "p6_unmatched": p6_unmatched, "p7_found": p7_found, "p7_spans": p7_spans, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_shares": p9_shares}
ORACLE: dict[str, str] = {}
