"""Marked-up editions and authority files as tables.

Whole files are read as ``(path, xml)`` rows and walked in Python one file at a time, since document order and mixed
content matter; what comes out is typed and ordered, so that everything after the scan is relational. A file that can't
be parsed gives no rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

XML_ID, XML_LANG = "{http://www.w3.org/XML/1998/namespace}id", "{http://www.w3.org/XML/1998/namespace}lang"
#: Spellings of identifier types.
ID_TYPES = {"wikidata": "Wikidata", "kima": "Kima", "tsadikim": "Tsadikim", "jewishgen": "JewishGen", "geonames": "GeoNames", "viaf": "VIAF", "dijestdb": "DiJeStDB", "disjestdb": "DiJeStDB"}
STORIES = "edition string, ord int, story_id string, tokens array<string>, text string"
MENTIONS = "edition string, mention_id string, ord int, story_id string, kind string, surface string, ref string, context string"
AUTHORITY = "kind string, ord int, xml_id string, names array<string>, names_en array<string>, lat double, lon double, birth string, death string, ids map<string,string>"


def files(spark: SparkSession, path: str) -> DataFrame:
    """``(edition, xml)`` of the files under a path, the edition being the file's stem."""
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return raw.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("edition"), F.col("value").alias("xml"))


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _text(e: ElementTree.Element, glue: str = "") -> str:
    return " ".join(glue.join(e.itertext()).split())


def _parsed(xml: str | None) -> ElementTree.Element | None:
    try:
        return ElementTree.fromstring(xml) if xml else None
    except ElementTree.ParseError:
        return None


def _walk(table: DataFrame, rows, schema: str) -> DataFrame:
    columns = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [row for edition, xml in zip(batch["edition"], batch["xml"]) if (root := _parsed(xml)) is not None for row in rows(edition, root)]
            yield pd.DataFrame(out, columns=columns)

    return table.select("edition", "xml").mapInPandas(run, schema)


def _stories(edition: str, root: ElementTree.Element) -> Iterator[tuple]:
    n = 0
    for div in root.iter():
        if _local(div) == "div" and div.get("type") == "story":
            tokens = [t.strip() for s in div.iter() if _local(s) == "span" and s.get("ana") for t in s.get("ana").split(";") if t.strip()]
            yield edition, n, div.get(XML_ID), tokens, _text(div, " ")
            n += 1


def _mentions(edition: str, root: ElementTree.Element) -> Iterator[tuple]:
    n = 0

    def visit(e: ElementTree.Element, story: str | None, paragraph: str | None) -> Iterator[tuple]:
        nonlocal n
        kind = _local(e)
        if kind == "div" and e.get("type") == "story":
            story = e.get(XML_ID)
        if kind == "p":
            paragraph = _text(e)
        if kind in ("placeName", "persName", "orgName") or kind == "name" and e.get("type") in ("work", "book", "misc", "event"):
            yield edition, f"{edition}#{n}", n, story, kind, _text(e), e.get("ref"), paragraph
            n += 1
        for child in e:
            yield from visit(child, story, paragraph)

    yield from visit(root, None, None)


def _geo(text: str | None) -> tuple[float | None, float | None]:
    parts = (text or "").split(",")
    try:
        return (float(parts[0]), float(parts[1])) if len(parts) == 2 else (None, None)
    except ValueError:
        return None, None


def _authority(_: str, root: ElementTree.Element) -> Iterator[tuple]:
    for n, e in enumerate(x for x in root.iter() if _local(x) in ("place", "person", "bibl")):
        kind, names, english, lat, lon, ids, dates = _local(e), [], [], None, None, {}, {}
        for c in e.iter():
            tag, text = _local(c), _text(c)
            if tag in ("placeName", "persName", "title") and text:
                names.append(text)
            elif tag == "name" and text:
                (names if c.get(XML_LANG) in (None, "he") else english).append(text) if kind == "person" else names.append(text)
            elif tag == "geo" and lat is None:
                lat, lon = _geo(c.text)
            elif tag == "idno" and text:
                ids[ID_TYPES.get((c.get("type") or "").lower(), c.get("type") or "")] = text
            elif tag in ("birth", "death"):
                dates[tag] = c.get("when") or text or None
        yield kind, n, e.get(XML_ID), names, english, lat, lon, dates.get("birth"), dates.get("death"), ids


def stories(table: DataFrame) -> DataFrame:
    """Stories with their tags in order; words of neighbouring elements are parted by a blank."""
    return _walk(table, _stories, STORIES)


def mentions(table: DataFrame) -> DataFrame:
    """Marked names in document order with the story and paragraph around them; an id that is never counted again."""
    return _walk(table, _mentions, MENTIONS)


def authority(table: DataFrame) -> DataFrame:
    """Places, persons and titles of authority files; a point of other than two parts is none, the last id of a type wins."""
    return _walk(table, _authority, AUTHORITY)
