"""Marked-up text out of tables, and rewrites of it, as JVM expressions where order inside a document doesn't matter."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def element(tag: str, content: Column, **attributes: Column) -> Column:
    """An element of ready content; attributes that are null are left out. ``xml_id`` stands for ``xml:id``."""
    named = [F.coalesce(F.concat(F.lit(f' {k.replace("_", ":")}="'), escaped(v.cast("string")), F.lit('"')), F.lit("")) for k, v in attributes.items()]
    return F.concat(F.lit(f"<{tag}"), *named, F.lit(">"), F.coalesce(content, F.lit("")), F.lit(f"</{tag}>"))


def place_elements(places: DataFrame) -> DataFrame:
    """One ``place`` element a row of ``(xml_id, names, lat, lon, ids)``, in the order of ids' types."""
    names = F.array_join(F.transform("names", lambda n: element("placeName", escaped(n))), "")
    geo = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.concat(F.lit("<location><geo>"), F.col("lat").cast("string"), F.lit(","), F.col("lon").cast("string"), F.lit("</geo></location>"))).otherwise("")
    ids = F.array_join(F.transform(F.array_sort(F.map_entries("ids")), lambda e: F.concat(F.lit('<idno type="'), escaped(e["key"]), F.lit('">'), escaped(e["value"]), F.lit("</idno>"))), "")
    return places.select("xml_id", element("place", F.concat(names, geo, F.coalesce(ids, F.lit(""))), xml_id=F.col("xml_id")).alias("xml"))


def unwrap(xml: Column, tag: str, condition: str = "") -> Column:
    """Elements of a tag (whose attributes match a pattern) replaced by their content; innermost ones, nesting left alone."""
    return F.regexp_replace(xml, rf"(?s)<{tag}\b{condition}[^<>]*>((?:(?!</?{tag}\b).)*)</{tag}>", "$1")


def set_tags(tokens: Column, drop: Column, add: Column) -> Column:
    """A story's tags without some and with others, order kept and each once; a null list is empty."""
    none = F.array().cast("array<string>")
    return F.array_union(F.array_except(F.coalesce(tokens, none), F.coalesce(drop, none)), F.coalesce(add, none))


@F.pandas_udf(T.StringType())
def render_spans(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Text with ``array<struct<start,end,tag,ref>>`` put around it, overlapping spans passed over in greedy order."""
    def one(text, marks):
        if text is None:
            return None
        out, at = [], 0
        esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        for m in sorted(marks if marks is not None else [], key=lambda m: (m["start"], -m["end"])):
            if m["start"] is None or m["start"] < at or m["end"] > len(text) or m["end"] <= m["start"]:
                continue
            ref = f' ref="{esc(m["ref"])}"' if m["ref"] else ""
            out += [esc(text[at : m["start"]]), f"<{m['tag']}{ref}>", esc(text[m["start"] : m["end"]]), f"</{m['tag']}>"]
            at = m["end"]
        return "".join(out) + esc(text[at:])

    return pd.Series([one(t, s) for t, s in zip(texts, spans)], dtype="object")


def wrap_terms(xml: Column, terms: list[str], tag: str, skip: list[str]) -> Column:
    """Terms put into an element wherever they stand outside of markup and of the elements to skip."""
    guard = "|".join([rf"<{s}\b.*?</{s}>" for s in skip] + [r"<[^>]*>"])
    pattern = re.compile(rf"({guard})|\b({'|'.join(sorted(map(re.escape, terms), key=len, reverse=True))})\b", re.S)

    @F.pandas_udf(T.StringType())
    def wrap(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else pattern.sub(lambda m: m.group(1) or f"<{tag}>{m.group(2)}</{tag}>", x))

    return wrap(xml)
