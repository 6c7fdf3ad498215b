"""Linkage of records by identifiers, names, coordinates, rules and vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions.numeric import haversine_km
from loomstead.functions.text import gazetteer_number, item_number, name_similarity, normalize_name, normalized_similarity, trigrams
from loomstead.operators.sets import first_by_rank
from loomstead.session import cut

HIGH, LOW = 0.80, 0.55
#: Lowest similarity within ``CLOSE_KM``; sides in km of the cells that such pairs are looked up by.
CLOSE, CLOSE_KM, CELL_KM = 0.35, 5.0, 20.0


def identifiers(rows: DataFrame, key: str, wikidata: str, gazetteer: str, url: str) -> DataFrame:
    """``(key, kind, value)``: a record's identifiers in one form each."""
    kinds = [("gazetteer", gazetteer_number(F.col(gazetteer)).cast("string")), ("url", F.nullif(F.regexp_replace(F.trim(url), "/+$", ""), F.lit(""))), ("wikidata", item_number(F.col(wikidata)))]
    return rows.select(F.col(key).alias("key"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds])).alias("i")).select("key", "i.*").where("value is not null")


def identifier_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """Matches of two identifier tables, one row per left key: one right key MATCHED at 1.0, several CONFLICT at 0.9."""
    # a value that one right key holds, by far the most, joins as one row; only those of several keep them all
    per_value = right.groupBy("kind", "value").agg(F.min("key").alias("r"), F.count_if(F.col("key").isNotNull()).alias("c"), F.max("key").alias("last"))
    single = left.withColumnRenamed("key", "l").join(per_value, ["kind", "value"])
    # two keys of a value are enough to tell a conflict and its first record
    both = F.when(F.col("r") == F.col("last"), F.array("r")).otherwise(F.array("r", "last"))
    hits = single.select("l", "kind", F.explode(both).alias("r")).groupBy("l", "r").agg(F.array_join(F.sort_array(F.collect_set("kind")), ", ").alias("kinds"))
    return hits.groupBy("l").agg(F.min("r").alias("r"), F.count("*").alias("n"), F.min_by("kinds", "r").alias("kinds")).select("l", "r", "kinds", F.when(F.col("n") == 1, "MATCHED").otherwise("CONFLICT").alias("status"), F.when(F.col("n") == 1, 1.0).otherwise(0.9).alias("confidence"))


def name_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(l, r)`` of ``(key, name)`` tables whose names share a trigram, or a token where one is too short for any.

    Any pair of positive similarity is among them."""
    def keyed(t: DataFrame, side: str) -> DataFrame:
        n = normalize_name(F.col("name"))
        return t.select(F.col("key").alias(side), F.explode(F.array_union(trigrams(n), F.transform(F.split(n, " "), lambda w: F.concat(F.lit("w:"), w)))).alias("g")).distinct()

    return keyed(left, "l").join(keyed(right, "r"), "g").select("l", "r").distinct()


def name_match(left: DataFrame, right: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Best right name per left ``(key, name)``: MATCHED from ``high``, CONFLICT from ``low``, else NEW without a partner."""
    pairs = name_candidates(left, right).join(left.select(F.col("key").alias("l"), F.col("name").alias("a")), "l").join(right.select(F.col("key").alias("r"), F.col("name").alias("b")), "r")
    best = pairs.withColumn("score", name_similarity(F.col("a"), F.col("b"))).groupBy("l", "r").agg(F.max("score").alias("score")).where(F.col("score") >= low)
    best = first_by_rank(best, ["l"], F.col("score").desc(), F.col("r"))
    return left.select(F.col("key").alias("l")).distinct().join(best, "l", "left").select("l", "r", F.round("score", 6).alias("score"), F.when(F.col("score") >= high, "MATCHED").when(F.col("score").isNotNull(), "CONFLICT").otherwise("NEW").alias("status"))


def _prefixes(names: DataFrame, counts: DataFrame, low: float) -> DataFrame:
    """``(n, m, g, i)``: of each name's ``m`` trigrams the rarest, ``i``-th ones, one of which any name ``low`` alike has too."""
    each = names.select("n", "m", F.explode("grams").alias("g")).join(counts, "g")
    ranked = each.withColumn("i", F.row_number().over(Window.partitionBy("n").orderBy("c", "g")))
    return ranked.where(F.col("i") <= F.col("m") - F.ceil(F.col("m") * low - 1e-9) + 1).select("n", "m", "g", "i")


def _met(a: DataFrame, b: DataFrame, on: list[str], low: float) -> DataFrame:
    """``(x, y)`` of prefixes with a key in common that may be ``low`` alike: no more grams are shared than follow the first one."""
    pairs = a.withColumnsRenamed({"n": "x", "m": "mx", "i": "ix"}).join(b.withColumnsRenamed({"n": "y", "m": "my", "i": "iy"}), on)
    shared = F.least(F.col("mx") - F.col("ix"), F.col("my") - F.col("iy")) + 1
    return pairs.where(shared >= (F.col("mx") + F.col("my")) * (low / (1 + low)) - 1e-9).select("x", "y").distinct()


def _short(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(x, y)`` of names that share a word where one has no trigram."""
    words = lambda t, n: t.select(F.col("n").alias(n), F.col("m").alias(f"m{n}"), F.explode(F.array_distinct(F.split("n", " "))).alias("w"))
    x, y = words(a, "x"), words(b, "y")
    return x.where("mx = 0").join(y, "w").select("x", "y").unionByName(x.join(y.where("my = 0"), "w").select("x", "y")).distinct()


def _cells(places: DataFrame, reach: float) -> DataFrame:
    """Places in the cells of space that lie within ``reach`` km; the straight way is never the longer one, at any latitude."""
    lat, lon = F.radians("lat"), F.radians("lon")
    axes = {"cx": F.cos(lat) * F.cos(lon), "cy": F.cos(lat) * F.sin(lon), "cz": F.sin(lat)}
    out = places.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon"))
    for c, v in axes.items():
        out = out.withColumn(c, F.explode(F.sequence(F.floor((6371.0 * v - reach) / CELL_KM), F.floor((6371.0 * v + reach) / CELL_KM))))
    return out


def geo_band_score(sim: Column, km: Column) -> Column:
    """Name similarity raised or lowered by distance; null where the band asks for a likelier name, as all but the nearest do."""
    banded = F.when(km <= CLOSE_KM, F.when(sim >= CLOSE, sim + 0.30)).when(sim < LOW, F.lit(None)).when(km <= 30, sim + 0.15).when(km.isNull() | (km <= 100), sim).otherwise(sim - 0.15)
    return F.when(banded.isNotNull(), F.greatest(F.least(banded, F.lit(1.0)), F.lit(0.0)))


def name_geo_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """Best right record per left ``(key, name, lat, lon)`` by banded score, NEW where no band takes one.

    Each two names are compared once: those that may be ``LOW`` alike wherever they stand, those that may be ``CLOSE`` alike
    where they stand within ``CLOSE_KM``. Of equal names at one spot the smallest right key stands for all."""
    typed = left.select("key", normalize_name(F.col("name")).alias("n"), "lat", "lon").where("n <> ''")
    spots = cut(typed.select("n", "lat", "lon").distinct())
    held = cut(right.select("key", normalize_name(F.col("name")).alias("n"), "lat", "lon").where("n <> ''").groupBy("n", "lat", "lon").agg(F.min("key").alias("r")))
    a, b = (cut(t.select("n").distinct().select("n", trigrams(F.col("n")).alias("grams")).withColumn("m", F.size("grams"))) for t in (spots, held))
    counts = cut(a.unionByName(b).select("n", "grams").distinct().select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("c")))
    sim = normalized_similarity(F.col("x"), F.col("y"))
    km = haversine_km(F.col("la"), F.col("lo"), F.col("pa"), F.col("po"))
    here, there = spots.withColumnsRenamed({"n": "x", "lat": "la", "lon": "lo"}), held.withColumnsRenamed({"n": "y", "lat": "pa", "lon": "po"})
    alike = _met(_prefixes(a, counts, LOW), _prefixes(b, counts, LOW), ["g"], LOW).unionByName(_short(a, b))
    alike = cut(alike.withColumn("sim", sim).where(F.col("sim") >= LOW))
    anywhere = alike.join(here, "x").join(there, "y").select("x", "la", "lo", "r", km.alias("km"), "sim")
    cell = ["cx", "cy", "cz"]
    near_a, near_b = _cells(spots, 0.0), _cells(held, CLOSE_KM + 0.01)
    keyed_a, keyed_b = near_a.join(_prefixes(a, counts, CLOSE), "n").select("n", "m", "g", "i", *cell).distinct(), near_b.join(_prefixes(b, counts, CLOSE), "n").select("n", "m", "g", "i", *cell).distinct()
    close = _met(keyed_a, keyed_b, [*cell, "g"], CLOSE).unionByName(_short(a, b))
    close = cut(close.withColumn("sim", sim).where((F.col("sim") >= CLOSE) & (F.col("sim") < LOW)))
    x, y = near_a.withColumnsRenamed({"n": "x", "lat": "la", "lon": "lo"}), near_b.withColumnsRenamed({"n": "y", "lat": "pa", "lon": "po"})
    beside = close.join(x, "x").join(y, ["y", *cell]).select("x", "la", "lo", "r", km.alias("km"), "sim").where(F.col("km") <= CLOSE_KM)
    scored = anywhere.unionByName(beside).withColumn("score", geo_band_score(F.col("sim"), F.col("km"))).where("score is not null")
    best = scored.groupBy("x", "la", "lo").agg(F.min(F.struct((-F.col("score")).alias("o"), "r", "km", "score")).alias("b"))
    found = typed.join(best, (F.col("n") == F.col("x")) & F.col("lat").eqNullSafe(F.col("la")) & F.col("lon").eqNullSafe(F.col("lo"))).groupBy("key").agg(F.min("b").alias("b")).select(F.col("key").alias("l"), "b.r", "b.score", "b.km")
    every = left.select(F.col("key").alias("l")).distinct().join(found, "l", "left")
    return every.select("l", "r", F.round("score", 6).alias("score"), F.round("km", 6).alias("km"), F.when(F.col("score") >= HIGH, "MATCHED").when(F.col("score").isNotNull(), "CONFLICT").otherwise("NEW").alias("status"))


def precedence(targets: DataFrame, sources: list[tuple[DataFrame, list[str]]], value: str) -> DataFrame:
    """``value`` of the first source that has the target's keys, and its number; null for none."""
    out, hits = targets, []
    for i, (source, keys) in enumerate(sources):
        out = out.join(source.select(*keys, F.col(value).alias(f"_v{i}")).dropDuplicates(keys), keys, "left")
        hits.append(F.col(f"_v{i}"))
    rank = F.coalesce(*[F.when(h.isNotNull(), F.lit(i + 1)) for i, h in enumerate(hits)])
    return out.select(*targets.columns, F.coalesce(*hits).alias(value), rank.alias("source_rank"))


def symmetric(twins: DataFrame) -> DataFrame:
    """``(story, twin, sim)`` of pairs ``(a, b, sim)`` in both directions, the highest sim of each."""
    both = twins.select(F.col("a").alias("story"), F.col("b").alias("twin"), "sim").unionByName(twins.select(F.col("b").alias("story"), F.col("a").alias("twin"), "sim"))
    return both.groupBy("story", "twin").agg(F.max("sim").alias("sim"))


def propagate(suggestions: DataFrame, twins: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``suggestions (story, tag, decision)`` carried along ``twins (a, b, sim)``: the twin's own decision is set beside.

    ``conflict`` where the twin has another decision, else ``auto-`` with the decision, also where it has none."""
    own = verdicts.select(F.col("story").alias("twin"), "tag", F.col("decision").alias("existing")).dropDuplicates(["twin", "tag"])
    action = F.when(F.col("existing") != F.col("decision"), "conflict").otherwise(F.concat(F.lit("auto-"), "decision"))
    return suggestions.where("decision is not null").distinct().join(symmetric(twins), "story").join(own, ["twin", "tag"], "left").select("story", "tag", "twin", "sim", "decision", action.alias("action"))


def closest_twin(twins: DataFrame) -> DataFrame:
    both = twins.select(F.col("a").alias("story"), F.col("b").alias("twin"), "sim").unionByName(twins.select(F.col("b").alias("story"), F.col("a").alias("twin"), "sim"))
    return first_by_rank(both.where("story is not null and twin is not null and story <> twin"), ["story"], F.col("sim").desc_nulls_last(), F.col("twin"))


def cosine_pairs(vectors: DataFrame, key: str, vector: str, threshold: float, blocks: int | None = None, group: str | None = None, rows_a_block: int = 5_000) -> DataFrame:
    """``(a, b, sim)`` with a < b, ``sim`` at least ``threshold``; only across groups where one is given.

    Vectors are dealt to ``blocks`` blocks; each pair of blocks is one task that multiplies two matrices, so no block
    meets more than ``blocks`` others and memory is that of two blocks. Their number follows from ``rows_a_block``."""
    if blocks is None:
        blocks = max(1, -(-vectors.count() // rows_a_block))
    g = F.col(group).cast("string") if group else F.lit(None).cast("string")
    base = vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<float>").alias("v"), g.alias("g"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("blk")).where("v is not null")
    each = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o"))
    cells = each.select("k", "v", "g", "blk", F.least("blk", "o").alias("x"), F.greatest("blk", "o").alias("y"))

    def multiply(cell: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = cell
        left, right = pdf[pdf["blk"] == x], pdf[pdf["blk"] == y]
        if left.empty or right.empty:
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "sim": pd.Series(dtype="float64")})
        m, n = (np.stack(p["v"].to_numpy()).astype(np.float64) for p in (left, right))
        m, n = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12), n / np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-12)
        out = []
        for at in range(0, len(m), 1024):
            i, j = np.nonzero((s := m[at : at + 1024] @ n.T) >= threshold)
            a, b = left["k"].to_numpy()[at + i], right["k"].to_numpy()[j]
            keep = (a < b) if x == y else (a != b)
            if group:
                keep &= left["g"].to_numpy()[at + i] != right["g"].to_numpy()[j]
            out.append(pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "sim": s[i, j][keep]}))
        return pd.concat(out)

    return cells.groupBy("x", "y").applyInPandas(multiply, "a bigint, b bigint, sim double")


def centroids(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """Unit mean vector per group: means per dimension, aggregated before the shuffle."""
    dims = vectors.select(group, F.posexplode(vector).alias("d", "x")).groupBy(group, "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = dims.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("mean"))
    n = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x))
    return mean.select(group, F.transform("mean", lambda x: F.try_divide(x, n)).alias("centroid"))


def _absent_from(column: str):
    keys = F.map_keys(F.coalesce(column, F.create_map().cast("map<string,string>")))
    return lambda k, v: ~F.array_contains(keys, k)


def merge_fields(base: DataFrame, extra: DataFrame, key: str, arrays: list[str], maps: list[str], scalars: list[str]) -> DataFrame:
    """``base`` enriched: missing array values and map keys added, scalars filled where null or blank; what stands there wins."""
    j = base.join(extra.select(key, *[F.col(c).alias(f"_{c}") for c in arrays + maps + scalars]).dropDuplicates([key]), key, "left")
    out = {c: F.array_union(F.coalesce(c, F.array().cast("array<string>")), F.coalesce(f"_{c}", F.array().cast("array<string>"))) for c in arrays}
    out |= {c: F.map_concat(F.map_filter(F.coalesce(f"_{c}", F.create_map().cast("map<string,string>")), _absent_from(c)), F.coalesce(c, F.create_map().cast("map<string,string>"))) for c in maps}
    out |= {c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.col(f"_{c}").cast("string")) for c in scalars}
    return j.select(*[out.get(c, F.col(c)).alias(c) for c in base.columns])


def context_rules(mentions: DataFrame, rules: DataFrame) -> DataFrame:
    """First rule ``(rule_no, name_pattern, cue, target)`` whose pattern fits a mention's name and whose cue stands in its context.

    Rules are a written list of few rows and are broadcast; mentions already decided by hand stay out of it."""
    j = mentions.where("decision is null").join(F.broadcast(rules), F.rlike(F.col("name"), F.col("name_pattern")) & F.contains(F.col("context"), F.col("cue")))
    return first_by_rank(j, ["mention_id"], F.col("rule_no")).select("mention_id", "target", "rule_no")


