"""Places of two tables without a common key, linked by soft logic.

Each candidate pair is a variable in [0, 1]: how true it is that both rows mean one place. Weighted rules are hinges that
are linear in these variables:

* evidence: names alike, near by, same district make a pair true; their absence makes it false;
* exclusivity: a listed row means at most one place;
* transitivity: where two listed rows are alike, what one means the other means.

Their weighted sum is convex. It is minimised by alternating directions: every rule keeps its own copies of its variables
and moves them to the minimum of its hinge and the squared distance to the consensus, then each variable's consensus is
the mean over its rules. Candidates are all pairs within 30 km, read either
way round and found by the cells of a grid, whose names are at least 0.55 alike; where a row has no coordinates they share one of
as many rare pairs of sounds as the allowed edits ask for, and must be likelier. Nothing is compared with everything.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstead.llm.spelling import HEBREW_SOUNDS, LATIN_SOUNDS, QUOTES, edits, plain, sound
from loomstead.session import cut

# Words of kind before a place's name, and words for old and new with their sense.
KIND_WORDS = {"קק", "ק ק", "עיר", "העיר", "כפר", "הכפר", "שטעטל", "די"}
SENSES = {"הישנה": "old", "הישנ": "old", "ישנ": "old", "אלט": "old", "אלטע": "old", "old": "old", "stary": "old", "stare": "old", "alt": "old", "החדשה": "new", "חדש": "new", "החדש": "new", "ניי": "new", "נייע": "new", "nay": "new", "new": "new", "nowy": "new", "neu": "new", "nowe": "new", "novy": "new", "עליונה": "upper", "העליונה": "upper", "אויבער": "upper", "ober": "upper", "upper": "upper", "oyber": "upper", "תחתונה": "lower", "התחתונה": "lower", "אונטער": "lower", "unter": "lower", "lower": "lower", "גדולה": "great", "הגדולה": "great", "גרויס": "great", "groys": "great", "great": "great", "wielki": "great", "velke": "great", "קטנה": "small", "הקטנה": "small", "קליינ": "small", "kleyn": "small", "little": "small", "maly": "small"}
SENSES = {k.translate(str.maketrans("ךםןףץ", "כמנפצ")): v for k, v in SENSES.items()}
NAME = T.ArrayType(T.StructType([T.StructField("sound", T.StringType()), T.StructField("sense", T.StringType()), T.StructField("district", T.StringType())]))
SHAPE = T.StructType([T.StructField("bits", T.LongType()), T.StructField("grams", T.ArrayType(T.StringType()))])
#: Lowest name similarity of a candidate, reach of the rules in km, what rough coordinates may be off, weights, rounds.
LEAST = 0.55
#: Edits a sound that names alone may differ by, and that they may where the districts agree; a third at most, see _named.
APART, APART_SAME = 0.3, 1 / 3
REACH, ROUGH = 30.0, 6.0
#: Degrees of a cell; 720 of them go round.
CELL_LAT, CELL_LON, ROUND = 0.33, 0.5, 720
EVIDENCE, PRIOR, EXCLUSIVE, ALIKE, ROUNDS, RHO = 1.0, 0.45, 6.0, 0.6, 12, 1.0


def parse_name(name: str | None) -> dict | None:
    """Sounds of a place name without words of kind, its sense (old, new ...) and the district in brackets."""
    if name is None or not name.strip():
        return None
    s = QUOTES.sub("", plain(name))
    m = re.search(r"\(([^()]*)\)", s)
    district = sound(m.group(1)) if m else None
    s = re.sub(r"\([^()]*\)", " ", s)
    parts = [w for w in re.split(r"[\s\-–—:.,/]+", s) if w]
    sense = next((SENSES[w] for w in parts if w in SENSES), "")
    kept = [w for w in parts if w not in SENSES and w not in KIND_WORDS] or parts
    heard = sound("".join(kept))
    return {"sound": heard, "sense": sense, "district": district} if heard else None


@F.pandas_udf(NAME)
def _names(column: pd.Series) -> pd.Series:
    return column.map(lambda names: [p for n in (names if names is not None else ()) if (p := parse_name(n))])


@F.pandas_udf(T.StringType())
def _sound(column: pd.Series) -> pd.Series:
    return column.map(lambda d: sound(QUOTES.sub("", plain(d))) if d and d.strip() else None)


def name_likeness(a, b) -> float:
    """Highest likeness of any two parsed names, 1 less edits over length; 0 where the sense differs or it is below ``LEAST``."""
    top = 0.0
    for x in a:
        for y in b:
            if x["sense"] == y["sense"]:
                n = max(len(x["sound"]), len(y["sound"]))
                most = int((1.0 - LEAST) * n + 1e-9)
                if (d := edits(x["sound"], y["sound"], most)) <= most:
                    top = max(top, 1.0 - d / n)
    return top


_BIT = {c: i for i, c in enumerate(sorted({c for _, v in HEBREW_SOUNDS + LATIN_SOUNDS for c in v}))}


@F.pandas_udf(SHAPE)
def _shape(sounds: pd.Series) -> pd.DataFrame:
    """A bit for each sound and one for its return; the pairs of sounds, ends marked, each with the times it stood before."""
    out = []
    for s in sounds:
        seen, t, grams, bits = {}, f"^{s}$", [], 0
        for c in s:
            bits |= 1 << _BIT[c] + (31 if seen.get(c) else 0)
            seen[c] = 1
        for g in (t[i : i + 2] for i in range(len(t) - 1)):
            grams.append(f"{g}{seen.get(g, 0)}")
            seen[g] = seen.get(g, 0) + 1
        out.append((bits, grams))
    return pd.DataFrame(out, columns=["bits", "grams"])


@F.pandas_udf(T.IntegerType())
def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edits between two columns of sounds, a swap of neighbours one edit; all rows at once, by length."""
    out = np.zeros(len(a), np.int32)
    a, b = a.to_numpy(), b.to_numpy()
    by = pd.DataFrame({"m": [len(x) for x in a], "n": [len(x) for x in b]})
    for (m, n), at in by.groupby(["m", "n"]).indices.items():
        x, y = (np.frombuffer("".join(v[at]).encode("utf-32-le"), np.uint32).reshape(len(at), -1) for v in (a, b))
        before, last = None, [np.full(len(at), j, np.int32) for j in range(n + 1)]
        for i in range(m):
            now = [np.full(len(at), i + 1, np.int32)]
            for j in range(n):
                d = np.minimum(last[j] + (x[:, i] != y[:, j]), np.minimum(last[j + 1], now[j]) + 1)
                if i and j:
                    swap = (x[:, i] == y[:, j - 1]) & (x[:, i - 1] == y[:, j])
                    d = np.where(swap, np.minimum(d, before[j - 1] + 1), d)
                now.append(d.astype(np.int32))
            before, last = last, now
        out[at] = last[n]
    return pd.Series(out)


def _forms(rows: DataFrame, *columns: str) -> DataFrame:
    """Each row under the sounds ``s`` of each of its names, with their sense, length, bits and grams."""
    one = rows.select("k", *columns, F.explode("parsed").alias("x")).select("k", *columns, F.col("x.sound").alias("s"), F.col("x.sense").alias("sense"))
    return one.distinct().withColumn("n", F.length("s")).withColumn("shape", _shape("s")).select("*", "shape.*").drop("shape")


def _within(most: Column) -> Column:
    """Holds for all names ``most`` edits apart: an edit changes the length by one at most, and one sound of either."""
    bits = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b))))
    return (F.abs(F.col("na") - F.col("nb")) <= most) & (bits("ba", "bb") <= most) & (bits("bb", "ba") <= most)


def _alike(met: DataFrame) -> DataFrame:
    """Of ``met (sa, sb, most)`` the rows at most ``most`` edits apart, with their ``likeness``, 1 less edits over length."""
    return met.withColumn("apart", _edits("sa", "sb")).where("apart <= most").withColumn("likeness", 1.0 - F.col("apart") / F.greatest(F.length("sa"), F.length("sb")))


def _named(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(ka, kb, likeness)`` of rows with forms at most ``APART`` edits a sound from each other, or ``APART_SAME`` where districts agree.

    An edit, be it a swap, undoes three pairs of sounds at most. So of names ``e`` edits apart one of the ``3 e + 1`` rarest
    pairs of either is the other's too; with a third of the sounds at most edited no name has fewer pairs than that. The
    join is by pair, sense and length, and each two forms are compared once however many rows have them."""
    form = ["s", "sense", "d", "n", "bits", "grams"]
    fa, fb = a.select(form).distinct(), b.select(form).distinct()
    counts = cut(fa.select("s", "grams").unionByName(fb.select("s", "grams")).distinct().select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("c")))

    def ranked(forms: DataFrame) -> DataFrame:
        each = forms.select("s", F.explode("grams").alias("g")).distinct().join(counts, "g").select("s", "g", F.row_number().over(Window.partitionBy("s").orderBy("c", "g")).alias("r"))
        return forms.drop("grams").join(each, "s")

    left = ranked(fa).withColumn("nb", F.explode(F.sequence(F.ceil(F.col("n") * (1 - APART_SAME) - 1e-9).cast("int"), F.floor(F.col("n") / (1 - APART_SAME) + 1e-9).cast("int"))))
    left = left.select(F.col("s").alias("sa"), "sense", F.col("d").alias("da"), F.col("n").alias("na"), F.col("bits").alias("ba"), "g", F.col("r").alias("ra"), "nb")
    right = ranked(fb).select(F.col("s").alias("sb"), "sense", F.col("d").alias("db"), F.col("n").alias("nb"), F.col("bits").alias("bb"), "g", F.col("r").alias("rb"))
    longer = F.greatest("na", "nb")
    few, more = (F.floor(longer * x + 1e-9) for x in (APART, APART_SAME))
    most = F.when((few < more) & F.coalesce(F.levenshtein("da", "db") <= 2, F.lit(False)), more).otherwise(few)
    left = left.where(F.col("ra") <= 3 * more + 1)
    met = left.join(right, ["g", "sense", "nb"]).where((F.greatest("ra", "rb") <= 3 * more + 1) & _within(more)).where((F.greatest("ra", "rb") <= 3 * most + 1) & _within(most) & (F.levenshtein("sa", "sb") <= 2 * most))  # a swap counts two here
    met = met.select("sense", "sa", "da", "sb", "db", most.alias("most")).distinct()
    met = cut(_alike(met).select("sense", "sa", "da", "sb", "db", "likeness"))
    mine = a.select(F.col("k").alias("ka"), "sense", F.col("s").alias("sa"), F.col("d").alias("dk"))
    other = b.select(F.col("k").alias("kb"), "sense", F.col("s").alias("sb"), F.col("d").alias("dk"))
    pairs = met.join(mine, ["sense", "sa"]).where(F.col("da").eqNullSafe(F.col("dk"))).drop("dk")
    return pairs.join(other, ["sense", "sb"]).where(F.col("db").eqNullSafe(F.col("dk"))).select("ka", "kb", "likeness")


def kilometres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 12742.0 * F.asin(F.sqrt(F.when(a > 1.0, 1.0).otherwise(a)))  # least() would pass over a null


def _km() -> Column:
    """Distance of ``la, lo`` from ``pa, po``, read either way round, less what rough coordinates may be off."""
    km = F.least(kilometres(F.col("la"), F.col("lo"), F.col("pa"), F.col("po")), kilometres(F.col("lo"), F.col("la"), F.col("pa"), F.col("po")))
    # greatest() would pass over a null and bring a row without coordinates to 0 km of every place
    return F.when(F.col("coarse") & km.isNotNull(), F.greatest(km - ROUGH, F.lit(0.0))).otherwise(km)


def _prepared(rows: DataFrame, key: str, names: str, lat: str, lon: str, extra: str) -> DataFrame:
    """One row per key: parsed names, coordinates or null where both are 0 or one is missing, district."""
    r = rows.select(F.col(key).cast("string").alias("k"), F.col(names).alias("n"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"), F.col(extra)["district"].alias("d")).where("k is not null").dropDuplicates(["k"])
    r = r.withColumn("parsed", _names("n")).withColumn("d", _sound("d"))
    good = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~((F.col("lat") == 0) & (F.col("lon") == 0)) & ~F.isnan("lat") & ~F.isnan("lon")
    coarse = (F.round(F.col("lat"), 1) == F.col("lat")) & (F.round(F.col("lon"), 1) == F.col("lon"))
    inside = F.get(F.expr("filter(transform(parsed, x -> x.district), x -> x is not null)"), F.lit(0))
    return r.select("k", "parsed", F.when(good, F.col("lat")).alias("lat"), F.when(good, F.col("lon")).alias("lon"), coarse.alias("coarse"), F.coalesce("d", inside).alias("d"))


def _cell(lat: Column, lon: Column) -> list[Column]:
    return [F.floor(lat / CELL_LAT).alias("y"), F.pmod(F.floor(lon / CELL_LON), F.lit(ROUND)).alias("x")]


def _cells(places: DataFrame) -> DataFrame:
    """Each place in all cells that its reach touches: as many degrees either way as it spans at its latitude."""
    r = math.radians((REACH + ROUGH + 0.1) / 111.19)
    up, slant = math.degrees(r), F.sin(F.lit(r)) / F.cos(F.radians("pa"))
    wide = F.when((F.abs(F.col("pa")) + up >= 90) | (F.abs(slant) >= 1), 180.0).otherwise(F.degrees(F.asin(slant)))
    rows = F.sequence(F.floor((F.col("pa") - up) / CELL_LAT), F.floor((F.col("pa") + up) / CELL_LAT))
    columns = F.sequence(F.floor((F.col("po") - wide) / CELL_LON), F.floor((F.col("po") + wide) / CELL_LON))
    return places.withColumn("y", F.explode(rows)).withColumn("x", F.explode(F.array_distinct(F.transform(columns, lambda c: F.pmod(c, F.lit(ROUND))))))


def _evidence(near: Column, likeness: Column, same: Column) -> Column:
    """How true the evidence makes a pair, from 0 to 1."""
    # names alone must be likelier: among many places chance brings most names to 0.8
    named = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(near.isNull(), (likeness - 0.7) / 0.2).otherwise((likeness - 0.5) / 0.4)))
    far = F.when(near.isNull(), F.lit(0.5)).when(near <= 3, 1.0).when(near <= 8, 0.9).when(near <= 15, 0.7).when(near <= 30, 0.3).otherwise(0.0)
    where = F.when(same.isNull(), F.lit(0.0)).when(same, 0.15).otherwise(F.when(near <= 8, 0.0).otherwise(-0.35))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), named * F.when(near.isNull(), 0.75).otherwise(0.35) + far * F.when(near.isNull(), 0.0).otherwise(0.6) + where)) * F.when((named < 0.2) | ((near > 30)), 0.3).otherwise(1.0)


def candidates(listed: DataFrame, places: DataFrame) -> DataFrame:
    """``(l, p, likeness, km, same, score)`` of prepared rows within the rules' reach of each other whose names are at least
    ``LEAST`` alike, and where one has no coordinates, of those that ``_named`` gives."""
    fl, fp = cut(_forms(listed, "lat", "lon", "coarse", "d")), cut(_forms(places, "lat", "lon", "d"))
    here = fl.where("lat is not null").select(F.col("k").alias("l"), F.col("s").alias("sa"), "sense", F.col("n").alias("na"), F.col("bits").alias("ba"), F.col("lat").alias("la"), F.col("lon").alias("lo"), "coarse")
    there = fp.where("lat is not null").select(F.col("k").alias("p"), F.col("s").alias("sb"), "sense", F.col("n").alias("nb"), F.col("bits").alias("bb"), F.col("lat").alias("pa"), F.col("lon").alias("po"))
    read = here.select("*", *_cell(F.col("la"), F.col("lo"))).unionByName(here.select("*", *_cell(F.col("lo"), F.col("la"))))
    most = F.floor(F.greatest("na", "nb") * (1 - LEAST) + 1e-9)
    near = read.join(_cells(there), ["y", "x", "sense"]).where(_within(most)).where(_km() <= REACH).select("l", "p", "sa", "sb", most.alias("most")).distinct()
    near = _alike(near).select("l", "p", "likeness")
    # where one has no coordinates names alone must tell, and be likelier
    lost_l, lost_p = _named(fl.where("lat is null"), fp), _named(fl, fp.where("lat is null"))
    by_name = lost_l.unionByName(lost_p).withColumnsRenamed({"ka": "l", "kb": "p"})
    # a pair is as alike as its likest forms, all of which are among these
    pairs = near.unionByName(by_name).groupBy("l", "p").agg(F.max("likeness").alias("likeness"))
    full = pairs.join(listed.select(F.col("k").alias("l"), F.col("lat").alias("la"), F.col("lon").alias("lo"), F.col("coarse"), F.col("d").alias("da")), "l").join(places.select(F.col("k").alias("p"), F.col("lat").alias("pa"), F.col("lon").alias("po"), F.col("d").alias("db")), "p")
    same = F.when(F.col("da").isNotNull() & F.col("db").isNotNull(), F.levenshtein("da", "db") <= 2)
    rated = full.withColumn("km", _km()).withColumn("same", same)
    return rated.select("l", "p", "likeness", "km", "same", _evidence(F.col("km"), F.col("likeness"), F.col("same")).alias("score"))


def _minimise(pairs: DataFrame, alike: DataFrame) -> DataFrame:
    """``(l, p, truth)`` by alternating directions over ``pairs (l, p, score)`` and alike listed rows ``(l1, l2)``.

    A variable has three rules on itself (evidence for and against in closed form, exclusivity over its listed row) and
    one per alike row's variable of the same place. Scaled duals are kept beside the copies."""
    state = cut(pairs.select("l", "p", "score", F.col("score").alias("z"), F.lit(0.0).alias("ue"), F.lit(0.0).alias("ux")))
    same = cut(alike.join(pairs.select(F.col("l").alias("l1"), "p"), "l1").join(pairs.select(F.col("l").alias("l2"), "p"), ["l2", "p"]).select("l1", "l2", "p", F.lit(0.0).alias("u1"), F.lit(0.0).alias("u2")))
    # the sum at most 1 holds for a pair and the likelier ones of its row: of the optima, all of which share out the same
    # truth, that is the one where the likelier pair keeps it and only equal ones halve it
    row = Window.partitionBy("l").orderBy(F.round("score", 3).desc())
    for step in range(ROUNDS):
        # evidence w*max(0, score - x) and prior w0*max(0, x): both linear, so the copy moves by their slopes
        v = F.col("z") - F.col("ue")
        e = F.when(v + (EVIDENCE - PRIOR) / RHO <= F.col("score"), v + (EVIDENCE - PRIOR) / RHO).when(v - PRIOR / RHO >= F.col("score"), v - PRIOR / RHO).otherwise(F.col("score"))
        # exclusivity w*max(0, sum(x) - 1): all copies of a row move down together, as far as the sum goes beyond 1
        x = F.col("z") - F.col("ux")
        over = F.greatest(F.lit(0.0), F.sum(x).over(row) - 1.0)
        moved = state.withColumn("xe", e).withColumn("xx", x - F.least(over / F.count("*").over(row), F.lit(EXCLUSIVE / RHO)))
        a = state.select(F.col("l").alias("l1"), "p", F.col("z").alias("z1"))
        b = state.select(F.col("l").alias("l2"), "p", F.col("z").alias("z2"))
        tied = same.join(a, ["l1", "p"]).join(b, ["l2", "p"]).withColumn("v1", F.col("z1") - F.col("u1")).withColumn("v2", F.col("z2") - F.col("u2"))
        shift = F.greatest(F.lit(-ALIKE / RHO), F.least(F.lit(ALIKE / RHO), (F.col("v1") - F.col("v2")) / 2.0))
        tied = tied.withColumn("c1", F.col("v1") - shift).withColumn("c2", F.col("v2") + shift)
        copies = tied.select(F.explode(F.array(F.struct(F.col("l1").alias("l"), "p", (F.col("c1") + F.col("u1")).alias("c")), F.struct(F.col("l2").alias("l"), "p", (F.col("c2") + F.col("u2")).alias("c")))).alias("t")).select("t.*").groupBy("l", "p").agg(F.sum("c").alias("c"), F.count("*").alias("m"))
        z = (F.col("xe") + F.col("ue") + F.col("xx") + F.col("ux") + F.coalesce("c", F.lit(0.0))) / (2.0 + F.coalesce("m", F.lit(0)))
        new = moved.join(copies, ["l", "p"], "left").withColumn("zn", F.greatest(F.lit(0.0), F.least(F.lit(1.0), z)))
        new = new.select("l", "p", "score", F.col("zn").alias("z"), (F.col("ue") + F.col("xe") - F.col("zn")).alias("ue"), (F.col("ux") + F.col("xx") - F.col("zn")).alias("ux"))
        new = cut(new)
        if step < ROUNDS - 1:
            zs = new.select("l", "p", "z")
            same = cut(tied.select("l1", "l2", "p", "c1", "c2", "u1", "u2").join(zs.withColumnsRenamed({"l": "l1", "z": "y1"}), ["l1", "p"]).join(zs.withColumnsRenamed({"l": "l2", "z": "y2"}), ["l2", "p"]).select("l1", "l2", "p", (F.col("u1") + F.col("c1") - F.col("y1")).alias("u1"), (F.col("u2") + F.col("c2") - F.col("y2")).alias("u2")))
        state = new
    return state.select("l", "p", F.col("z").alias("truth"))


def match_places(listed: DataFrame, listed_key: str, places: DataFrame, place_key: str, names: str = "names", lat: str = "lat", lon: str = "lon", extra: str = "extra", least: float = 0.5) -> DataFrame:
    """``(listed_key, place_key, confidence, likeness, km)``: each listed row with the one place it means, if any.

    ``confidence`` is the pair's truth in the optimum, 0 to 1; pairs below ``least`` do not come out. Of equal truths the
    likelier names, then the smaller key, win. Both keys come out as text. Null or blank names are no names, a row
    without any matches nothing. Missing, 0/0 and NaN coordinates are unknown; exchanged ones are read either way;
    coordinates of one decimal are taken as rough. Repeated keys count once, null keys not at all. Empty tables give an
    empty result."""
    left, right = cut(_prepared(listed, listed_key, names, lat, lon, extra)), cut(_prepared(places, place_key, names, lat, lon, extra))
    pairs = cut(candidates(left, right))
    # rows alike: neighbours among one place's likely rows within a cell of a tenth of a degree, or of no coordinates
    told = pairs.where("score >= 0.4").join(left.select(F.col("k").alias("l"), "lat", "lon"), "l")
    chain = Window.partitionBy("p", F.round("lat", 1), F.round("lon", 1)).orderBy("lat", "lon", "l")
    linked = told.withColumn("l2", F.lead("l").over(chain)).withColumn("lat2", F.lead("lat").over(chain)).withColumn("lon2", F.lead("lon").over(chain)).where("l2 is not null")
    apart = kilometres(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    alike = linked.where(F.coalesce(apart <= 8, F.lit(True))).select(F.col("l").alias("l1"), "l2").distinct()
    truth = _minimise(pairs, alike)
    best = F.max_by(F.struct("p", "truth", "likeness", "km"), F.struct(F.round("truth", 6), "likeness", F.hash("p")))
    chosen = truth.join(pairs.select("l", "p", "likeness", "km"), ["l", "p"]).groupBy("l").agg(best.alias("b"))
    return chosen.where(F.col("b.truth") >= least).select(F.col("l").alias(listed_key), F.col("b.p").alias(place_key), F.round("b.truth", 6).alias("confidence"), F.round("b.likeness", 6).alias("likeness"), F.round("b.km", 3).alias("km"))
