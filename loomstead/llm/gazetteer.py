"""Names typed freely, mapped to the entries of a reference list.

The list's names, and the by-names learnt for its entries, are paths of a trie. A typed form is searched by walking the
trie with its Levenshtein automaton (swaps of neighbours count as one edit), whose states are bits: one word of them for
each number of edits. A branch is left as soon as no state is alive. Of a form with ``k`` edits one half has ``k / 2`` at
most, so names are held forwards and backwards and each walk allows its first half so many only. Every entry within the
distance is returned, and the distance depends on the length. A form is also tried without a place word before it, an
attached letter, an inhabitant's ending or a district after it, and from its end if it was typed backwards; each such
reading costs a little more than none.

The list is dealt to shards of bounded size; each block of forms meets each shard in a task of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstead.llm.spelling import QUOTES, edits, plain
from loomstead.session import cut

# Words for a place before its name, letters that are written together with the next word, endings of an
# inhabitant's name, and words before a district.
PLACE_WORDS = ("ק ק", "קק", "עיר", "העיר", "כפר", "הכפר", "שטעטל", "דארפ", "עירה", "עיירה", "שטאט")
ATTACHED = "בלמדהוכש"
ENDINGS = ("ער", "אי", "סקי")
DISTRICT_WORDS = ("גליל", "מחוז", "פלכ", "ליד", "על יד")
#: Names in a shard, forms in a block, and votes that make a by-name.
SHARD, BLOCK, VOTES, MAJORITY, RATE = 50_000, 2_000, 2, 0.6, 0.25


def form(text: str | None) -> str | None:
    """The plain form that equal typings share; null for nothing but marks."""
    if text is None:
        return None
    s = re.sub(r"[^\w\s()\-,/]", " ", QUOTES.sub("", plain(text)))
    s = re.sub(r"^[\s\-,/]+|[\s\-,/]+$", "", " ".join(s.replace("_", " ").split()))
    return s or None


def allowed(n: int) -> int:
    """Edits allowed for a name of ``n`` letters."""
    return 0 if n < 4 else 1 if n < 7 else 2 if n < 13 else 3


class Trie:
    """Paths of names to entries; ``search`` gives ``{entry: edits}`` of all within a distance."""

    def __init__(self) -> None:
        self.forth: dict = {}
        self.back: dict = {}

    def add(self, name: str, entry: int) -> None:
        for node, path in ((self.forth, name), (self.back, name[::-1])):
            for c in path:
                node = node.setdefault(c, {})
            node.setdefault("", set()).add(entry)

    def search(self, name: str, most: int) -> dict[int, int]:
        found: dict[int, int] = {}
        half = len(name) // 2
        _walk(self.forth, name, most, half, most // 2, found)
        if most:
            _walk(self.back, name[::-1], most, len(name) - half, (most - 1) // 2, found)
        return found


def _walk(root: dict, name: str, most: int, half: int, early: int, found: dict[int, int]) -> None:
    """All entries within ``most`` edits with ``early`` of them at most in the first ``half`` letters.

    Bit ``i`` of state ``j`` stands for ``i`` letters of the name met with ``j`` edits at most."""
    n = len(name)
    goal, every, late = 1 << n, (2 << n) - 1, ((2 << n) - 1) & ~((1 << half) - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(name):
        at[c] = at.get(c, 0) | 2 << i
    keep = [every if j <= early else late for j in range(most + 1)]
    first = [((2 << j) - 1) & keep[j] for j in range(most + 1)]
    stack = [(root, first, None, "")]
    while stack:
        node, now, before, last = stack.pop()
        if "" in node:
            for j in range(most + 1):
                if now[j] & goal:
                    for entry in node[""]:
                        if found.get(entry, 99) > j:
                            found[entry] = j
                    break
        for c, child in node.items():
            if c == "":
                continue
            here = at.get(c, 0)
            state = [(now[0] << 1) & here & keep[0]]
            for j in range(1, most + 1):
                x = ((now[j] << 1) & here) | now[j - 1] | (now[j - 1] << 1) | (state[j - 1] << 1)
                if before is not None:
                    x |= (before[j - 1] << 2) & (here << 1) & at.get(last, 0)
                state.append(x & keep[j])
            if any(state):
                stack.append((child, state, now, c))


def _entry_names(full: str | None) -> tuple[str | None, str | None]:
    """A name and its district from ``name (district)``."""
    if full is None:
        return None, None
    m = re.fullmatch(r"\s*(.*?)\s*(?:\(([^()]*)\))?\s*", full)
    name, district = form(m.group(1)), form(m.group(2))
    return (name.replace(" ", "").replace("-", "") if name else None), district


def readings(typed: str, districts: Trie, names: list[str]) -> Iterator[tuple[str, str | None, float, bool]]:
    """``(letters, district, cost, typed backwards)``: what a form may stand for. ``districts`` leads to places in ``names``."""
    district, rest = None, typed
    m = re.fullmatch(r"(.+?)\s*[(,/\-]+\s*([^(),/]+?)\)*", typed) or re.fullmatch(r"(.+?)\s+(\S+)", typed)
    if m:
        tail = m.group(2).strip()
        for w in DISTRICT_WORDS:
            tail = re.sub(rf"^{w}\s+", "", tail)
        near = districts.search(tail, 1 if len(tail) > 4 else 0) or districts.search(tail[1:], 0)
        if near:
            district, rest = names[min(near, key=lambda e: (near[e], names[e]))], m.group(1)
            for w in DISTRICT_WORDS:
                rest = re.sub(rf"\s+{w}$", "", rest)
    heads = [(rest, 0.0)]
    for w in PLACE_WORDS:
        if rest.startswith(w + " "):
            heads.append((rest[len(w) + 1 :], 0.0))
    for head, cost in heads:
        letters = re.sub(r"[\s\-(),/]", "", head)
        yield letters, district, cost, False
        if len(letters) > 4 and letters[0] in ATTACHED:
            yield letters[1:], district, cost + 0.3, False
        for e in ENDINGS:
            if letters.endswith(e) and len(letters) > len(e) + 4:
                yield letters[: -len(e)], district, cost + 0.4, False
        if len(letters) > 4:
            yield letters[::-1], district, cost + 0.5, True


class Shard:
    """The trie of some entries ``(entry, name, district)``."""

    def __init__(self, rows) -> None:
        self.names, self.of = Trie(), {}
        for entry, name, district in rows:
            if name:
                self.names.add(name, entry)
                self.of.setdefault(entry, district)
        self.districts = sorted({d for d in self.of.values() if d})
        self.by_district = Trie()
        for i, d in enumerate(self.districts):
            self.by_district.add(d, i)

    def near(self, typed: str) -> dict[int, float]:
        """The entries within a form's distance in any reading, with their lowest cost: edits, the reading's, 1.5 for
        another district than the one that was typed."""
        cost_of: dict[int, float] = {}
        for letters, district, cost, backwards in dict.fromkeys(readings(typed, self.by_district, self.districts)):
            for entry, d in self.names.search(letters, min(allowed(len(letters)), 1 if backwards else 9)).items():
                wrong = 1.5 if district and self.of[entry] and self.of[entry] != district else 0.0
                cost_of[entry] = min(cost_of.get(entry, 99.0), d + cost + wrong)
        return cost_of


def entries_near(forms: DataFrame, entries: DataFrame) -> DataFrame:
    """``(form, entry, cost)`` of every entry ``(e, name, district)`` within the distance of a distinct ``form``."""
    n_forms, n_names = forms.count(), entries.count()
    shards, blocks = max(1, -(-n_names // SHARD)), max(1, -(-n_forms // BLOCK))
    tasks = min(shards * blocks, 4096)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = forms.select("form", F.pmod(F.xxhash64("form"), F.lit(blocks)).cast("int").alias("block"), each(shards).alias("shard")).repartition(tasks, "shard", "block")
    right = entries.select("e", "name", "district", F.pmod(F.xxhash64("e", "name"), F.lit(shards)).cast("int").alias("shard"), each(blocks).alias("block")).repartition(tasks, "shard", "block")

    def search(typed: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(zip(listed["e"].tolist(), listed["name"].tolist(), listed["district"].tolist()))
        rows = [(f, e, c) for f in typed["form"] for e, c in shard.near(f).items()]
        return pd.DataFrame(rows, columns=["form", "entry", "cost"])

    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, "form string, entry bigint, cost double")


def _cheapest(near: DataFrame, how: str) -> DataFrame:
    """``(form, entries, cost, how)``: the entries of a form's lowest cost."""
    low = near.groupBy("form").agg(F.min("cost").alias("low"))
    same = near.join(low, "form").where(F.col("cost") <= F.col("low"))
    return same.groupBy("form").agg(F.sort_array(F.collect_set("entry")).alias("entries"), F.min("low").alias("cost")).withColumn("how", F.lit(how))


@F.pandas_udf(T.StringType())
def _form(texts: pd.Series) -> pd.Series:
    return texts.map(form)


def link(typed: DataFrame, name: str, given: str, reference: DataFrame, entry_id: str, entry_names: list[str]) -> DataFrame:
    """``typed`` with ``entry_id`` (-1: none), ``cost`` and ``how`` added; its other columns stay.

    Rows of a null name come out with -1. ``given`` is a column with an entry an earlier run chose, often null and
    sometimes wrong: it decides between entries of one name, and where several rows of a form that is near no name give
    one entry, the form is taken for a by-name of it. By-names are paths of a trie, searched like names by the forms that
    are near none. Of entries that are still equal, that given most often with the form wins, then the smallest. Forms
    are searched once however often they are typed. Reference rows without an id are left out, repeated ones count once;
    with an empty list all is -1."""
    listed = None
    for c in entry_names:
        one = reference.select(F.col(entry_id).cast("bigint").alias("e"), F.col(c).cast("string").alias("full"))
        listed = one if listed is None else listed.unionByName(one)

    @F.pandas_udf("struct<name string, district string>")
    def split(full: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_entry_names(f) for f in full], columns=["name", "district"])

    entries = cut(listed.where("e is not null").distinct().select("e", split("full").alias("s")).select("e", "s.name", "s.district"))
    rows = cut(typed.withColumn("__form", _form(F.col(name).cast("string"))).withColumn("__given", F.col(given).cast("bigint")))
    votes = cut(rows.where("__form is not null").groupBy(F.col("__form").alias("form"), F.col("__given").alias("e")).agg(F.count("*").alias("n")))
    voted = F.col("e").isNotNull()
    totals = votes.groupBy("form").agg(F.sum("n").alias("rows"), F.sum(F.when(voted, F.col("n")).otherwise(0)).alias("votes"), F.max_by("e", F.when(voted, F.struct(F.col("n"), -F.col("e")))).alias("top"), F.max(F.when(voted, F.col("n")).otherwise(0)).alias("top_n"))
    near = cut(entries_near(totals.select("form"), entries))
    far = cut(totals.join(near.select("form"), "form", "left_anti"))
    learnt = far.where((F.col("top_n") >= VOTES) & (F.col("top_n") >= MAJORITY * F.col("votes")) & (F.col("top_n") >= RATE * F.col("rows"))).join(entries.select(F.col("e").alias("top")).distinct(), "top", "left_semi")
    by_names = cut(learnt.select(F.col("top").alias("e"), F.regexp_replace("form", r"[\s\-(),/]", "").alias("name"), F.lit(None).cast("string").alias("district")))
    hits = cut(_cheapest(near, "name").unionByName(_cheapest(entries_near(far.select("form"), by_names), "by-name")))
    favoured = hits.where(F.size("entries") > 1).select("form", F.explode("entries").alias("e")).join(votes, ["form", "e"], "left").groupBy("form").agg(F.max_by("e", F.struct(F.coalesce("n", F.lit(0)), -F.col("e"))).alias("favoured"))
    hits = hits.join(favoured, "form", "left").select(F.col("form").alias("__form"), "entries", F.coalesce("favoured", F.col("entries")[0]).alias("favoured"), "cost", "how")
    joined = rows.join(hits, "__form", "left")
    chosen = F.when(F.col("entries").isNull(), F.lit(-1)).when(F.array_contains("entries", F.coalesce("__given", F.lit(-1))), F.col("__given")).otherwise(F.col("favoured"))
    return joined.select(*[F.col(c) for c in typed.columns], chosen.cast("bigint").alias("entry_id"), F.col("cost").alias("entry_cost"), F.coalesce("how", F.lit("none")).alias("entry_how"))

