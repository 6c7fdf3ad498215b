"""Set algebra on pairs with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def surviving(inserts: list[DataFrame], removals: list[DataFrame]) -> DataFrame:
    """Union of the inserts without any removal, distinct. Nulls compare equal, as in SQL sets."""
    def all_of(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    kept = all_of(inserts).distinct()
    return kept.subtract(all_of(removals)) if removals else kept


def original(present: DataFrame, old: DataFrame, added: DataFrame) -> DataFrame:
    """What stands there and came neither from an old run nor from an addition."""
    return present.subtract(old).subtract(added.intersect(present))


def guard(removals: DataFrame, protected: DataFrame) -> None:
    """Raises if anything protected would be removed."""
    hit = removals.intersect(protected).limit(1).collect()
    if hit:
        raise ValueError(f"would remove a protected pair: {hit[0].asDict()}")


def reconcile(direct: DataFrame, propagated: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs to add with their source: direct ones, and propagated ones neither present nor direct."""
    d = direct.select(*keys).distinct().join(present, keys, "left_anti").withColumn("source", F.lit("direct"))
    p = propagated.select(*keys).distinct().join(present, keys, "left_anti").join(direct, keys, "left_anti").withColumn("source", F.lit("propagated"))
    return d.unionByName(p)


def removals(old: DataFrame, confirmed: DataFrame, rejected: DataFrame, asked: DataFrame, categories: list[str]) -> DataFrame:
    """Old insertions ``(story_id, tag, source, source_story)`` of some categories to take out, with the reason.

    A direct one goes where it was rejected or is no longer asked for, a propagated one where the story it came from was
    rejected or is neither confirmed nor asked for. Confirmed pairs stay. The other tables hold ``(story_id, tag)``."""
    def held(t: DataFrame, flag: str, story: str = "story_id") -> DataFrame:
        return t.select(F.col("story_id").alias(story), "tag").distinct().withColumn(flag, F.lit(True))

    j = old.where(F.split("tag", ":")[0].isin(categories)).join(confirmed.select("story_id", "tag"), ["story_id", "tag"], "left_anti")
    j = j.join(held(rejected, "own_no"), ["story_id", "tag"], "left").join(held(asked, "own_asked"), ["story_id", "tag"], "left")
    for t, flag in ((rejected, "src_no"), (confirmed, "src_yes"), (asked, "src_asked")):
        j = j.join(held(t, flag, "source_story"), ["source_story", "tag"], "left")
    direct = F.col("source") == "direct"
    reason = F.when(direct & F.col("own_no"), "direct: rejected").when(direct & F.col("own_asked").isNull(), "direct: no longer a candidate").when(~direct & F.col("src_no"), "propagated: source rejected").when(~direct & F.col("src_yes").isNull() & F.col("src_asked").isNull(), "propagated: source no longer confirmed")
    return j.select("story_id", "tag", "source", "source_story", reason.alias("reason")).where("reason is not null")


def first_by_rank(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in the given full order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` win over those of the same key in ``old``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def remaining(targets: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Targets not done yet."""
    return targets.join(done.select(*keys), keys, "left_anti")


def gaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """What only one of two one-column sets holds, with the side."""
    return a.subtract(b).withColumn("side", F.lit("left")).union(b.subtract(a).withColumn("side", F.lit("right")))
