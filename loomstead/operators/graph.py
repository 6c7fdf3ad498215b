"""Graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.session import cut


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` with the smallest node of each component, by alternating large-star and small-star.

    A large star links a node's larger neighbours to its smallest one, a small star the smaller ones; both keep the
    components, and the edge set ends as one star a component after a number of rounds logarithmic in the nodes. Edges
    with a null end are left out; a node whose only edge is to itself comes out alone."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = cut(e.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    e = cut(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, state = None, ()
    while state != before:
        before = state
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return nodes.join(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def rename_closure(rules: DataFrame, old: str, new: str, drop: str = "DROP") -> DataFrame:
    """Each name with the end of its chain of renames; a chain that reaches ``drop`` drops, a cycle stops at the name that would repeat.

    Of several rules for one name that of the smallest new name holds. It takes a round a link of the longest chain."""
    base = rules.select(F.col(old).alias("name"), F.col(new).alias("target")).groupBy("name").agg(F.min("target").alias("target"))
    step = base.select("name", "target", F.array("name").alias("seen"))
    while True:
        nxt = step.join(base.select(F.col("name").alias("target"), F.col("target").alias("next")), "target", "left")
        go = F.col("next").isNotNull() & ~F.array_contains("seen", F.col("next")) & (F.col("target") != drop)
        moved = cut(nxt.select("name", F.when(go, F.col("next")).otherwise(F.col("target")).alias("target"), F.when(go, F.array_append("seen", F.col("target"))).otherwise(F.col("seen")).alias("seen"), F.coalesce(go, F.lit(False)).alias("moved")))
        step = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return step.select("name", "target")
