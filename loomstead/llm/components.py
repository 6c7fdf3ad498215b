"""Groups from pairwise links by low-diameter decomposition.

One level: every vertex draws an exponential shift and starts to grow a cluster that much earlier than the last one
could; growing takes one hop a round, so a vertex falls to the centre with the largest ``shift - distance``. Clusters
become super-vertices, the edges between different clusters (deduplicated) are the next level's graph, and levels are
repeated until no edge is left. A vertex's group is found by composing the levels' assignments from the last back.

Growing is cut off after ``max_hops`` rounds. That is sound: whichever centre a vertex holds then, a path leads there,
so contracting merges only what is connected; it only leaves more to the next level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.session import cut

#: A state packs a centre's remaining shift (in 1/1024 hops) above the centre's number.
ID_BITS, HOP = 44, 1024
BLANKS = r"^[\s ‎‏﻿]+|[\s ‎‏﻿]+$"


def trimmed(c: Column) -> Column:
    """Without blanks around it; null where nothing is left."""
    return F.nullif(F.regexp_replace(c.cast("string"), BLANKS, ""), F.lit(""))


def _numbered(nodes: DataFrame) -> DataFrame:
    """Dense numbers for distinct nodes; only the row count of each partition reaches the driver."""
    kept = cut(nodes.select("node", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")))
    sizes = [(r["p"], r["n"]) for r in kept.groupBy("p").agg(F.count("*").alias("n")).orderBy("p").collect()]
    starts, at = [], 0
    for p, n in sizes:
        starts.append((p, at))
        at += n
    offsets = kept.sparkSession.createDataFrame(starts or [(-1, 0)], "p int, start bigint")
    return kept.join(F.broadcast(offsets), "p").select("node", (F.col("start") + F.col("m") % F.lit(1 << 33)).alias("v"))


def _shift(v: Column, level: int, beta: float, seed: int) -> Column:
    unit = (F.xxhash64(v, F.lit(level), F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) + 1) / F.lit(float(1 << 52))
    return F.least(F.floor(-F.log(unit) / beta * HOP), F.lit((1 << 19) - 1)).cast("bigint")


def _decompose(arcs: DataFrame, level: int, beta: float, max_hops: int, seed: int, hub: int) -> DataFrame:
    """``(v, centre)`` for every vertex of the symmetric ``arcs (u, v)``.

    A vertex with more than ``hub`` arcs sends through several salted copies, so none of them fills one task."""
    degrees = arcs.groupBy("u").agg(F.count("*").alias("d"))
    state = cut(degrees.select(F.col("u").alias("v"), (_shift(F.col("u"), level, beta, seed) * F.lit(1 << ID_BITS) + F.col("u")).alias("key"), F.ceil(F.col("d") / hub).cast("int").alias("copies"), F.lit(True).alias("fresh")))
    copies = state.where("copies > 1").select(F.col("v").alias("u"), "copies")
    salted = arcs.join(copies, "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), F.coalesce("copies", F.lit(1))).cast("int").alias("salt"))
    salted = cut(salted.repartition("u", "salt"))
    step = F.lit(HOP << ID_BITS)
    for hop in range(1, max_hops + 1):
        sending = state.where(F.col("fresh") & (F.col("key") >= step)).select(F.col("v").alias("u"), (F.col("key") - step).alias("sent"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
        reached = salted.join(sending, ["u", "salt"]).groupBy("v").agg(F.max("sent").alias("sent"))
        state = state.join(reached, "v", "left").select("v", F.greatest("key", "sent").alias("key"), "copies", (F.coalesce("sent", F.lit(-1)) > F.col("key")).alias("fresh"))
        if hop % 3 == 0 or hop == max_hops:  # three hops share a written table
            state = cut(state)
            if state.where("fresh").isEmpty():
                break
    return state.select("v", F.col("key").bitwiseAND(F.lit((1 << ID_BITS) - 1)).alias("centre"))


def components(pairs: DataFrame, left: str, right: str, nodes: DataFrame | None = None, node: str = "node", beta: float = 0.03, max_hops: int = 12, seed: int = 17, hub: int = 100_000) -> DataFrame:
    """``(node, group_node)``: each node with the smallest node, by bytes, of all nodes linked to it directly or not.

    Nodes are strings, trimmed; those of ``nodes`` that no pair names are groups of their own. A pair with a null or
    blank side links nothing and names nothing; a pair of one node with itself names it. Order and repetition of pairs
    and other columns have no influence; without any node the result is empty. ``beta`` is the rate of the shifts
    (smaller: larger clusters, more rounds), ``hub`` the number of links above which a node's messages are spread."""
    links = pairs.select(trimmed(F.col(left)).alias("a"), trimmed(F.col(right)).alias("b")).where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    named = links.select(F.explode(F.array("a", "b")).alias("node"))
    if nodes is not None:
        named = named.unionByName(nodes.select(trimmed(F.col(node)).alias("node")).where("node is not null"))
    numbers = _numbered(named.distinct())
    edges = links.where("a <> b").join(numbers.select(F.col("node").alias("a"), F.col("v").alias("x")), "a").join(numbers.select(F.col("node").alias("b"), F.col("v").alias("y")), "b").select("x", "y")
    edges = cut(edges)
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        arcs = edges.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(edges.select(F.col("y").alias("u"), F.col("x").alias("v")))
        centres = _decompose(arcs, len(levels), beta, max_hops, seed, hub)
        levels.append(centres)
        moved = edges.join(centres.select(F.col("v").alias("x"), F.col("centre").alias("cx")), "x").join(centres.select(F.col("v").alias("y"), F.col("centre").alias("cy")), "y").where("cx <> cy")
        edges = cut(moved.select(F.least("cx", "cy").alias("x"), F.greatest("cx", "cy").alias("y")).distinct())
    if not levels:
        return numbers.select("node", F.col("node").alias("group_node"))
    root = levels.pop()
    while levels:
        lower = levels.pop()
        root = lower.join(root.select(F.col("v").alias("centre"), F.col("centre").alias("top")), "centre", "left").select("v", F.coalesce("top", "centre").alias("centre"))
    rooted = cut(numbers.join(root, "v", "left").select("node", F.coalesce("centre", "v").alias("root")))
    return rooted.join(rooted.groupBy("root").agg(F.min("node").alias("group_node")), "root").select("node", "group_node")
