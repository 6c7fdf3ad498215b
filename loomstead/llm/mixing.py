"""A mix of sources with target shares: capped water-filling and seeded repetition.

Source ``s`` with ``n_s`` tokens gets ``share_s * budget`` tokens but at most ``max_repeats_s * n_s``. What a clamped
source leaves is spread over the others in proportion to their shares, and again, until nothing is above its cap. Each
text is then taken ``floor(epochs)`` times, and a seeded part of the source once more.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most sources whose few numbers each are planned on the driver.
MAX_SOURCES = 100_000
BINS = 1024


@lru_cache(maxsize=2)
def _encoding(vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def token_count(text: Column, vocabulary: str) -> Column:
    """Tokens of whole texts under a byte-level BPE vocabulary; null for null, 0 for empty."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        enc = _encoding(vocabulary)
        return texts.map(lambda t: None if t is None else len(enc.encode_ordinary(t)))

    return count(text)


def fill(sizes: dict[str, tuple[float, float, float]], budget: float) -> dict[str, float]:
    """Tokens per source from ``{source: (share, tokens, max_repeats)}``; the sum is ``budget`` where the caps allow it."""
    open_, got, left = {s for s, (w, n, r) in sizes.items() if w > 0 and n * r > 0}, dict.fromkeys(sizes, 0.0), budget
    while open_:
        weight = sum(sizes[s][0] for s in open_)
        over = {s for s in open_ if sizes[s][1] * sizes[s][2] <= left * sizes[s][0] / weight}
        if not over:
            return got | {s: left * sizes[s][0] / weight for s in open_}
        for s in over:
            got[s] = sizes[s][1] * sizes[s][2]
            left -= got[s]
        open_ -= over
    return got


def mix(docs: DataFrame, doc_id: str, text: str, source: str, targets: DataFrame, share: str, max_repeats: str, vocabulary: str | None = None, budget: float | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, source, n_tokens, repeats)`` of the drawn texts, and ``(source, target_share, actual_share, ...)``.

    The unit is a text: equal texts count once, under the smallest id that has a target source, so no text is used more
    than ``max_repeats`` times. Null or empty texts and texts of null or untargeted sources are not drawn. A target with
    a null share or cap counts as 0; a source without texts has an actual share of 0; a target listed twice keeps its
    largest share. ``budget`` is the size of the mix in tokens (default: all tokens of targeted sources). A drawn
    source's size is within one text of its plan. Empty tables give an empty mix."""
    spark = docs.sparkSession
    goal = targets.select(F.col(source).cast("string").alias("source"), F.coalesce(F.col(share).cast("double"), F.lit(0.0)).alias("share"), F.coalesce(F.col(max_repeats).cast("double"), F.lit(0.0)).alias("cap")).where("source is not null").groupBy("source").agg(F.max("share").alias("share"), F.max("cap").alias("cap"))
    units = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source")).where("length(text) > 0").join(goal.select("source"), "source", "left_semi")
    digest = units.select("doc_id", "source", F.struct(F.xxhash64("text"), F.md5("text")).alias("h"))
    first = digest.groupBy("h").agg(F.min(F.struct("doc_id", "source")).alias("one")).select("one.doc_id", "one.source")
    counted = units.join(first, ["doc_id", "source"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "source", token_count(F.col("text"), vocabulary or default_vocabulary()).alias("n_tokens"), F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)).alias("draw")).persist()
    sizes = goal.join(counted.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("texts")), "source", "left").limit(MAX_SOURCES + 1).collect()
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    known = {r["source"]: (r["share"], float(r["n"] or 0), r["cap"]) for r in sizes}
    total = budget if budget is not None else sum(n for _, n, _ in known.values())
    got = fill(known, total)
    plan = [(s, w, n, r, got[s], (got[s] / n if n else 0.0)) for s, (w, n, r) in known.items()]
    planned = spark.createDataFrame(plan, "source string, target_share double, tokens double, max_repeats double, planned double, epochs double")
    drawn = counted.join(F.broadcast(planned.select("source", "tokens", "epochs")), "source").withColumn("whole", F.floor("epochs")).withColumn("bin", F.floor(F.col("draw") * BINS / F.lit(1 << 40)))
    part = (F.col("epochs") - F.floor("epochs")) * F.col("tokens")
    bins = drawn.groupBy("source", "bin").agg(F.sum("n_tokens").alias("bin_tokens"))  # at most BINS rows a source
    before = bins.withColumn("before", F.sum("bin_tokens").over(Window.partitionBy("source").orderBy("bin")) - F.col("bin_tokens"))
    placed = drawn.join(before, ["source", "bin"]).withColumn("want", part)
    inside = Window.partitionBy("source", "bin").orderBy("draw", "doc_id")
    edge = placed.where("before < want and before + bin_tokens > want").withColumn("run", F.col("before") + F.sum("n_tokens").over(inside) - F.col("n_tokens") / 2.0)
    extra = edge.select("doc_id", "source", "n_tokens", "whole", (F.col("run") <= F.col("want")).cast("int").alias("more")).unionByName(placed.where("not (before < want and before + bin_tokens > want)").select("doc_id", "source", "n_tokens", "whole", (F.col("before") < F.col("want")).cast("int").alias("more")))
    chosen = extra.select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("more")).cast("int").alias("repeats")).where("repeats > 0")
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("drawn_tokens"), F.count("*").alias("texts"), F.max("repeats").alias("most_repeats"))
    report = planned.join(used, "source", "left").select("source", "target_share", (F.coalesce("drawn_tokens", F.lit(0)) / F.sum("drawn_tokens").over(Window.partitionBy())).alias("actual_share"), F.coalesce("drawn_tokens", F.lit(0)).cast("bigint").alias("drawn_tokens"), F.coalesce("texts", F.lit(0)).cast("bigint").alias("texts"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.col("epochs"), (F.col("epochs") >= F.col("max_repeats")).alias("capped"))
    return chosen, report
