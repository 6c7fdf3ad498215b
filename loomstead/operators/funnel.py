"""Tag audit: candidates by similarity to a tag's centre, control samples, and verdicts behind an injectable model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions.numeric import dot, unit
from loomstead.operators.linkage import centroids
from loomstead.operators.sets import first_by_rank


def audit_funnel(vectors: DataFrame, key: str, vector: str, tags: DataFrame, tag: str, cap: int = 60, control: int = 10, seed: int = 0) -> DataFrame:
    """``(tag, key, role, sim)`` for all tags at once: role ``candidate``, ``false_positive`` or ``control``.

    A tag's centre is the mean of its positives' unit vectors. Untagged items at or above the 40th percentile of the
    positives' similarities are candidates, the ``cap`` likeliest kept; positives below the 10th percentile may be
    false; ``control`` of the other untagged items, by digest, probe what the funnel misses. The centres of a taxonomy
    are few and are joined to every item; items are never joined to items."""
    v = vectors.select(F.col(key).alias("k"), unit(F.col(vector)).alias("v")).where("v is not null")
    held = tags.select(F.col(tag).alias("tag"), F.col(key).alias("k")).where("tag is not null").distinct()
    centre = centroids(held.join(v, "k"), "tag", "v")
    sims = v.crossJoin(F.broadcast(centre)).select("tag", "k", F.round(dot(F.col("v"), F.col("centroid")), 6).alias("sim"))
    marked = sims.join(held.withColumn("positive", F.lit(True)), ["tag", "k"], "left").withColumn("positive", F.coalesce("positive", F.lit(False)))
    cuts = marked.where("positive").groupBy("tag").agg(F.percentile("sim", F.array(F.lit(0.1), F.lit(0.4))).alias("q"))
    judged = marked.join(F.broadcast(cuts), "tag").withColumn("role", F.when(F.col("positive") & (F.col("sim") < F.col("q")[0]), "false_positive").when(~F.col("positive") & (F.col("sim") >= F.col("q")[1]), "candidate").when(~F.col("positive"), "control"))
    order = F.when(F.col("role") == "control", F.md5(F.concat(F.lit(f"{seed}:"), F.col("tag").cast("string"), F.lit(":"), F.col("k").cast("string")))).otherwise(F.lit(""))
    ranked = judged.where("role is not null").withColumn("r", F.row_number().over(Window.partitionBy("tag", "role").orderBy(order, F.col("sim").desc(), "k")))
    most = F.when(F.col("role") == "candidate", cap).when(F.col("role") == "control", control)
    return ranked.where(most.isNull() | (F.col("r") <= most)).select("tag", F.col("k").alias(key), "role", "sim")


def recall_flags(funnel: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Per tag: candidates, confirmed ones, controls, controls that apply, and their share (two digits, half even)."""
    j = funnel.join(verdicts.select("tag", key, "applies"), ["tag", key], "left")
    count = lambda c: F.count_if(c)
    out = j.groupBy("tag").agg(count(F.col("role") == "candidate").alias("n_candidates"), count((F.col("role") == "candidate") & F.col("applies")).alias("n_confirmed"), count(F.col("role") == "control").alias("control_n"), count((F.col("role") == "control") & F.col("applies")).alias("control_yes"))
    return out.withColumn("recall_flag", F.bround(F.try_divide(F.col("control_yes"), F.col("control_n")), 2))


def cached(requests: DataFrame, verdicts: DataFrame, keys: list[str], models: list[str]) -> tuple[DataFrame, DataFrame]:
    """Requests with the verdict of the first model listed that has one (the latest of it), and those without any."""
    rank = F.coalesce(*[F.when(F.col("model") == m, F.lit(i)) for i, m in enumerate(models)])
    best = first_by_rank(verdicts.where(rank.isNotNull()).withColumn("_m", rank), keys, F.col("_m"), F.col("ts").desc_nulls_last()).drop("_m")
    return requests.join(best, keys), requests.join(best.select(*keys), keys, "left_anti")


def ask(requests: DataFrame, prompt: str, client: Callable[[str], str], model: str, retries: int = 2, most_errors: int = 12) -> DataFrame:
    """``requests`` with ``model``, ``reply`` and ``error`` from a client that ships to the tasks.

    A call is tried again ``retries`` times; after ``most_errors`` failed requests in a row a task asks no more and
    marks the rest. Failed rows have a null reply, so that they are asked again next time and never cached."""
    schema = requests.select("*", F.lit("").alias("model"), F.lit("").alias("reply"), F.lit("").alias("error")).schema
    for f in schema.fields:
        f.nullable = True

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = 0
        for batch in batches:
            replies, errors = [], []
            for text in batch[prompt]:
                reply, error = None, "stopped" if failed >= most_errors else None
                for _ in range(0 if error else retries + 1):
                    try:
                        reply, error = client(text), None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = str(e)
                failed = failed + 1 if error else 0
                replies.append(reply)
                errors.append(error)
            yield batch.assign(model=model, reply=replies, error=errors)

    return requests.mapInPandas(run, schema)


def retained(before: DataFrame, after: DataFrame, doc: str, most_removed: float) -> DataFrame:
    """Per document the corrected rows, or the rows before where a correction removed more than the given share."""
    n, m = before.groupBy(doc).agg(F.count("*").alias("n")), after.groupBy(doc).agg(F.count("*").alias("m"))
    lost = n.join(m, doc, "left").where((F.col("n") - F.coalesce("m", F.lit(0))) > F.col("n") * most_removed).select(doc)
    return after.join(lost, doc, "left_anti").unionByName(before.join(lost, doc, "left_semi"))
