"""Consensus of several annotators' labels by message passing between items and annotators.

For each class, against the rest, every answer is an edge between an item and an annotator. An annotator sends an item
the log-likelihood ratio of their answer under what the annotator's *other* answers say of their sensitivity and
specificity; an item sends an annotator the log-odds of the class under what the item's *other* annotators say. Both
exclude the receiver by subtracting its own part from a total, so an edge costs constant work and totals are aggregated
before they are shuffled. Messages are passed until they change by less than ``tolerance``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.session import cut

#: Spellings of an answer.
YES = ("true", "yes", "y", "1", "applies", "כן")
NO = ("false", "no", "n", "0", "does not apply", "לא")
#: Beta prior counts of right and wrong answers, weak and in favour of the annotator.
RIGHT, WRONG = 2.0, 1.0


def answer(c: Column) -> Column:
    """``yes``, ``no`` or null for an answer in any of its spellings; open and unknown answers are null."""
    plain = F.lower(F.trim(F.regexp_replace(c.cast("string"), r"[\s ‎‏.!]+", " ")))
    return F.when(plain.isin(*YES), F.lit("yes")).when(plain.isin(*NO), F.lit("no"))


def _sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def _ratio(s: Column, tp: Column, fn: Column, fp: Column, tn: Column) -> Column:
    sens, spec = (tp + RIGHT) / (tp + fn + RIGHT + WRONG), (tn + RIGHT) / (tn + fp + RIGHT + WRONG)
    return F.when(s, F.log(sens / (1.0 - spec))).otherwise(F.log((1.0 - sens) / spec))


def _counts(edges: DataFrame, by: list[str], p: Column) -> DataFrame:
    return edges.groupBy(*by).agg(
        F.sum(F.when(F.col("s"), p).otherwise(0.0)).alias("tp"),
        F.sum(F.when(F.col("s"), 0.0).otherwise(p)).alias("fn"),
        F.sum(F.when(F.col("s"), 1.0 - p).otherwise(0.0)).alias("fp"),
        F.sum(F.when(F.col("s"), 0.0).otherwise(1.0 - p)).alias("tn"),
        F.count("*").alias("answers"),
    )


def consensus(labels: DataFrame, item: list[str], annotator: str, label: str, classes: list[str], iterations: int = 20, tolerance: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``(item..., label, posterior, agreement, answers)`` and ``(annotator, class, answers, sensitivity, specificity)``.

    An item's label is the class of ``classes`` with the highest posterior, null where that is below one half (with one
    class: the class does not hold). ``agreement`` is the share of equal pairs among the item's answers, null for one
    answer. Rows with a null item part, annotator or label count for nothing; a repeated answer counts once, and of one
    annotator's different answers to an item the largest by bytes. An item without any answer does not come out; an
    empty table gives empty results. A tie of classes goes to the one listed first."""
    keys = [F.col(c).cast("string").alias(f"i{k}") for k, c in enumerate(item)]
    ids = [f"i{k}" for k in range(len(item))]
    answers = labels.select(*keys, F.col(annotator).cast("string").alias("who"), F.col(label).cast("string").alias("given")).dropna().groupBy(*ids, "who").agg(F.max("given").alias("given"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("class_no"), F.lit(c).alias("class")) for n, c in enumerate(classes)]))
    edges = answers.select("*", each.alias("c")).select(*ids, "who", "c.class_no", "c.class", (F.col("given") == F.col("c.class")).alias("s"))
    edges = cut(edges.withColumn("m", F.when(F.col("s"), 1.0).otherwise(-1.0)).withColumn("p", F.lit(0.5)))
    one, worker = [*ids, "class_no"], ["who", "class_no"]
    for _ in range(iterations):
        share = edges.groupBy("class_no").agg(F.avg(F.when(F.col("s"), 1.0).otherwise(0.0)).alias("q")).select("class_no", F.log((F.col("q") + 0.02) / (1.02 - F.col("q"))).alias("prior"))
        totals = edges.groupBy(*one).agg(F.sum("m").alias("total"))
        said = edges.join(totals, one).join(F.broadcast(share), "class_no").withColumn("q", _sigmoid(F.col("total") - F.col("m") + F.col("prior")))
        counts = _counts(said, worker, F.col("q"))
        own = {"tp": F.when(F.col("s"), F.col("q")).otherwise(0.0), "fn": F.when(F.col("s"), 0.0).otherwise(F.col("q")), "fp": F.when(F.col("s"), 1.0 - F.col("q")).otherwise(0.0), "tn": F.when(F.col("s"), 0.0).otherwise(1.0 - F.col("q"))}
        heard = said.join(counts, worker).select(*ids, "who", "class_no", "class", "s", _ratio(F.col("s"), *[F.greatest(F.col(k) - v, F.lit(0.0)) for k, v in own.items()]).alias("m"), F.col("q").alias("p"), F.abs(F.col("q") - F.col("p")).alias("moved"))
        heard = cut(heard)
        edges = heard.drop("moved")
        if (heard.agg(F.max("moved")).first()[0] or 0.0) < tolerance:
            break
    share = edges.groupBy("class_no").agg(F.avg("p").alias("q")).select("class_no", F.log((F.col("q") + 0.02) / (1.02 - F.col("q"))).alias("prior"))
    final = edges.groupBy(*one, "class").agg(F.sum("m").alias("total"), F.count("*").alias("answers"), F.sum(F.col("s").cast("int")).alias("hits")).join(F.broadcast(share), "class_no")
    final = final.withColumn("posterior", _sigmoid(F.col("total") + F.col("prior")))
    pairs = F.sum(F.col("hits") * (F.col("hits") - 1))
    if len(classes) == 1:
        pairs = F.sum(F.col("hits") * (F.col("hits") - 1) + (F.col("answers") - F.col("hits")) * (F.col("answers") - F.col("hits") - 1))
    best = F.max_by(F.struct("class", "posterior"), F.struct("posterior", -F.col("class_no")))
    n = F.max("answers")
    items = final.groupBy(*ids).agg(best.alias("best"), n.alias("answers"), F.when(n > 1, pairs / (n * (n - 1))).alias("agreement"))
    items = items.select(*[F.col(f"i{k}").alias(c) for k, c in enumerate(item)], F.when(F.col("best.posterior") > 0.5, F.col("best.class")).alias("label"), F.col("best.posterior").alias("posterior"), "agreement", "answers")
    rated = _counts(edges, [*worker, "class"], F.col("p")).select(F.col("who").alias("annotator"), "class", "answers", ((F.col("tp") + RIGHT) / (F.col("tp") + F.col("fn") + RIGHT + WRONG)).alias("sensitivity"), ((F.col("tn") + RIGHT) / (F.col("tn") + F.col("fp") + RIGHT + WRONG)).alias("specificity"))
    return items, rated
