"""Aggregations over items with categories and topics. Each takes tables and column names and gives a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions.numeric import share


def distribution(items: DataFrame, item: str, category: str, categories: list[str]) -> DataFrame:
    """Distinct items per category in the given order, zero-filled, with percent of the total."""
    dim = items.sparkSession.createDataFrame([(i, c) for i, c in enumerate(categories)], "ord int, category string")
    counts = items.where(F.col(category).isNotNull()).groupBy(F.col(category).alias("category")).agg(F.countDistinct(item).alias("n"))
    out = dim.join(counts, "category", "left")
    out = out.withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("pct", share(F.col("n"), F.sum("n").over(Window.partitionBy())))


def pivot_counts(items: DataFrame, group: str, category: str, item: str, categories: list[str]) -> DataFrame:
    """Distinct items per group and category, zero-filled, with row percents."""
    sums = [F.countDistinct(F.when(F.col(category) == c, F.col(item))).alias(f"n_{c}") for c in categories]
    wide = items.where(F.col(group).isNotNull()).groupBy(group).agg(*sums)
    whole = sum((F.col(f"n_{c}") for c in categories), F.lit(0))
    return wide.select("*", *[share(F.col(f"n_{c}"), whole).alias(f"pct_{c}") for c in categories])


def topic_sides(items: DataFrame, topic: str, item: str, yes: Column) -> DataFrame:
    """Distinct items per topic on either side of a condition."""
    return items.where(F.col(topic).isNotNull()).groupBy(topic).agg(F.countDistinct(F.when(yes, F.col(item))).alias("a"), F.countDistinct(F.when(~yes, F.col(item))).alias("b"))


def topic_difference(items: DataFrame, topic: str, item: str, yes: Column, keep: int) -> DataFrame:
    """The ``keep`` topics with the largest and with the smallest difference a - b; all where there are no more."""
    d = topic_sides(items, topic, item, yes).withColumn("difference", F.col("a") - F.col("b"))
    d = d.select(topic, "a", "b", "difference")
    return d.orderBy(F.col("difference").desc(), topic).limit(keep).union(d.orderBy("difference", F.col(topic).desc()).limit(keep)).distinct()


def rate_per_thousand(items: DataFrame, topic: str, item: str, yes: Column, words: DataFrame, least: int) -> DataFrame:
    """Difference of items per thousand words; ``words (a_words, b_words)`` is one row."""
    sides = topic_sides(items, topic, item, yes).where(F.col("a") + F.col("b") >= least)
    return sides.crossJoin(F.broadcast(words)).select(topic, "a", "b", F.round(1000.0 * F.col("a") / F.col("a_words") - 1000.0 * F.col("b") / F.col("b_words"), 6).alias("rate_difference"))


def relative_frequency(items: DataFrame, topic: str, item: str, yes: Column, least: int) -> DataFrame:
    """Share of a topic's items on the first side, for topics of enough items."""
    return topic_sides(items, topic, item, yes).where(F.col("a") + F.col("b") >= least).withColumn("share", F.round(F.col("a") / (F.col("a") + F.col("b")), 6))


def funnel(items: DataFrame, item: str, tier: str, present: list[str], agents: list[str]) -> DataFrame:
    """All, present and active items with their ratios."""
    n = lambda values: F.countDistinct(F.when(F.col(tier).isin(*values), F.col(item)))
    return items.agg(F.countDistinct(item).alias("total"), n(present).alias("present"), n(agents).alias("agents")).select("*", F.round(F.try_divide(F.col("present"), F.col("total")), 6).alias("present_share"), F.round(F.try_divide(F.col("agents"), F.col("present")), 6).alias("agent_share"))


def inventory(tags: DataFrame, tag: str, item: str, edition: str, top: int = 5) -> DataFrame:
    """Per tag: items, editions and the tags it stands with most often, as ``tag(n)`` in order.

    A tag counts once an item. Pairs are counted within items, so an item of many tags costs their square."""
    once = tags.select(F.col(tag).alias("tag"), F.col(item).alias("item"), F.col(edition).alias("edition")).where("tag is not null").distinct()
    freq = once.groupBy("tag").agg(F.countDistinct("item").alias("n"), F.countDistinct("edition").alias("editions"))
    one = once.select("tag", "item").distinct()
    pairs = one.join(one.withColumnRenamed("tag", "other"), "item").where("tag <> other").groupBy("tag", "other").agg(F.count("*").alias("c"))
    best = pairs.withColumn("r", F.row_number().over(Window.partitionBy("tag").orderBy(F.col("c").desc(), "other"))).where(F.col("r") <= top)
    named = best.groupBy("tag").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "other", "c"))), lambda x: F.concat(x["other"], F.lit("("), x["c"].cast("string"), F.lit(")"))), ", ").alias("cooccurring"))
    return freq.join(named, "tag", "left").select("tag", "n", "editions", F.coalesce("cooccurring", F.lit("")).alias("cooccurring"))


def token_ratio(tokens: DataFrame, word: str, yes: Column, least: int) -> DataFrame:
    """(count/total + 1e-6) on one side over the same on the other, by tokens."""
    c = tokens.groupBy(word).agg(F.count_if(yes).alias("w"), F.count_if(~yes).alias("v"))
    totals = tokens.agg(F.count_if(yes).alias("wt"), F.count_if(~yes).alias("vt"))
    return c.where(F.col("w") >= least).crossJoin(F.broadcast(totals)).select(word, "w", "v", F.round((F.col("w") / F.col("wt") + 1e-6) / (F.col("v") / F.col("vt") + 1e-6), 6).alias("ratio"))


def document_prevalence(tokens: DataFrame, word: str, item: str, yes: Column, docs: DataFrame, least: int, top: int) -> DataFrame:
    """(documents with / all) over ((documents without + .5) / all without); ``docs (yes_n, no_n)`` is one row."""
    c = tokens.groupBy(word).agg(F.countDistinct(F.when(yes, F.col(item))).alias("w"), F.countDistinct(F.when(~yes, F.col(item))).alias("v"))
    r = c.where(F.col("w") >= least).crossJoin(F.broadcast(docs)).select(word, "w", "v", F.round((F.col("w") / F.col("yes_n")) / ((F.col("v") + 0.5) / F.col("no_n")), 6).alias("ratio"))
    return r.orderBy(F.col("ratio").desc(), word).limit(top)


def expected_counts(items: DataFrame, row: str, column: str) -> DataFrame:
    """Observed and expected cells of a contingency table with each cell's part of chi-square."""
    seen = items.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count("*").alias("observed"))
    rows, columns = seen.groupBy(row).agg(F.sum("observed").alias("_in_row")), seen.groupBy(column).agg(F.sum("observed").alias("_in_column"))
    cells = rows.crossJoin(F.broadcast(columns)).join(seen, [row, column], "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    t = F.sum("observed").over(Window.partitionBy())
    return cells.withColumn("expected", F.col("_in_row") * F.col("_in_column") / t).select(row, column, "observed", F.round("expected", 6).alias("expected"), F.round(F.pow(F.col("observed") - F.col("expected"), 2) / F.col("expected"), 6).alias("part"))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Confusion counts of two tri-state answers and the accuracy over rows that have both."""
    return rows.agg(*[F.count_if((F.col(a) == x) & (F.col(b) == y)).alias(n) for n, x, y in (("both", True, True), ("only_a", True, False), ("only_b", False, True), ("neither", False, False))], F.count_if(F.col(a).isNull() | F.col(b).isNull()).alias("open")).withColumn("accuracy", F.round(F.try_divide(F.col("both") + F.col("neither"), F.col("both") + F.col("neither") + F.col("only_a") + F.col("only_b")), 6))


def edge_weights(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs per unordered couple of different groups."""
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).groupBy(F.least(a, b).alias("left_group"), F.greatest(a, b).alias("right_group")).agg(F.count("*").alias("weight"))


def threshold_sweep(pairs: DataFrame, sim: str, a: str, b: str, cuts: list[float]) -> DataFrame:
    """Pairs at or above each threshold, all and across groups; one pass over the pairs."""
    one = pairs.agg(*[F.count_if(F.col(sim) >= c).alias(f"all_{i}") for i, c in enumerate(cuts)], *[F.count_if((F.col(sim) >= c) & (F.col(a) != F.col(b))).alias(f"cross_{i}") for i, c in enumerate(cuts)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("threshold"), F.col(f"all_{i}").alias("all_pairs"), F.col(f"cross_{i}").alias("cross_pairs")) for i, c in enumerate(cuts)])).alias("s")).select("s.*")


def shared_values(entities: DataFrame, entity: str, values: str) -> DataFrame:
    """Identifier values that several entities hold; ``values`` maps kinds to values."""
    held = entities.select(F.col(entity).alias("entity"), F.explode(values).alias("kind", "value")).where("value is not null and value <> ''")
    return held.groupBy("kind", "value").agg(F.countDistinct("entity").alias("n"), F.array_join(F.sort_array(F.collect_set("entity")), ", ").alias("entities")).where("n > 1")


def cells_of_three(items: DataFrame, flags: list[str]) -> DataFrame:
    """Rows per combination of flags, as a bit mask."""
    return items.groupBy(sum((F.coalesce(F.col(f), F.lit(False)).cast("int") * (1 << i) for i, f in enumerate(flags)), F.lit(0)).alias("mask")).agg(F.count("*").alias("n"))


def dominant(items: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A key's most frequent value, the first met of equal ones."""
    c = items.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return c.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))
