"""Operators that depend on the order of rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstead.session import cut


def numbering_flags(units: DataFrame, part: str, order: str, number: str, counts: Column | None = None) -> DataFrame:
    """``restart`` where a number is below the last one, ``gap`` where it is neither that nor the next, an equal one too.

    Only units for which ``counts`` holds are compared; one without a number starts the count anew and has no flag."""
    kept = units if counts is None else units.where(counts)
    last = F.lag(number).over(Window.partitionBy(part).orderBy(order))
    return kept.withColumn("flag", F.when(F.col(number) < last, "restart").when(F.col(number) != last + 1, "gap"))


def segment(rows: DataFrame, part: str, order: str, opens: Column) -> DataFrame:
    """``unit``: how many openers have been met; 0 for the rows before the first, the front matter."""
    return rows.withColumn("unit", F.sum(F.when(opens, 1).otherwise(0)).over(Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def unit_ids(units: DataFrame, part: str, order: str) -> DataFrame:
    """``part_0001`` and so on in order."""
    n = F.row_number().over(Window.partitionBy(part).orderBy(order))
    return units.withColumn("unit_id", F.format_string("%s_%04d", F.col(part), n))


def occurrence(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def round_robin(rows: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows, taking groups in turn; inside a group by the digest of seed and key."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key))
    return rows.withColumn("turn", turn).orderBy("turn", group).limit(n)


def greedy_spans(spans: DataFrame, doc: str, start: str, end: str) -> DataFrame:
    """Spans in order of start, longer first, each kept if it begins at or after the end of the last one kept.

    The choice depends on what was chosen before: each partition is sorted by document and streamed through Python in
    Arrow batches that carry the last end along, so neither a document nor a batch has to fit more memory than a batch."""
    columns, schema = spans.columns, spans.schema

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, at = None, 0
        for pdf in batches:
            kept = []
            for i, (k, s, e) in enumerate(zip(pdf[doc], pdf[start], pdf[end])):
                if k != last or s >= at:
                    kept.append(i)
                    last, at = k, e
            yield pdf.iloc[kept][columns]

    ordered = spans.where(F.col(doc).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull()).repartition(doc).sortWithinPartitions(doc, start, F.col(end).desc())
    return ordered.mapInPandas(keep, schema)


def locate_in_order(entities: DataFrame, doc: str, order: str, needle: str, text: str) -> DataFrame:
    """``start``: each needle's place after the last one found, else from the beginning, else without case, else null."""
    schema = entities.select(doc, order, needle).schema.add("start", T.IntegerType())

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, at = None, 0
        for pdf in batches:
            out = []
            for k, n, t in zip(pdf[doc], pdf[needle], pdf[text]):
                if k != last:
                    last, at = k, 0
                spot = None
                if n and t is not None:
                    spots = (t.find(n, at), t.find(n), t.lower().find(n.lower(), at), t.lower().find(n.lower()))
                    spot = next((s for s in spots if s >= 0), None)
                at = spot + len(n) if spot is not None else at
                out.append(spot)
            yield pdf[[doc, order, needle]].assign(start=pd.array(out, dtype="Int32"))

    return entities.repartition(doc).sortWithinPartitions(doc, order).mapInPandas(find, schema)


def correction_diff(before: DataFrame, after: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``added``, ``removed``, ``reclassified`` or ``kept`` per span of either side."""
    b, a = before.select(*keys, F.col(label).alias("old_label")), after.select(*keys, F.col(label).alias("new_label"))
    return b.join(a, keys, "full").withColumn("action", F.when(F.col("old_label").isNull(), "added").when(F.col("new_label").isNull(), "removed").when(F.col("old_label") != F.col("new_label"), "reclassified").otherwise("kept"))


def numbered(rows: DataFrame, *order: Column | str, number: str = "n") -> DataFrame:
    """``rows`` with ``number`` from 1 in order: sorted by range, only the row counts of the partitions reach the driver."""
    kept = cut(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    at, starts = 0, []
    for r in kept.groupBy(F.shiftright("_m", 33).alias("p")).agg(F.count("*").alias("c")).orderBy("p").collect():
        starts.append((r["p"], at))
        at += r["c"]
    offsets = rows.sparkSession.createDataFrame(starts or [(-1, 0)], "_p bigint, _start bigint")
    return kept.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(offsets), "_p").withColumn(number, F.col("_start") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_m", "_p", "_start")


def mint_ids(rows: DataFrame, order: str, used: DataFrame, used_id: str, prefix: str) -> DataFrame:
    """``new_id``: ids after the highest used number, in order."""
    top = used.agg(F.coalesce(F.max(F.nullif(F.regexp_extract(used_id, rf"^{prefix}(\d+)$", 1), F.lit("")).cast("long")), F.lit(0)).alias("top")).first()["top"]
    return numbered(rows, order, number="_n").withColumn("new_id", F.concat(F.lit(prefix), (F.col("_n") + F.lit(top)).cast("string"))).drop("_n")


def mint_free_ids(rows: DataFrame, order: str, used: DataFrame, used_id: str, prefix: str) -> DataFrame:
    """``new_id``: the smallest free numbers, in order. Free ones are sought up to as many as rows and used ids together."""
    n = rows.count()
    taken = used.select(F.nullif(F.regexp_extract(used_id, rf"^{prefix}(\d+)$", 1), F.lit("")).cast("long").alias("_id")).where("_id is not null").distinct()
    free = rows.sparkSession.range(1, n + taken.count() + 1).withColumnRenamed("id", "_id").join(taken, "_id", "left_anti")
    given = numbered(free, "_id", number="_n").where(F.col("_n") <= n)
    return numbered(rows, order, number="_n").join(given, "_n").withColumn("new_id", F.concat(F.lit(prefix), F.col("_id").cast("string"))).drop("_n", "_id")
