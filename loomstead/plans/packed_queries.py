"""Queries on cells that hold several values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.operators.packed import unpack, whole_number
from loomstead.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of ``members``, ``kima`` and ``dbid`` cells with their position; see :func:`unpack`."""
    sources = [("story_clusters", "cluster_id", "members"), ("place_csv", "csv_row", "kima"), ("edition_metadata", "edition_no", "dbid")]
    cells = None
    for name, key, cell in sources:
        part = table(spark, sf_dir, name).select(F.lit(cell).alias("field"), F.col(key).cast("bigint").alias("key"), F.col(cell).alias("cell"))
        cells = part if cells is None else cells.unionByName(part)
    return unpack(cells, "key", "cell", F.col("field")).withColumn("item_value", F.when(F.col("field_name") == "dbid", whole_number(F.col("item_value"))).otherwise(F.col("item_value")))


QUERIES = {"p5_found": p5_found}
ORACLE: dict[str, str] = {}
