"""The verdict log as a stream: appended files in, a keyed table out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomstead.operators.sets import first_by_rank
from loomstead.sources.tables import upsert_table

SCHEMA = "story_id string, tag string, prompt_hash string, model string, applies string, confidence string, reasoning string, ts timestamp"
KEYS = ["story_id", "tag", "prompt_hash", "model"]


def verdict_stream(spark: SparkSession, path: str) -> DataFrame:
    """New rows of a folder of JSON lines, however late: the table they go to keeps the latest of a key by itself."""
    return spark.readStream.schema(SCHEMA).json(path)


def keep_latest(stream: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Upsert each batch's latest row per key into a parquet table, then stop when all files are read.

    A row older than the one kept changes nothing, so late rows and batches that run twice do no harm."""
    def merge(batch: DataFrame, _: int) -> None:
        upsert_table(batch.sparkSession, table_path, first_by_rank(batch, KEYS, F.col("ts").desc_nulls_last(), F.col("applies")), KEYS, latest="ts")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
