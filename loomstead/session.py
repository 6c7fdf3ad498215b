"""Session helpers: table access and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "loomstead", cpus: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The session's shared ``spark.checkpoint.dir``; a private folder only where none is set."""
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="loomstead-")
    sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


#: Written tables between two collections of the driver's garbage.
GC_EVERY = 6
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cuts = itertools.count(1)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, with no lineage.

    The files lie on storage that all executors share, so a lost executor costs a re-read, not a re-run. A table is
    written rather than ``checkpoint()`` called, as the latter hands its plan's constraints and partitionings on to
    the next plan: in a loop they grow until planning takes minutes."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")  # the shuffles behind the table go when it is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    if next(_cuts) % GC_EVERY == 0:
        # broadcasts and plans of finished steps are freed when the driver collects its garbage, which an idle heap puts off
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def sized_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """A written table marked for broadcast if it has at most ``rows`` rows; else as it is, to be joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
