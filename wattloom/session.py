"""Session defaults and the shared scratch location."""

from __future__ import annotations

import math
import tempfile
import uuid
from contextlib import contextmanager
from typing import Iterator

from pyspark.sql import DataFrame, SparkSession

# AQE splits skewed join partitions at run time; forcing it also covers joins whose
# output feeds another keyed stage.  RocksDB keeps streaming state off the JVM heap.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a batch of 10,000 whole texts is held several times on both sides of a Python function
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    # with it on, column functions do not share Python workers with rows made by createDataFrame from a list, so an
    # executor keeps twice as many
    "spark.sql.execution.pyspark.udf.simplifiedTraceback.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # state expires by wall clock, for which Spark would run empty micro-batches without end
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the library relies on to an existing session."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "wattloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    A bare local session names none; a temporary folder is made then and recorded in the
    session, so later calls agree on it.  On a cluster that would be a machine's own disk,
    so there the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="wattloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared scratch folder; never reused between runs."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What a query in here shuffles goes from disk when it ends, not when the driver happens to collect its garbage.

    For tables that are written: they are read from then on, so their shuffles are not needed again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder: read instead of computed again, also after a lost executor."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame, rows_per_task: int = 5_000) -> DataFrame:
    """``df`` dealt evenly over tasks of about so many rows: for small files whose rows make much work each.

    Spark cuts files by bytes, so a million narrow rows would stay in one or two tasks.
    """
    tasks = math.ceil(df.count() / rows_per_task)
    return df.repartition(tasks) if tasks > 1 else df
