"""Dumps of current objects, and change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattloom.sources.items import read_items

EVENT_DDL = "type string, kind string, ts timestamp, object string"
DUMP_DDL = "kind string, items array<string>"


def read_dump(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(kind, object) of list dumps; a list's kind, less ``List``, stands for its items'."""
    lists = spark.read.schema(DUMP_DDL).option("multiLine", multi_line).json(path)
    kind = F.nullif(F.regexp_replace("kind", "List$", ""), F.lit(""))
    return lists.select(kind.alias("kind"), F.explode("items").alias("object"))


def read_large_dump(spark: SparkSession, path: str) -> DataFrame:
    """(kind, object) like :func:`read_dump`, for files that hold one list each: a task per split, a row per item."""
    items = read_items(spark, path, "items", 2)
    kind = F.nullif(F.regexp_replace("kind", "List$", ""), F.lit(""))
    return items.select(kind.alias("kind"), F.col("item").alias("object"))


def as_events(dump: DataFrame, ts: Column) -> DataFrame:
    """A dump in the shape of change events, so that it can lead a stream."""
    return dump.select(F.lit("ADDED").alias("type"), "kind", ts.cast("timestamp").alias("ts"), "object")


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_DDL).json(path)


def stream_changes(
    spark: SparkSession, path: str, max_files: int | None = None, nested: bool = True
) -> DataFrame:
    """Change events of all kinds from JSON files landing in a folder, in one stream.

    A snapshot written to the same folder first is simply the first micro-batch.
    """
    reader = spark.readStream.schema(EVENT_DDL).option("recursiveFileLookup", str(nested).lower())
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)
