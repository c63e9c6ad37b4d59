"""A running number over a whole table, without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattloom.session import scratch_path


def with_rank(df: DataFrame, *order: Column | str, out: str = "rank", name: str = "ranked") -> DataFrame:
    """Add ``out``, the row's number from 0 in ``order`` (which should make rows distinct).

    Rows are dealt by range and sorted where they are; only the number of rows before each partition is global.
    The sorted table is written to the shared folder, so the numbers cannot change between reads.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    dealt.withColumn("__part", F.shiftright(place, 33)).withColumn(
        "__at", place.bitwiseAND(F.lit((1 << 33) - 1))
    ).write.parquet(path)
    ranked = spark.read.parquet(path)
    before, offsets = 0, []
    for part, rows in sorted(tuple(r) for r in ranked.groupBy("__part").count().collect()):  # a row per task
        offsets.append((part, before))
        before += rows
    table = spark.createDataFrame(offsets, "__part long, __before long")
    return (
        ranked.join(F.broadcast(table), "__part").withColumn(out, F.col("__before") + F.col("__at"))
        .drop("__part", "__at", "__before")
    )
