"""Range-query responses to long tables of samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattloom.sources.items import read_items

# Shape of a range-query response.
RESPONSE_DDL = (
    "data struct<result:array<struct<metric:map<string,string>,values:array<array<string>>>>>"
)


def read_responses(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Saved responses, one per line, or one per file with ``multi_line``."""
    return spark.read.schema(RESPONSE_DDL).option("multiLine", multi_line).json(path)


def read_large_response(spark: SparkSession, path: str) -> DataFrame:
    """Responses of one series each, from files that hold one response each: a task per split, a row per series."""
    series = F.from_json("item", "metric map<string,string>, values array<array<string>>")
    items = read_items(spark, path, "result", 3)
    return items.select(F.struct(F.array(series).alias("result")).alias("data"))


def flatten_series(
    responses: DataFrame, labels: Sequence[str] = ("namespace", "pod"), result: str = "data.result"
) -> DataFrame:
    """(ts, value, labels): one row per series and sample, values read as numbers.

    Labels are named, not inferred, so no samples still gives a typed empty frame.
    """
    series = responses.select(F.explode(result).alias("s"))
    samples = series.select(F.col("s.metric").alias("metric"), F.explode("s.values").alias("v"))
    number = lambda i: F.get("v", F.lit(i)).try_cast("double")
    return samples.select(
        number(0).alias("ts"),
        number(1).alias("value"),
        *[F.col("metric")[name].alias(name) for name in labels],
    )
