"""Request lines, Parquet tables and prediction records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattloom.schemas import REJECT, REQUEST_DDL, validate

CORRUPT = "_corrupt_record"


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as defaulted requests with a ``reject_reason``.

    Blank lines vanish; a line that is no JSON, has wrong types or lacks a required field
    stays, marked, so that nothing is lost silently.
    """
    rows = spark.read.schema(f"{REQUEST_DDL}, {CORRUPT} string").json(path)
    marked = rows.withColumn(REJECT, F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed line")))
    return validate(marked)


def append_requests(df: DataFrame, path: str) -> None:
    """Append as JSON lines; nulls are written out.  Reruns add repeats, see ``drop_repeats``."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
