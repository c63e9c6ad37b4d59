"""The tables of queries and SQL, and readers of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattloom.functions.quantities import timestamp_seconds
from wattloom.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time as epoch seconds ``t``."""
    return table(spark, sf_dir, "events").withColumn("t", timestamp_seconds(F.col("ts"))).drop("ts")


def span(df: DataFrame, unit: int = 3600) -> tuple[float, float]:
    """First and last time, widened to whole units."""
    row = df.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    return float(row["lo"] // unit * unit), float(-(-row["hi"] // unit) * unit)


def r(column: str | Column, digits: int = 6, name: str | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits).alias(name or str(column))


EV = """ev AS (SELECT event_id, epoch_us(ts)/1e6 AS t, user_id, event_type, value FROM events),
bounds AS (SELECT floor(min(t)/3600)*3600 AS lo, ceil(max(t)/3600)*3600 AS hi FROM ev)"""


def grid_sql(source: str, series: str, step: int, lookback: int) -> str:
    """Latest sample per series and grid point, written as: each sample at all points it can serve."""
    return f"""
  SELECT {series}, lo + at_step*{step} AS ts, value FROM (
    SELECT {series}, t, event_id, value, lo, unnest(generate_series(
      greatest(0, ceil((t-lo)/{step}))::BIGINT,
      least(floor((hi-lo)/{step}), ceil((t+{lookback}-lo)/{step})-1)::BIGINT)) AS at_step
    FROM {source}, bounds)
  QUALIFY row_number() OVER (PARTITION BY {series}, at_step ORDER BY t DESC, event_id DESC) = 1"""
