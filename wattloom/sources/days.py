"""Samples and labels laid out by day, and time ranges turned into partition filters."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DAY = "day"
_DAY_SECONDS = 86400
_EPOCH = date(1970, 1, 1)
# Days that a date can name; times beyond them, no time and no number stand in the null day.
_FIRST, _LAST = (date.min - _EPOCH).days, (date.max - _EPOCH).days


def day_of(ts: Column) -> Column:
    """The UTC day of a time in epoch seconds, whatever the session's zone; null where a date cannot name it."""
    number = F.floor(ts.cast("double") / _DAY_SECONDS)
    named = number.between(F.lit(_FIRST), F.lit(_LAST)) & ~F.isnan(ts.cast("double"))
    return F.date_add(F.lit(_EPOCH), F.when(named, number).cast("int"))


def write_by_day(df: DataFrame, path: str, ts: str = "ts", keys: Sequence[str] = ()) -> None:
    """Write rows as Parquet, a folder per UTC day; days that ``df`` has are replaced, others stay.

    Writing a day again therefore adds no repeats.  Rows are brought together by day before they are written, and
    a day too large for one task is split, a small one shares a task (Spark's rebalancing), so that neither one hot
    day nor many empty ones make the files too large or too many.  Files are sorted by ``keys`` and time.
    """
    rows = df.withColumn(DAY, day_of(F.col(ts))).hint("rebalance", DAY)
    rows = rows.sortWithinPartitions(DAY, *keys, ts)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)


def in_days(df: DataFrame, start: float, end: float) -> DataFrame:
    """Rows of the days that ``start`` to ``end`` (epoch seconds, both included) touch.

    A table without days passes whole.  Only days are compared, so the filter is answered by folder names; rows of
    the first and last day outside the range are left to the caller's own time filter.
    """
    if DAY not in df.columns:
        return df
    lo, hi = (int(t // _DAY_SECONDS) for t in (start, end))

    def as_date(n: int) -> Column:
        return F.lit((_EPOCH + timedelta(days=min(max(n, _FIRST), _LAST))).isoformat()).cast("date")

    wanted = F.col(DAY).between(as_date(lo), as_date(hi))
    if lo < _FIRST or hi > _LAST:
        wanted = wanted | F.col(DAY).isNull()
    return df.filter(wanted)


def read_days(spark: SparkSession, path: str, start: float | None = None, end: float | None = None) -> DataFrame:
    """A table of :func:`write_by_day`, its ``day`` included; with bounds, only the folders between them are read."""
    rows = spark.read.parquet(path)
    if rows.schema[DAY].dataType.typeName() != "date":  # every row stands in the null day
        rows = rows.withColumn(DAY, F.col(DAY).cast("date"))
    if start is None and end is None:
        return rows
    return in_days(rows, float("-1e15") if start is None else start, float("1e15") if end is None else end)
