"""Samples on a regular time grid: last value within a look-back, then sums or maxima."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

LOOKBACK_SECONDS = 300  # fixed value: how long a sample stays current


def on_grid(
    samples: DataFrame,
    series: Sequence[str],
    start: float,
    end: float,
    step: int,
    ts: str = "ts",
    value: str = "value",
    tie_break: str | None = None,
    lookback: int = LOOKBACK_SECONDS,
) -> DataFrame:
    """(series, ts, value): at each ``start + n * step <= end`` the series' latest sample that
    is at most, but not exactly, ``lookback`` old.

    Samples collapse to one row per series and grid cell before anything is repeated, with
    map-side combining; only that one row then spreads forward, up to the next occupied cell.
    A series' window therefore holds at most one row per grid point, however many samples.
    Samples of one series at the same time are decided by ``tie_break``, the larger wins.
    """
    last_cell = int((end - start) // step)
    at = F.col(ts).cast("double")
    cell = F.greatest(F.ceil((at - F.lit(float(start))) / F.lit(step)), F.lit(0))
    latest = F.struct(at, F.col(tie_break)) if tie_break else at
    cells = (
        samples.filter((at > F.lit(float(start - lookback))) & (at <= F.lit(float(end))))
        .withColumn("__cell", cell)
        .groupBy(*series, "__cell")
        .agg(F.max_by(value, latest).alias("value"), F.max(at).alias("__at"))
        .filter(F.col("__cell") <= last_cell)
    )
    following = F.lead("__cell").over(Window.partitionBy(*series).orderBy("__cell"))
    expires = F.ceil((F.col("__at") + F.lit(lookback) - F.lit(float(start))) / F.lit(step)) - 1
    until = F.least(expires, F.coalesce(following - 1, F.lit(last_cell)), F.lit(last_cell))
    return (
        cells.withColumn("__until", until)
        .filter(F.col("__until") >= F.col("__cell"))
        .withColumn("__n", F.explode(F.sequence("__cell", "__until")))
        .select(*series, (F.lit(float(start)) + F.col("__n") * F.lit(step)).alias("ts"), "value")
    )


def _by_step(
    samples: DataFrame, by: Sequence[str], series: Sequence[str], how: Column, kwargs: dict
) -> DataFrame:
    return on_grid(samples, series, **kwargs).groupBy(*by, "ts").agg(how.alias("value"))


def grid_sum(samples: DataFrame, by: Sequence[str], series: Sequence[str], **kwargs) -> DataFrame:
    """Per grid point, the sum over all series that share ``by``."""
    return _by_step(samples, by, series, F.sum("value"), kwargs)


def grid_max(samples: DataFrame, by: Sequence[str], series: Sequence[str], **kwargs) -> DataFrame:
    """Per grid point, the maximum over all series that share ``by``."""
    return _by_step(samples, by, series, F.max("value"), kwargs)
