"""Drop repeats of a key that come within a time-to-live of its previous sighting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

TTL_SECONDS = 10  # fixed value


def drop_repeats(
    df: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    tie_break: Sequence[str] = (),
    ttl: float = TTL_SECONDS,
) -> DataFrame:
    """Keep a row when its key was not seen during the ``ttl`` seconds before it.

    Every sighting, kept or not, restarts the key's clock.  ``ts`` is in seconds.

    Two rows in one ttl-wide cell of time are always less than ``ttl`` apart, so of each
    cell only the first row can be kept, and only the last time matters to the next cell.
    Rows are reduced to that pair per key and cell, with map-side combining, before the
    window: a key seen all the time costs one row per cell, not one per sighting.
    """
    seconds = F.col(ts).cast("double")
    row = F.struct(*df.columns)
    cells = (
        df.groupBy(
            *[F.col(k).alias(f"__k_{k}") for k in keys],
            F.floor(seconds / F.lit(float(ttl))).alias("__cell"),
        )
        .agg(
            F.min_by(row, F.struct(seconds, *tie_break)).alias("__first"),
            F.min(seconds).alias("__from"),
            F.max(seconds).alias("__to"),
        )
    )
    seen = F.lag("__to").over(
        Window.partitionBy(*[f"__k_{k}" for k in keys]).orderBy("__cell")
    )
    gap = F.col("__from") - F.col("__seen")
    return (
        cells.withColumn("__seen", seen)
        .filter(F.col("__seen").isNull() | (gap > F.lit(float(ttl))))
        .select("__first.*")
    )
