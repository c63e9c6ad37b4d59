"""Counters to energy per step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wattloom.operators.previous import MAX_GROUP_ROWS, with_previous


def counter_steps(
    df: DataFrame,
    keys: Sequence[str] = ("namespace", "pod"),
    order: Sequence[str] = ("ts",),
    value: str = "value",
    out: str = "energy_step_j",
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add ``out``: increase of the counter since the key's previous sample.

    A fall (counter reset) counts as 0.  The first sample of a key has no step: null.
    """
    steps = with_previous(df, keys, order, {"__last": value}, max_group_rows)
    rise = F.col(value) - F.col("__last")
    return steps.withColumn(out, F.when(rise < 0, F.lit(0.0)).otherwise(rise)).drop("__last")
