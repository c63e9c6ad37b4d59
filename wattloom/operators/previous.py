"""Previous row per key, safe against keys that hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from wattloom.operators.ranks import with_rank
from wattloom.session import written

MAX_GROUP_ROWS = 5_000_000


def busy_keys(df: DataFrame, keys: Sequence[str], max_rows: int) -> DataFrame:
    """Keys with more than ``max_rows`` rows, as columns ``__h_<key>``; at most ``rows / max_rows`` come out."""
    counted = df.groupBy(*[F.col(k).alias(f"__h_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("__rows"))
    return counted.filter(F.col("__rows") > max_rows).drop("__rows")


def in_segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int) -> DataFrame:
    """Rows numbered by key and order (``__rank``), in segments of ``max_rows`` consecutive numbers (``__segment``).

    The numbers come from a range sort over keys and order, so neither a stray time nor many rows of one time
    makes a segment larger.
    """
    ranked = with_rank(df, *keys, *order, out="__rank", name="busy-rows")
    return ranked.withColumn("__segment", F.floor(F.col("__rank") / F.lit(max_rows)))


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: dict[str, str],
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add, for each ``new: old`` in ``columns``, the value of ``old`` in the key's previous row.

    ``order`` should make rows of a key distinct; nulls come first.  Rows of keys with more than ``max_group_rows``
    rows are numbered and sort in segments of that many rows, in separate tasks; the last row of each segment (one
    small row) is handed to the first row of the next.  ``None`` skips the check where the caller knows that
    groups are small.
    """
    tail = F.struct(*[F.col(old).alias(new) for new, old in columns.items()])
    before = F.lag(tail).over(Window.partitionBy(*keys).orderBy(*order))
    busy = None
    if max_group_rows is not None:
        busy = written(busy_keys(df, keys, max_group_rows), "busy-keys")
        busy = None if busy.isEmpty() else F.broadcast(busy)
    if busy is None:
        out = df.withColumn("__before", before)
    else:
        same = [df[k].eqNullSafe(busy[f"__h_{k}"]) for k in keys]
        usual = df.join(busy, same, "left_anti").withColumn("__before", before)
        out = usual.unionByName(_across_segments(df.join(busy, same, "left_semi"), keys, order, tail, max_group_rows))
    return out.withColumns({new: F.col("__before")[new] for new in columns}).drop("__before")


def _across_segments(df: DataFrame, keys, order, tail, max_rows: int) -> DataFrame:
    cut = in_segments(df, keys, order, max_rows)
    key = F.struct(*[F.col(k) for k in keys])
    row = F.struct(key.alias("key"), tail.alias("tail"))
    # One row per segment, rows / max_rows in all, so it may be broadcast.
    ends = cut.filter(F.pmod(F.col("__rank") + 1, F.lit(max_rows)) == 0).select(
        (F.col("__segment") + 1).alias("__h_segment"), row.alias("__carry")
    )
    inside = F.lag(row).over(Window.partitionBy("__segment").orderBy("__rank"))
    out = cut.withColumn("__inside", inside)
    out = out.join(F.broadcast(ends), out["__segment"] == ends["__h_segment"], "left")
    last = F.coalesce("__inside", "__carry")
    return out.withColumn("__before", F.when(last["key"].eqNullSafe(key), last["tail"])).drop(
        "__inside", "__carry", "__rank", "__segment", "__h_segment"
    )
