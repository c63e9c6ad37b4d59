"""Folds that never split a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattloom.operators.ranks import with_rank
from wattloom.session import scratch_path

N_SPLITS = 5  # fixed value: most folds
BROADCAST_GROUPS = 500_000  # more groups than this are joined by a shuffle


def deal_runs(runs: list[tuple[int, int]], folds: int) -> list[tuple[int, int, int, list[int]]]:
    """Deal groups, largest first, each to the fold with the least rows (the first of equals), by runs of equal size.

    ``runs`` has (size, number of groups).  Out come stretches (size, first, last, order): of the groups of that
    size, number ``first`` to ``last`` go to the folds in ``order`` in turn.  A run needs one stretch per fold at
    most, because from the moment a fold takes its first group of the run it takes one in every turn.
    """
    loads, out = [0] * folds, []
    for size, groups in runs:
        at = 0
        while at < groups:
            low = min(loads)
            active = sorted((load, f) for f, load in enumerate(loads) if load < low + size)
            waiting = [(load, f) for f, load in enumerate(loads) if load >= low + size]
            if waiting:
                until, g = min(waiting)
                turns = [-((load - until) // size) + (1 if (until - load) % size == 0 and f < g else 0) for load, f in active]
                length = min(groups - at, sum(turns))
            else:
                length = groups - at
            order = [f for _, f in active]
            out.append((size, at, at + length - 1, order))
            for k, f in enumerate(order):
                loads[f] += size * ((length - k + len(order) - 1) // len(order))
            at += length
    return out


def with_folds(
    df: DataFrame, group: str = "workload_name", n_splits: int = N_SPLITS, out: str = "fold"
) -> DataFrame:
    """Add a fold number in ``0 .. min(n_splits, groups) - 1``, the same for a whole group.

    Groups go one by one, by size and then name, to the fold with the least rows; rows without a group are a group
    of their own.  The driver sees only how many groups there are of each size (at most the square root of twice
    the rows), and groups are numbered by a range sort, so any number of groups follows the same rule.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "group-sizes")
    name = F.struct(F.col(group).cast("string").alias("name"))
    df.groupBy(name.alias("__group")).agg(F.count(F.lit(1)).alias("__rows")).write.parquet(path)
    sizes = spark.read.parquet(path)
    runs = sorted(((r["__rows"], r["n"]) for r in sizes.groupBy("__rows").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    groups = sum(n for _, n in runs)
    folds = min(n_splits, groups)
    if folds < 2:
        raise ValueError("at least 2 distinct groups are needed for cross-validation")
    stretches = spark.createDataFrame(deal_runs(runs, folds), "__rows long, __first long, __last long, __order array<int>")
    starts, before = [], 0
    for size, n in runs:
        starts.append((size, before))
        before += n
    ranked = with_rank(sizes, F.desc("__rows"), F.asc("__group.name"), out="__rank", name="groups")
    within = ranked.join(F.broadcast(spark.createDataFrame(starts, "__rows long, __start long")), "__rows")
    within = within.withColumn("__at", F.col("__rank") - F.col("__start"))
    turn = (F.pmod(F.col("__at") - F.col("__first"), F.size("__order")) + 1).cast("int")
    dealt = (
        within.join(F.broadcast(stretches), "__rows")
        .filter(F.col("__at").between(F.col("__first"), F.col("__last")))
        .select("__group", F.element_at("__order", turn).alias("__fold"))
    )
    if groups <= BROADCAST_GROUPS:
        dealt = F.broadcast(dealt)
    return df.withColumn("__group", name).join(dealt, "__group").withColumn(out, F.col("__fold")).drop("__group", "__fold")
