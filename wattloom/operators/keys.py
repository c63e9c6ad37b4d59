"""Key profiles, and the join of labels with features on canonical workload names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

JOIN_KEYS = ("namespace", "canon_name")
WORKLOAD = ("namespace", "workload_kind", "workload_name")


def join_features(
    labels: DataFrame,
    features: DataFrame,
    keys: Sequence[str] = JOIN_KEYS,
    keep: Sequence[str] = ("_spec_hash", "features"),
    dedupe_features: bool = False,
    dedupe_order: Sequence[str] = ("_spec_hash",),
) -> DataFrame:
    """Every label row with every feature row of the same keys; the kind is ignored.

    Several specs under one key repeat its labels.  ``dedupe_features`` keeps one spec per
    key instead, the first by ``dedupe_order``.
    """
    kept = [c for c in keep if c in features.columns]
    right = features.select(*keys, *dict.fromkeys([*kept, *(dedupe_order if dedupe_features else ())]))
    if dedupe_features:
        rest = [c for c in right.columns if c not in keys]
        right = (
            right.groupBy(*keys)
            .agg(F.min_by(F.struct(*rest), F.struct(*dedupe_order)).alias("__row"))
            .select(*keys, *[F.col("__row")[c].alias(c) for c in kept])
        )
    return labels.join(right, list(keys), "inner")


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def shared_keys(left: DataFrame, right: DataFrame, keys: Sequence[str] = JOIN_KEYS) -> DataFrame:
    return left.select(*keys).intersect(right.select(*keys))


def sample_keys(df: DataFrame, keys: Sequence[str] = WORKLOAD, n: int = 10) -> DataFrame:
    """The first ``n`` distinct key tuples in order, for a report."""
    return distinct_keys(df, keys).orderBy(*keys).limit(n)


def join_report(
    labels: DataFrame, features: DataFrame, keys: Sequence[str] = JOIN_KEYS
) -> DataFrame:
    """One row: distinct keys of each side and of both, from a single grouping of tagged keys.

    Rows with a null key are not counted: they cannot join.
    """
    side = lambda df, tag: df.select(*keys, F.lit(tag).alias("__side"))
    tagged = side(labels, "label").unionByName(side(features, "feature")).dropna(subset=list(keys))
    has = lambda tag: F.max(F.when(F.col("__side") == tag, 1).otherwise(0))
    per_key = tagged.groupBy(*keys).agg(has("label").alias("l"), has("feature").alias("f"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return per_key.agg(
        total(F.col("f")).alias("feature_keys"),
        total(F.col("l")).alias("label_keys"),
        total(F.col("l") * F.col("f")).alias("shared_keys"),
    )


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, rows) for every distinct value of the given columns, nulls included."""
    pairs = F.explode(
        F.array(
            *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
        )
    )
    return df.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("rows"))


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))


def observed(df: DataFrame, stage: str) -> tuple[DataFrame, Observation]:
    """The frame and a counter of its rows, filled by whatever job runs the frame next."""
    counter = Observation(stage)
    return df.observe(counter, F.count(F.lit(1)).alias("rows")), counter


class StageCounts:
    """Rows of the watched stages of a run, counted by the jobs that run anyway.

    Every watched frame must have been run once before :meth:`table` is called, which waits for its count.
    """

    def __init__(self):
        self._counters: list[tuple[str, Observation]] = []

    def watch(self, df: DataFrame, stage: str) -> DataFrame:
        out, counter = observed(df, stage)
        self._counters.append((stage, counter))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """(stage, rows), in the order of watching; a stage watched twice has the rows of both."""
        total: dict[str, int] = {}
        for stage, counter in self._counters:
            total[stage] = total.get(stage, 0) + counter.get["rows"]
        return spark.createDataFrame(list(total.items()), "stage string, rows bigint")
