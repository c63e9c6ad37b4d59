"""Cross-validation of the regressor with folds that never split a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattloom.operators import knn
from wattloom.operators.folds import N_SPLITS, with_folds
from wattloom.operators.metrics import fold_metrics, summary
from wattloom.operators.labels import finite
from wattloom.plans.model import row_id, usable_rows
from wattloom.session import written


def cross_validate(
    rows: DataFrame,
    target: str = "avg_power_w",
    k: int = knn.K,
    group: str = "workload_name",
    features: str = "features",
    id: str | None = None,
    n_splits: int = N_SPLITS,
    limits: knn.Limits = knn.Limits(),
) -> DataFrame:
    """(fold, rows, mae, r2).  All folds in one job: a row's neighbours come from other folds.

    The rows are computed once and written to the shared folder, since folds, entries and queries all read them.
    """
    rows = usable_rows(written(finite(rows, target), "evaluation-rows"), target)
    rows = rows.withColumn("__id", F.col(id) if id else row_id(rows))
    folded = with_folds(rows, group, n_splits, "fold")
    entries = knn.training_entries(folded, features, "__id", target, k, exclude="fold")
    queries = folded.select("fold", features, F.col(target).cast("double").alias("target"))
    found = knn.with_neighbours(
        queries, entries, k, features, "fold", limits=limits, expected_queries=queries.count()
    )
    return fold_metrics(knn.with_prediction(found))


def score_report(metrics: DataFrame) -> DataFrame:
    return summary(metrics)
