"""Regression errors per fold and over folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def fold_metrics(
    df: DataFrame, fold: str = "fold", target: str = "target", prediction: str = "prediction"
) -> DataFrame:
    """(fold, rows, mae, r2): one grouping.  A constant target has r2 1 if met exactly, else 0;
    fewer than two rows have none (NaN)."""
    y, p = F.col(target).cast("double"), F.col(prediction).cast("double")
    sums = df.groupBy(fold).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.sum((y - p) * (y - p)).alias("__residual"),
        (F.var_pop(y) * F.count(y)).alias("__total"),
    )
    r2 = (
        F.when(F.col("rows") < 2, F.lit(float("nan")))
        .when(F.col("__total") > 0, 1 - F.col("__residual") / F.nullif(F.col("__total"), F.lit(0.0)))
        .when(F.col("__residual") == 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )
    return sums.select(fold, "rows", "mae", r2.alias("r2"))


def summary(metrics: DataFrame) -> DataFrame:
    """One row over the folds: mean and spread of the error, mean r2."""
    return metrics.agg(
        F.count(F.lit(1)).alias("folds"),
        F.avg("mae").alias("mae_mean"),
        F.stddev_pop("mae").alias("mae_std"),
        F.avg("r2").alias("r2_mean"),
    )
