"""Training rows: labels with the features of their workload."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame

from wattloom.functions.names import with_canonical
from wattloom.operators.keys import StageCounts, join_features, join_report, observed, sample_keys

log = logging.getLogger(__name__)


def training_rows(labels: DataFrame, features: DataFrame, dedupe_features: bool = False) -> DataFrame:
    """Labels joined with features on namespace and canonical workload name."""
    return join_features(
        with_canonical(labels), with_canonical(features), dedupe_features=dedupe_features
    )


def join_diagnostics(labels: DataFrame, features: DataFrame) -> DataFrame:
    """One row that tells how many keys each side has and shares."""
    return join_report(with_canonical(labels), with_canonical(features))


def write_training_rows(
    labels: DataFrame, features: DataFrame, path: str, dedupe_features: bool = False, counts: StageCounts | None = None
) -> int:
    """Write the joined rows to ``path`` and give their number, counted while they are written.

    With ``counts`` the rows of labels and features are counted too, by the same job.

    Nothing joined: a warning says how many keys each side has and shares, and shows some keys of both.
    """
    if counts is not None:
        labels, features = counts.watch(labels, "labels"), counts.watch(features, "features")
    rows, counter = observed(training_rows(labels, features, dedupe_features), "training_rows")
    rows.write.mode("overwrite").parquet(path)
    count = counter.get["rows"]
    if not count:
        report = join_diagnostics(labels, features).first().asDict()
        shown = {
            side: [tuple(r) for r in sample_keys(with_canonical(df)).collect()]
            for side, df in (("labels", labels), ("features", features))
        }
        log.warning("no label has features: %s; some keys: %s", report, shown)
    return count
