"""Requests to flat rows of keys, categories and numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wattloom.functions import specs

# The columns that make up a feature vector, in order.
COUNTS = ("gpu_count", "init_container_count", "sidecar_count")
NUMBERS = (*COUNTS, *specs.RESOURCES)
CATEGORIES = ("runtime_class", "node_type")
META = ("namespace", "workload_kind", "workload_name", "_spec_hash")


def flat_rows(requests: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One flat row per request; a projection, so no shuffle and no exploding of containers."""
    return requests.select(
        *keep,
        "namespace",
        "workload_kind",
        "workload_name",
        *CATEGORIES,
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in COUNTS],
        *[specs.resource_sum(F.col("containers"), r).alias(r) for r in specs.RESOURCES],
        specs.text_bundle(
            *[F.col(c) for c in ("workload_kind", "workload_name", "labels", "annotations", "containers")]
        ).alias("_text"),
        specs.spec_hash().alias("_spec_hash"),
    )
