"""Batch scoring of requests and of manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wattloom.functions.quantities import step_seconds
from wattloom.operators.flatten import META, flat_rows
from wattloom.operators.requests import first_documents, manifest_requests
from wattloom.plans.encoder import Encoder
from wattloom.plans.model import KnnModel
from wattloom.schemas import REJECT, validate
from wattloom.sources.manifests import ORDER, parse_documents


def over_horizon(df: DataFrame, horizon: str | int, step: str | int, prediction: str = "prediction") -> DataFrame:
    """Add ``energy_over_horizon``: the per-step prediction times the number of steps begun."""
    steps = -(-step_seconds(horizon) // step_seconds(step))
    return df.withColumn("energy_over_horizon", F.col(prediction) * F.lit(steps))


def score_requests(
    requests: DataFrame, encoder: Encoder, model: KnnModel, keep: Sequence[str] = ()
) -> DataFrame:
    """Keys, ``spec_hash``, ``target`` and ``prediction`` of accepted requests, plus ``keep``."""
    features = encoder.transform(flat_rows(requests, keep), keep=[*keep, *META])
    return model.predict(features).select(
        *keep,
        "namespace", "workload_kind", "workload_name",
        F.col("_spec_hash").alias("spec_hash"),
        F.lit(model.target).alias("target"),
        "prediction",
    )


def requests_of_documents(docs: DataFrame, first_only: bool = False) -> DataFrame:
    """Requests of manifest documents, with ``file, at, n`` and a ``reject_reason``."""
    parsed = parse_documents(docs)
    if first_only:
        parsed = first_documents(parsed, "file", ORDER, F.col("object").isNotNull())
    return validate(manifest_requests(parsed, keep=["file", *ORDER]))


def score_documents(
    docs: DataFrame, encoder: Encoder, model: KnnModel, first_only: bool = False
) -> DataFrame:
    """Scores of manifest documents; rejected ones keep their reason and get no prediction."""
    requests = requests_of_documents(docs, first_only)
    return score_requests(requests, encoder, model, keep=["file", *ORDER, REJECT]).withColumn(
        "prediction", F.when(F.col(REJECT).isNull(), F.col("prediction"))
    )
