"""Multi-document manifests to JSON objects."""

from __future__ import annotations

import json
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattloom.schemas import REJECT

try:
    import yaml
except ImportError:  # only needed where manifests are read
    yaml = None

DOCUMENT = "file string, at bigint, n bigint, text string"
ORDER = ("at", "n")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, n, text): one row per document; (at, n) orders the documents of a file.

    Spark splits at the separator lines itself, so a large file is read by many tasks.
    """
    lines = spark.read.option("lineSep", "\n---").text(path)
    text = F.col("value")
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("n"),
        text.alias("text"),
    ).filter(F.trim(F.regexp_replace(text, r"^---", "")) != "")


def _to_json(text: str) -> tuple[str | None, str | None]:
    """(JSON of an object, reason): both null for a document that is valid but no object."""
    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    try:
        doc = yaml.load(text, Loader=loader)
        if not isinstance(doc, dict):
            return None, None
        return json.dumps(doc, default=str), None
    except (yaml.YAMLError, TypeError, ValueError) as error:
        return None, f"invalid manifest: {type(error).__name__}"


def parse_documents(docs: DataFrame) -> DataFrame:
    """Add ``object`` (JSON text) and ``reject_reason``; documents that are no objects drop out."""
    if yaml is None:
        raise ImportError("reading manifests needs PyYAML")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [_to_json(t) for t in batch["text"]]
            batch["object"] = pd.Series([o for o, _ in pairs], index=batch.index, dtype=object)
            batch[REJECT] = pd.Series([r for _, r in pairs], index=batch.index, dtype=object)
            yield batch

    parsed = docs.mapInPandas(parse, f"{DOCUMENT}, object string, {REJECT} string")
    return parsed.filter(F.col("object").isNotNull() | F.col(REJECT).isNotNull())


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return parse_documents(read_documents(spark, path))
