"""A corpus made ready for training: toxic, repeated and contaminated documents go, and the rest is mixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattloom.llm import decontam, exact_dedup, mixing, simhash, toxicity
from wattloom.llm.common import written
from wattloom.session import configure


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold.

    Nulls, repeats, empty tables and other columns: as in ``toxicity.score``; empty texts stay.
    """
    return toxicity.drop_toxic(docs, _table(configure(spark), sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that of the largest id; see ``exact_dedup.drop_exact_duplicates``."""
    configure(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near duplicates; see ``simhash.drop_near_duplicates``."""
    configure(spark)
    return simhash.drop_near_duplicates(docs)


def without_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not contaminated by the benchmark; see ``decontam.contamination``."""
    return decontam.drop_contaminated(docs, _table(configure(spark), sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ``size, source_size, target, copies, taken``; see ``mixing.mix``."""
    configure(spark)
    return mixing.mix(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_contaminated),
    ("mixing", mixed),
]

# The first stage is a trained network, the third a graph search: SQL says neither, tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
