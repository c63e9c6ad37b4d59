"""Nearest-neighbour regressor: fit, keep, predict."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattloom.operators import knn
from wattloom.operators.cells import CellIndex
from wattloom.operators.labels import finite, has_rows

TARGETS = ("avg_power_w", "energy_step_j", "total_energy_j")
ROW_ID = ("namespace", "workload_kind", "workload_name", "pod", "ts", "_spec_hash")


def row_id(df: DataFrame, columns: Sequence[str] = ROW_ID) -> Column:
    """Text that names a training row and settles ties between equal distances."""
    present = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns if c in df.columns]
    return F.concat_ws("|", *present)


def usable_rows(df: DataFrame, target: str) -> DataFrame:
    rows = finite(df, target)
    if not has_rows(rows):
        raise ValueError(f"no finite values for target {target!r}: choose another target or check the labels")
    return rows


class KnnModel:
    """Distinct training vectors with their targets; ``k`` is fixed when fitted."""

    def __init__(
        self,
        entries: DataFrame,
        k: int,
        target: str,
        limits: knn.Limits = knn.Limits(),
        size: tuple[int, int] | None = None,
        index_path: str | None = None,
    ):
        self.entries, self.k, self.target, self.limits = entries, k, target, limits
        self._size, self._index_path = size, index_path

    @staticmethod
    def fit(
        rows: DataFrame,
        target: str = "avg_power_w",
        k: int = knn.K,
        features: str = "features",
        id: str | None = None,
        limits: knn.Limits = knn.Limits(),
    ) -> "KnnModel":
        rows = usable_rows(rows, target)
        rows = rows.withColumn("__id", F.col(id) if id else row_id(rows))
        return KnnModel(knn.training_entries(rows, features, "__id", target, k), k, target, limits)

    @cached_property
    def searcher(self) -> knn.Searcher:
        """Made once; a loaded model brings the size of its table, and its cells if they were kept."""
        found = knn.Searcher(self.entries, self.k, self.limits, size=self._size)
        if self._index_path and not found.small:
            found.index = CellIndex.load(self.entries.sparkSession, self._index_path, self.limits)
        return found

    def neighbours(self, df: DataFrame, features: str = "features", out: str = "neighbours") -> DataFrame:
        return self.searcher.search(df, features, None, out)

    def predict(self, df: DataFrame, features: str = "features", out: str = "prediction") -> DataFrame:
        found = self.neighbours(df, features, "__neighbours")
        return knn.with_prediction(found, "__neighbours", out).drop("__neighbours")

    def save(self, path: str) -> None:
        """Entries, and for a table too large to broadcast its cells, so that no search cuts it again."""
        spark = self.entries.sparkSession
        self.entries.write.mode("overwrite").parquet(f"{path}/entries")
        kept = knn.Searcher(spark.read.parquet(f"{path}/entries"), self.k, self.limits)
        name = None
        if not kept.small:
            name = f"index-{uuid.uuid4().hex}"  # a new folder each time; an older model in use keeps its own
            CellIndex.build(kept.entries, kept.rows, kept.dim, self.limits, f"{path}/{name}")
        meta = spark.createDataFrame(
            [(self.k, self.target, kept.rows, kept.dim, name)], "k int, target string, rows long, width int, index string"
        )
        meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str, limits: knn.Limits = knn.Limits()) -> "KnnModel":
        meta = spark.read.parquet(f"{path}/meta").first()
        index = meta["index"] and f"{path}/{meta['index']}"
        size = (meta["rows"], meta["width"])
        return KnnModel(spark.read.parquet(f"{path}/entries"), meta["k"], meta["target"], limits, size, index)
