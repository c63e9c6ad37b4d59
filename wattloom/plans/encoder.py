"""Feature encoder: fitted once, kept as small Parquet tables, applied as a projection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattloom.functions import vectors
from wattloom.operators.flatten import CATEGORIES, META, NUMBERS

MAX_CATEGORIES = 100_000  # beyond this a dense vector makes no sense, and fitting stops


@dataclass(frozen=True)
class Encoder:
    """Means and deviations per number, sorted categories per category, and the text part.

    All of it is as small as one feature vector, so it lives in the plan as literals.
    """

    scaler: dict[str, tuple[float, float]]
    categories: dict[str, list[str]]
    use_text: bool = True
    text_dim: int = vectors.TEXT_DIM
    text_model: Callable[[], Callable] | None = field(default=None, compare=False)

    @staticmethod
    def fit(
        rows: DataFrame,
        numbers: Sequence[str] = NUMBERS,
        categories: Sequence[str] = CATEGORIES,
        use_text: bool = True,
        text_dim: int = vectors.TEXT_DIM,
        text_model: Callable[[], Callable] | None = None,
    ) -> "Encoder":
        """Learn from flat rows: one aggregate for the numbers, one distinct for the categories."""
        value = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numbers}
        stats = rows.agg(
            F.count(F.lit(1)).alias("__n"),
            *[F.avg(v).alias(f"m_{c}") for c, v in value.items()],
            *[F.stddev_pop(v).alias(f"s_{c}") for c, v in value.items()],
        ).first()
        if not stats["__n"]:
            raise ValueError("no rows to fit the encoder on")
        found: dict[str, list[str]] = {c: [] for c in categories}
        if categories:
            pairs = F.explode(
                F.array(
                    *[
                        F.struct(F.lit(c).alias("col"), F.coalesce(F.col(c), F.lit("NA")).alias("value"))
                        for c in categories
                    ]
                )
            )
            distinct = rows.select(pairs.alias("p")).select("p.*").distinct()
            listed = distinct.limit(MAX_CATEGORIES + 1).collect()
            if len(listed) > MAX_CATEGORIES:
                raise ValueError(f"more than {MAX_CATEGORIES} categories: not a categorical column")
            for row in listed:
                found[row["col"]].append(row["value"])
        return Encoder(
            {c: (stats[f"m_{c}"], stats[f"s_{c}"]) for c in numbers},
            {c: sorted(values) for c, values in found.items()},
            use_text,
            text_dim,
            text_model,
        )

    @property
    def length(self) -> int:
        width = len(self.scaler) + sum(len(c) for c in self.categories.values())
        return width + (self.text_dim if self.use_text else 0)

    def transform(
        self, rows: DataFrame, keep: Sequence[str] = META, text: str = "_text"
    ) -> DataFrame:
        """``keep``, ``vec_len`` and ``features``: a projection over flat rows, no shuffle."""
        parts = [
            F.array(*[vectors.standardise(F.col(c), m, s) for c, (m, s) in self.scaler.items()]),
            *[vectors.one_hot(F.col(c), values) for c, values in self.categories.items()],
        ]
        if self.use_text:
            if self.text_model:
                rows = vectors.model_text(rows, text, "__embedding", self.text_model, self.text_dim)
            else:
                rows = vectors.hashed_text(rows, text, "__embedding", self.text_dim)
            parts.append(F.col("__embedding"))
        return rows.select(
            *keep, F.lit(self.length).alias("vec_len"), vectors.assemble(*parts).alias("features")
        )

    def save(self, spark: SparkSession, path: str) -> None:
        def put(rows, ddl, name):
            spark.createDataFrame(rows, ddl).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")

        put(
            [(i, c, float(m), float(s)) for i, (c, (m, s)) in enumerate(self.scaler.items())],
            "idx int, feature string, mean double, scale double",
            "scaler",
        )
        put(
            [
                (i, c, j, v)
                for i, (c, values) in enumerate(self.categories.items())
                for j, v in enumerate(values)
            ],
            "col_idx int, col string, idx int, value string",
            "categories",
        )
        name = _model_name(self.text_model)
        put([(self.use_text, self.text_dim, name)], "use_text boolean, text_dim int, text_model string", "meta")

    @staticmethod
    def load(
        spark: SparkSession, path: str, text_model: Callable[[], Callable] | None = None
    ) -> "Encoder":
        scaler = spark.read.parquet(f"{path}/scaler").orderBy("idx").collect()
        values = spark.read.parquet(f"{path}/categories").orderBy("col_idx", "idx").collect()
        meta = spark.read.parquet(f"{path}/meta").first()
        fitted = meta.asDict().get("text_model")
        if meta["use_text"] and fitted != _model_name(text_model):
            raise ValueError(f"the encoder was fitted with text model {fitted}, not {_model_name(text_model)}")
        categories: dict[str, list[str]] = {}
        for row in values:
            categories.setdefault(row["col"], []).append(row["value"])
        return Encoder(
            {r["feature"]: (r["mean"], r["scale"]) for r in scaler},
            categories,
            meta["use_text"],
            meta["text_dim"],
            text_model,
        )

    @staticmethod
    def load_or_fit(spark: SparkSession, path: str, rows: DataFrame, **fit_args) -> "Encoder":
        """The saved encoder if there is anything at ``path``, else a new one, saved; a damaged one is an error."""
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return Encoder.load(spark, path, fit_args.get("text_model"))
        encoder = Encoder.fit(rows, **fit_args)
        encoder.save(spark, path)
        return encoder


def _model_name(text_model: Callable | None) -> str | None:
    """What an artifact says about the text model it was fitted with; nothing for hashed words.

    A ``model_name`` set on the function counts; without one its qualified name, which functions made in one place share.
    """
    if text_model is None:
        return None
    name = getattr(text_model, "model_name", None)
    return name or getattr(text_model, "__qualname__", type(text_model).__name__)
