"""Feature encoder for any number of categories: sparse vectors, and the categories as a table that is joined."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattloom.functions import vectors
from wattloom.operators.flatten import CATEGORIES, META, NUMBERS
from wattloom.operators.ranks import with_rank
from wattloom.session import written

NULL = "NA"  # fixed value: the category that stands for null


@dataclass(frozen=True)
class SparseEncoder:
    """Means and deviations per number; ``dictionary``: ``col, value, at``, a position for every category.

    Numbers take the first positions, categories follow by column and value, hashed words come last, as in the
    dense encoder.  Only the numbers' parameters pass through the driver and the plan.
    """

    scaler: dict[str, tuple[float, float]]
    categories: tuple[str, ...]
    dictionary: DataFrame
    size: int  # of the dictionary
    use_text: bool = True
    text_dim: int = vectors.TEXT_DIM

    @staticmethod
    def fit(
        rows: DataFrame,
        numbers: Sequence[str] = NUMBERS,
        categories: Sequence[str] = CATEGORIES,
        use_text: bool = True,
        text_dim: int = vectors.TEXT_DIM,
    ) -> "SparseEncoder":
        """One aggregate for the numbers; categories made distinct before the shuffle and numbered by a range sort."""
        value = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numbers}
        stats = rows.agg(
            F.count(F.lit(1)).alias("__n"),
            *[F.avg(v).alias(f"m_{c}") for c, v in value.items()],
            *[F.stddev_pop(v).alias(f"s_{c}") for c, v in value.items()],
        ).first()
        if not stats["__n"]:
            raise ValueError("no rows to fit the encoder on")
        pairs = [
            F.struct(F.lit(i).alias("order"), F.lit(c).alias("col"), _category(c).alias("value")) for i, c in enumerate(categories)
        ]
        empty = F.array().cast("array<struct<order:int,col:string,value:string>>")
        found = rows.select(F.explode(F.array(*pairs) if pairs else empty).alias("p")).select("p.*").distinct()
        ranked = with_rank(found, "order", "value", out="at", name="categories")
        dictionary = written(ranked.select("col", "value", (F.col("at") + len(numbers)).alias("at")), "dictionary")
        scaler = {c: (stats[f"m_{c}"], stats[f"s_{c}"]) for c in numbers}
        return SparseEncoder(scaler, tuple(categories), dictionary, dictionary.count(), use_text, text_dim)

    @property
    def length(self) -> int:
        return len(self.scaler) + self.size + (self.text_dim if self.use_text else 0)

    def transform(self, rows: DataFrame, keep: Sequence[str] = META, text: str = "_text") -> DataFrame:
        """``keep``, ``vec_len`` and ``features``: a struct of ``size``, ascending positions ``at`` and ``values``.

        One join per category column on the value; a category that was not fitted has no position, and a number
        at its mean takes none.
        """
        found = rows
        for i, c in enumerate(self.categories):
            own = self.dictionary.filter(F.col("col") == c).select(F.col("value").alias(f"__v{i}"), F.col("at").alias(f"__at{i}"))
            found = found.join(own, _category(c) == F.col(f"__v{i}"), "left").drop(f"__v{i}")
        items = [
            F.struct(F.lit(i).cast("long").alias("at"), vectors.standardise(F.col(c), m, s).alias("value"))
            for i, (c, (m, s)) in enumerate(self.scaler.items())
        ]
        items += [F.struct(F.col(f"__at{i}").alias("at"), F.lit(1.0).alias("value")) for i in range(len(self.categories))]
        none = F.array().cast("array<struct<at:bigint,value:double>>")
        parts = [F.array(*items) if items else none]
        if self.use_text:
            found = _words(found, text, self.text_dim)
            start = len(self.scaler) + self.size
            words = F.arrays_zip(F.col("__unit.indices").alias("at"), F.col("__unit.values").alias("value"))
            parts.append(F.transform(words, lambda x: F.struct((x["at"] + F.lit(start).cast("long")).alias("at"), x["value"].alias("value"))))
        held = F.filter(F.concat(*parts), lambda x: x["at"].isNotNull() & (x["value"] != 0))
        packed = found.select(*keep, F.explode(F.array(held)).alias("__held"))  # computed once
        return packed.select(
            *keep,
            F.lit(self.length).alias("vec_len"),
            F.struct(F.lit(self.length).alias("size"), F.col("__held.at").alias("at"), F.col("__held.value").alias("values")).alias("features"),
        )

    def save(self, path: str) -> None:
        spark = self.dictionary.sparkSession
        self.dictionary.write.mode("overwrite").parquet(f"{path}/categories")
        scaler = [(i, c, float(m), float(s)) for i, (c, (m, s)) in enumerate(self.scaler.items())]
        table = spark.createDataFrame(scaler, "idx int, feature string, mean double, scale double")
        table.coalesce(1).write.mode("overwrite").parquet(f"{path}/scaler")
        meta = spark.createDataFrame(
            [(list(self.categories), self.size, self.use_text, self.text_dim)], "categories array<string>, size long, use_text boolean, text_dim int"
        )
        meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "SparseEncoder":
        scaler = spark.read.parquet(f"{path}/scaler").orderBy("idx").collect()
        meta = spark.read.parquet(f"{path}/meta").first()
        dictionary = spark.read.parquet(f"{path}/categories")
        return SparseEncoder(
            {r["feature"]: (r["mean"], r["scale"]) for r in scaler}, tuple(meta["categories"]), dictionary, meta["size"], meta["use_text"], meta["text_dim"]
        )


def _category(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(NULL))


def _words(df: DataFrame, text: str, dim: int) -> DataFrame:
    """Add ``__unit``: hashed words of the text, scaled to unit length, as indices and values."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    counted = HashingTF(numFeatures=dim, inputCol="__words", outputCol="__counts").transform(df.withColumn("__words", words))
    unit = Normalizer(p=2.0, inputCol="__counts", outputCol="__unit").transform(counted)
    return unit.withColumn("__unit", F.unwrap_udt("__unit")).drop("__words", "__counts")


def densified(features: Column) -> Column:
    """The dense form of a sparse vector, for those that are short enough."""
    pairs = F.map_from_arrays(features["at"], features["values"])
    places = F.sequence(F.lit(0).cast("long"), features["size"].cast("long") - 1)
    return F.transform(places, lambda i: F.coalesce(pairs[i], F.lit(0.0)).cast("float"))


def sparse_dot(a: Column, b: Column) -> Column:
    """Product of two sparse vectors, over the positions that both have."""
    other = F.map_from_arrays(b["at"], b["values"])
    both = F.zip_with(a["at"], a["values"], lambda at, x: x * F.coalesce(other[at], F.lit(0.0)))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)
