"""Dense vector expressions: standardise, one-hot, concatenate, cosine distance, hashed text."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

TEXT_DIM = 384  # fixed value: width of the text part of a feature vector


def standardise(value: Column, mean: float, std: float) -> Column:
    """(x - mean) / std; a constant column has std 0 and is only centred."""
    return (F.coalesce(value.cast("double"), F.lit(0.0)) - F.lit(mean)) / F.lit(std or 1.0)


def one_hot(value: Column, categories: Sequence[str]) -> Column:
    """Indicator array over ``categories``; null counts as ``NA``, an unknown value gives all zeros."""
    n = len(categories)
    if n == 0:
        return F.array().cast("array<double>")
    at = F.array_position(F.lit(list(categories)), F.coalesce(value, F.lit("NA"))).cast("int")
    zero, one = F.lit(0.0), F.array(F.lit(1.0))
    return F.when(
        at > 0, F.concat(F.array_repeat(zero, at - 1), one, F.array_repeat(zero, F.lit(n) - at))
    ).otherwise(F.array_repeat(zero, n))


def assemble(*parts: Column) -> Column:
    return F.concat(*[p.cast("array<double>") for p in parts]).cast("array<float>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos(a, b); a zero vector is at distance 1 from everything."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / F.nullif(size, F.lit(0.0)))


def normalise(a: Column) -> Column:
    """Unit vector in the direction of ``a``; a zero vector stays zero."""
    # The length is computed once per row: a lambda would evaluate it per element.
    doubles = a.cast("array<double>")
    size = F.array_repeat(norm(doubles), F.size(doubles))
    return F.zip_with(doubles, size, lambda x, n: F.when(n == 0, x).otherwise(x / n))


def hashed_text(df: DataFrame, text: str, out: str, dim: int = TEXT_DIM) -> DataFrame:
    """Add ``out``: unit-length counts of the text's words hashed into ``dim`` slots.

    This stands in for a pretrained sentence model, which is not part of Spark; pass a
    model of your own through :func:`model_text`.
    """
    words = F.filter(
        F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""
    )
    counted = HashingTF(numFeatures=dim, inputCol="__words", outputCol="__counts").transform(
        df.withColumn("__words", words)
    )
    # Scaled while still sparse, then spelled out.
    unit = Normalizer(p=2.0, inputCol="__counts", outputCol="__unit").transform(counted)
    return unit.withColumn(out, vector_to_array("__unit")).drop("__words", "__counts", "__unit")


def model_text(
    df: DataFrame, text: str, out: str, load: Callable[[], Callable], dim: int
) -> DataFrame:
    """Add ``out`` from a user's model: ``load()`` runs once per Python worker and returns a
    function from a list of strings to a 2-D array of ``dim`` columns."""
    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            vectors = np.asarray(model(texts.fillna("empty").tolist()), dtype="float64")
            if vectors.shape[1] != dim:
                raise ValueError(f"text model gave {vectors.shape[1]} columns, expected {dim}")
            length = np.linalg.norm(vectors, axis=1, keepdims=True)
            yield pd.Series(list(vectors / np.where(length == 0, 1.0, length)))

    return df.withColumn(out, embed(F.col(text)))
