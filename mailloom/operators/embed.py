"""Text to vectors: a model the user supplies, or hashed words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailloom.config import DEFAULT_CONFIG


def hashing_embed(df: DataFrame, text: str, output: str = "embedding", size: int = DEFAULT_CONFIG.embedding_size) -> DataFrame:
    """Counts of hashed words, scaled to length 1; the same for the same text anywhere."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+"), lambda w: w != "")
    counted = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=size).transform(df.withColumn("_words", words))
    scaled = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0).transform(counted)
    return scaled.withColumn(output, vector_to_array("_unit", "float32")).drop("_words", "_counts", "_unit")


def model_embed(
    df: DataFrame, text: str, model: Callable[[pd.Series], list], output: str = "embedding",
) -> DataFrame:
    """Vectors of a model that takes a series of texts; batches stream through each task."""
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[output] = [list(map(float, v)) for v in model(batch[text])]
            yield batch

    return df.mapInPandas(run, schema)


def embed(df: DataFrame, text: str, model: Callable[[pd.Series], list] | None = None, output: str = "embedding") -> DataFrame:
    return hashing_embed(df, text, output) if model is None else model_embed(df, text, model, output)
