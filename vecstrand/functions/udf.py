"""Registration of the engine's functions for SQL: scalar, aggregate and table functions over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecstrand.functions.text import fold, normal_artist, normal_title


@F.pandas_udf(T.DoubleType())
def cosine_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y):
        if x is None or y is None or len(x) != len(y):
            return None
        n = float(np.linalg.norm(x) * np.linalg.norm(y))
        return float(np.dot(x, y)) / n if n else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def mean_vector(v: pd.Series) -> list:
    rows = [x for x in v if x is not None]
    return np.mean(np.array(rows, float), axis=0).tolist() if rows else []


@F.pandas_udf(T.StringType())
def exact_fold(s: pd.Series) -> pd.Series:
    return s.map(fold, na_action="ignore")


@F.pandas_udf(T.StringType())
def dedupe_key(title: pd.Series, artist: pd.Series) -> pd.Series:
    return pd.Series([f"{normal_artist(a)}|{normal_title(t)}" for t, a in zip(title, artist)])


@F.udtf(returnType="band int, low double, high double")
class LogBands:
    """log_bands(low, high, n): bands at equal ratios."""

    def eval(self, low: float, high: float, n: int):
        for k in range(n):
            yield k, low * (high / low) ** (k / n), low * (high / low) ** ((k + 1) / n)


def register(spark: SparkSession) -> None:
    spark.udf.register("cosine_similarity", cosine_similarity)
    spark.udf.register("mean_vector", mean_vector)
    spark.udf.register("exact_fold", exact_fold)
    spark.udf.register("dedupe_key", dedupe_key)
    spark.udtf.register("log_bands", LogBands)
