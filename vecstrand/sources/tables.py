"""Readers of the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Version of the analysis whose vectors may be compared with each other.
FEATURES_VERSION = 4
#: Values of a current vector.
WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def live(tracks: DataFrame, version: int = FEATURES_VERSION) -> DataFrame:
    """Rows that enumerations may serve: analysed, not retired as a duplicate, of the current features version."""
    return tracks.filter(F.col("analyzed_at").isNotNull() & F.col("duplicate_of").isNull() & (F.col("features_version") == version))


def usable(tracks: DataFrame, width: int = WIDTH, version: int = FEATURES_VERSION) -> DataFrame:
    """Rows with a comparable vector: of the full width, scaled, not all zero, of the current version.

    All four tests are built-in expressions, so that the scan prunes and no vector reaches Python only to be thrown away.
    """
    silent = F.expr(f"cast(repeat(unhex('00'), {width}) as binary)")
    return tracks.filter(
        (F.col("features_version") == version)
        & (F.octet_length("embedding") == width)
        & (F.col("scale") > 0)
        & ~F.isnan("scale")
        & (F.col("embedding") != silent)
    )
