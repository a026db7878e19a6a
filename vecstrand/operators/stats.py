"""Distribution statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 60


def histogram(rows: DataFrame, value: str, bins: int = BINS) -> DataFrame:
    """Equal bins over [-1, 1], the last one closed, empty ones kept, values outside dropped. Counted before the shuffle: bins rows move."""
    inside = rows.filter(F.col(value).between(-1, 1)).select(F.least(F.lit(bins), F.floor((F.col(value) + 1) * (bins / 2)).cast("int") + 1).alias("bin"))
    every = rows.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    counts = inside.groupBy("bin").agg(F.count("*").alias("n"))
    return every.join(counts, "bin", "left").select("bin", F.round(-1 + (F.col("bin") - 0.5) / (bins / 2), 6).alias("centre"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def summary(rows: DataFrame, value: str, width: int, top: int = 10) -> DataFrame:
    """The tenth best value, its percentile, the corpus's mean and deviation, and those of random directions."""
    best = rows.orderBy(F.desc(value)).limit(top).agg(F.min(value).alias("threshold"))
    both = rows.crossJoin(F.broadcast(best))
    return both.agg(
        F.round(F.first("threshold"), 6).alias("threshold"), F.round(100.0 * F.avg(F.when(F.col(value) <= F.col("threshold"), 1).otherwise(0)), 6).alias("percentile"), F.round(F.avg(value), 6).alias("mean"),
        F.round(F.stddev_pop(value), 6).alias("sd"), F.lit(0.0).alias("null_mean"), F.lit(round(width**-0.5, 6)).alias("null_sd"),
    )


def percentile_floor(sorted_array: str, p: float) -> Column:
    return F.get(sorted_array, F.floor(p * (F.size(sorted_array) - 1)).cast("int"))


def percentile_round(sorted_array: str, p: float) -> Column:
    return F.get(sorted_array, F.rint(p * (F.size(sorted_array) - 1)).cast("int"))


def slice_max(values: str, rows: int) -> Column:
    """The greatest value of each of so many contiguous slices of an array, by integer division of positions; no more slices than values."""
    n = F.size(values)
    count = F.least(F.lit(rows), n)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda r: F.array_max(F.slice(values, F.floor(r * n / count).cast("int") + 1, F.floor((r + 1) * n / count).cast("int") - F.floor(r * n / count).cast("int"))))
