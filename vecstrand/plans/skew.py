"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most 1/HEAVY_SHARE keys can hold more than that share of the rows: the proven bound on what is broadcast.
HEAVY_SHARE = 1 / 1000
#: Below this many rows a key is no burden for a task.
HEAVY_ROWS = 250_000


def heavy_keys(df: DataFrame, key: str, rows: int | None = None) -> list:
    """Keys with more than max(HEAVY_ROWS, HEAVY_SHARE of all) rows; never more than 1 / HEAVY_SHARE of them."""
    rows = df.count() if rows is None else rows
    least = max(HEAVY_ROWS, int(rows * HEAVY_SHARE))
    if rows <= least:
        return []
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).count()
    return [r[0] for r in counts.filter(F.col("count") > least).select(key).collect()]


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "inner", heavy: list | None = None, rows: int | None = None) -> DataFrame:
    """left joined to right on key, where right has one row a key and left may be skewed.

    Heavy keys' rows of right (at most 1 / HEAVY_SHARE of them) are broadcast and meet left where it lies; only the rest is shuffled.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(how)
    heavy = heavy_keys(left, key, rows) if heavy is None else heavy
    if not heavy:
        return left.join(right, key, how)
    is_heavy: Column = F.col(key).isin(heavy)
    hot = left.filter(is_heavy).join(F.broadcast(right.filter(is_heavy)), key, how)
    rest = left.filter(~is_heavy | F.col(key).isNull()).join(right.filter(~is_heavy), key, how)
    return hot.unionByName(rest)
