"""Rows against rows in pairs of blocks: a task holds two blocks, however many rows there are."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_pairs(rows: DataFrame, key: str, blocks: Column) -> DataFrame:
    """rows with a, the row's block by a hash of key, and unit: a row comes once for each pair of blocks that its own is in, itself included."""
    split = rows.withColumn("_n", blocks.cast("long")).withColumn("a", F.pmod(F.xxhash64(key), F.col("_n")))
    both = split.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return both.withColumn("unit", F.least("a", "_b") * F.col("_n") + F.greatest("a", "_b")).drop("_n", "_b")


def units(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each run of equal values in the first so many columns, by which they are sorted."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        start = 0
        for i, k in enumerate(zip(*(b.column(c).to_pylist() for c in range(keys)))):
            if k != key:
                if i > start:
                    held.append(b.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, key, start = [], k, i
        if b.num_rows:
            held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)
