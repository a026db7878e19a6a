"""Vector arithmetic as Catalyst columns: higher-order functions inside whole-stage plans, no Python row ever made."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Null where the widths differ: zip_with would pad the shorter one with nulls."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """A zero vector stays zero."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.coalesce(F.nullif(n, F.lit(0.0)), F.lit(1.0)))


def cosine(a: Column, b: Column) -> Column:
    """0 beside a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.when(F.size(a) == F.size(b), F.lit(0.0)))


def euclidean(a: Column, b: Column) -> Column:
    """Similarity 1 / (1 + distance), in (0, 1]."""
    return 1 / (1 + F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)))


METRICS = {"cosine": cosine, "euclidean": euclidean}


def similarity(metric: str, a: Column, b: Column) -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}: one of {sorted(METRICS)}")
    return METRICS[metric](a, b)


def quantize(a: Column) -> Column:
    """struct<q array<int>, scale double>: scale is the greatest magnitude over 127 (1 for a zero vector), halves round to even."""
    scale = F.coalesce(F.nullif(F.array_max(F.transform(a, lambda x: F.abs(x.cast("double")))), F.lit(0.0)) / 127, F.lit(1.0))
    return F.struct(F.transform(a, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.rint(x.cast("double") / scale).cast("int")))).alias("q"), scale.alias("scale"))


def dequantize(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: x * scale)


def with_vectors(df: DataFrame, binary: str = "embedding", scale: str = "scale", into: str = "vec") -> DataFrame:
    """df with the int8 bytes of a row as array<double>, null where bytes or scale are. One Arrow pass; the bytes column stays behind."""
    fields = [f for f in df.schema.fields if f.name not in (binary, scale)]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, scale = b.column(0), b.column(1)
            if isinstance(raw, pa.BinaryArray) and not raw.null_count and not scale.null_count:
                # Without nulls the values are one buffer: scaled at once, cut by the row's offsets.
                offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
                data = np.frombuffer(raw.buffers()[2], np.int8)[offsets[0] : offsets[-1]] if len(raw) and raw.buffers()[2] else np.zeros(0, np.int8)
                values = data * np.repeat(scale.to_numpy().astype(np.float64), np.diff(offsets))
                vectors = pa.ListArray.from_arrays(pa.array(offsets - (offsets[0] if len(offsets) else 0), pa.int32()), pa.array(values))
            else:
                vectors = pa.array([None if v is None or s is None else np.frombuffer(v, np.int8) * np.float64(s) for v, s in zip(raw.to_pylist(), scale.to_pylist())], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(2 + i) for i in range(len(names))), vectors], [*names, into])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return df.select(binary, scale, *names).mapInArrow(run, f"{schema}, {into} array<double>")
