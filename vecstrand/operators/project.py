"""Principal components of the corpus by partial Gram sums, extremes and the grand tour."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecstrand.functions import vector as V
from vecstrand.plans.durable import Scratch

COMPONENTS = 8


def gram(m: DataFrame, width: int = 64) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, sum, sum of outer products) of the unit vectors: one matrix a task reaches the driver, width x width, whatever the corpus."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, np.zeros(width), np.zeros((width, width))
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            norms = np.linalg.norm(x, axis=1, keepdims=True)
            x = x / np.where(norms == 0, 1, norms)
            n, s, g = n + len(x), s + x.sum(axis=0), g + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([g.ravel().tolist()])], ["n", "s", "g"])

    parts = m.filter(F.size("vec") == width).select("vec").mapInArrow(partial, "n long, s array<double>, g array<double>")
    # Summed on the executors, cell by cell, so the driver receives one row.
    cells = parts.select("n", F.posexplode(F.concat("s", "g")).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("at").collect()
    values = np.array([r["x"] for r in cells])
    return int(cells[0]["n"]) if cells else 0, values[:width], values[width:].reshape(width, width)


def principal(m: DataFrame, width: int = 64, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(mean, directions, variance fractions, total) of the centred unit vectors. Fewer than two rows give nothing but zeros."""
    n, s, g = gram(m, width)
    if n < 2:
        return np.zeros(width), np.zeros((width, components)), np.zeros(components), 0.0
    mean = s / n
    values, directions = np.linalg.eigh(g - n * np.outer(mean, mean))
    values, directions = np.clip(values[::-1], 0, None), directions[:, ::-1]
    total = float(values.sum())
    return mean, directions[:, :components], values[:components] / total if total else np.zeros(components), total


def coordinates(m: DataFrame, width: int = 64, components: int = COMPONENTS) -> tuple[DataFrame, np.ndarray]:
    """(track_id, coords) and the variance fractions. Each component's coordinate of greatest magnitude is positive (the lowest id's on ties)."""
    mean, directions, fractions, _ = principal(m, width, components)
    axes = [F.array(*[F.lit(float(x)) for x in directions[:, c]]) for c in range(components)]
    offsets = mean @ directions
    rows = m.withColumn("unit", V.unit(F.col("vec")))
    raw = rows.select("track_id", F.array(*[V.dot(F.col("unit"), a) - float(o) for a, o in zip(axes, offsets)]).alias("coords"))
    # Read twice or more by whoever asks: projected once.
    raw = Scratch(m.sparkSession, "coordinates").save(raw)
    signs = raw.agg(*[F.min_by(F.signum(F.get("coords", F.lit(c))), F.struct(-F.abs(F.get("coords", F.lit(c))), "track_id")).alias(f"s{c}") for c in range(components)])
    flipped = raw.crossJoin(F.broadcast(signs))
    return flipped.select("track_id", F.array(*[F.get("coords", F.lit(c)) * F.when(F.col(f"s{c}") < 0, -1.0).otherwise(1.0) for c in range(components)]).alias("coords")), fractions


def extremes(coords: DataFrame, component: int, limit: int = 5) -> DataFrame:
    """The lowest and highest rows of a component, ties by id."""
    rows = coords.select("track_id", F.get("coords", F.lit(component)).alias("value"))
    low = rows.orderBy("value", "track_id").limit(limit).withColumn("end", F.lit("low"))
    return low.unionByName(rows.orderBy(F.desc("value"), "track_id").limit(limit).withColumn("end", F.lit("high")))


def tour_frame(t: float, width: int = COMPONENTS) -> np.ndarray:
    """Two orthonormal directions at time t: a product of plane rotations in fixed order, each at its own irrational speed."""
    primes, n = [], 2
    while len(primes) < width * (width - 1) // 2:
        if all(n % p for p in primes):
            primes.append(n)
        n += 1
    frame, k = np.eye(width), 0
    for i in range(width):
        for j in range(i + 1, width):
            c, s = np.cos(t * 0.05 * primes[k] ** 0.5), np.sin(t * 0.05 * primes[k] ** 0.5)
            a, b = frame[:, i].copy(), frame[:, j].copy()
            frame[:, i], frame[:, j] = c * a + s * b, c * b - s * a
            k += 1
    return frame[:, :2]


def tour(coords: DataFrame, t: float) -> DataFrame:
    frame = tour_frame(t)
    x, y = (F.array(*[F.lit(float(v)) for v in frame[:, c]]) for c in range(2))
    return coords.select("track_id", V.dot(F.col("coords"), x).alias("x"), V.dot(F.col("coords"), y).alias("y"))


def fit(points: DataFrame, size: float = 1.0) -> DataFrame:
    """Points moved and scaled, both ways alike, into a square; no extent gives the middle."""
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    scale = F.coalesce(F.try_divide(F.lit(size), span), F.lit(0.0))
    both = points.crossJoin(F.broadcast(box))
    return both.select("track_id", ((F.col("x") - (F.col("x0") + F.col("x1")) / 2) * scale + size / 2).alias("x"), ((F.col("y") - (F.col("y0") + F.col("y1")) / 2) * scale + size / 2).alias("y"))


def nearest_point(points: DataFrame, x: float, y: float, most: float) -> DataFrame:
    """The point nearest to (x, y), if it is within most."""
    d = F.sqrt((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2)
    return points.withColumn("distance", d).filter(F.col("distance") <= most).orderBy("distance", "track_id").limit(1)
