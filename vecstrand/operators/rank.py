"""Ranked similarity: metrics, corrections, blends, fusion, collapse and explanation.

A seed is one row: it is broadcast, the corpus is scanned once, and only a top-k leaves the executors (TakeOrderedAndProject).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecstrand.functions import vector as V
from vecstrand.plans.durable import Scratch

FEEL = 8


@dataclass(frozen=True)
class Axis:
    feature: str
    direction: int
    metric: str = "cosine"


#: Axes by name; register more to serve them.
AXES = {"sounds_like": Axis("vec", 1), "surprise": Axis("vec", -1)}


def checked(name: str, value: float, least: float, most: float) -> float:
    if not least <= value <= most:
        raise ValueError(f"{name} must be {least} to {most}, not {value}")
    return value


def seed_of(m: DataFrame, seed_id: str | None = None) -> DataFrame:
    """One row: the named seed, else the first that has every feature."""
    rows = m.filter(F.col("track_id") == seed_id) if seed_id is not None else m.filter(F.col("feel").isNotNull() & F.col("tempo").isNotNull()).orderBy("track_id").limit(1)
    return rows.select(F.col("track_id").alias("seed_id"), F.col("vec").alias("seed_vec"), F.col("feel").alias("seed_feel"), F.col("tempo").alias("seed_tempo"), F.col("dedupe_key").alias("seed_key"))


def scored(m: DataFrame, seed: DataFrame, metric: str = "cosine") -> DataFrame:
    """Every row with its similarity to the seed; rows of another width are refused, never scored as null."""
    both = m.crossJoin(F.broadcast(seed)).filter(F.size("vec") == F.size("seed_vec"))
    return both.withColumn("sim", V.similarity(metric, F.col("vec"), F.col("seed_vec")))


def top(rows: DataFrame, limit: int, by: str = "score") -> DataFrame:
    """Ties go to the smaller id: a total order, where a bare sort would leave one open."""
    checked("limit", limit, 1, 101)
    return rows.filter(F.col(by).isNotNull() & ~F.isnan(by)).orderBy(F.desc(by), "track_id").limit(limit)


def mean_vector(m: DataFrame, of: Column, width: int) -> DataFrame:
    """One row with the mean of a vector column: width aggregates, combined before the shuffle; no row is exploded."""
    return m.select(of.alias("v")).agg(F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(width)]).alias("mean"))


def centrality(m: DataFrame, width: int = 64) -> DataFrame:
    """Mean cosine with all rows, itself included: the product with the mean unit vector, so one pass for n * n similarities."""
    rows = m.withColumn("unit", V.unit(F.col("vec")))
    return rows.crossJoin(F.broadcast(mean_vector(rows, F.col("unit"), width))).withColumn("centrality", V.dot(F.col("unit"), F.col("mean"))).drop("unit", "mean")


#: Rows of a block of the euclidean centrality at least, and its blocks at most: each is a copy of the vectors in the shuffle.
BLOCK, BLOCKS = 8_000, 6
#: Rows by rows of a product that stays in a core's cache.
_TILE = (128, 1_024)
#: From so many rows on, pairs are summed in single precision, whose rounding the mean over the rows takes below some 1e-10; the share of two squared
#: norms below which a squared distance is taken again in double; the share of all rows above which a repeated row is.
SINGLE, NEAR, HEAVY = 65_536, 1 / 16, 1e-4


def euclidean_centrality(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows(track_id, embedding, scale) of equal width -> (track_id, centrality): mean euclidean similarity of the scaled vectors with all rows, itself
    included. No identity shortens it: each two different vectors meet once, in the pair of their blocks, and only sums leave a task. Vectors are
    packed, and there are few blocks however many rows, so the shuffle stays a few times the vectors; a task holds two blocks as int8. Many rows are
    summed in single precision (SINGLE), except pairs that are near or heavy."""
    same = rows.groupBy("embedding", "scale").agg(F.count("*").alias("times"))
    index = Scratch(rows.sparkSession, "centrality").save(same.withColumn("z", F.monotonically_increasing_id()))
    n, number = index.agg(F.coalesce(F.sum("times"), F.lit(0)), F.count("*")).first()
    most = max(BLOCKS, math.isqrt(2 * rows.sparkSession.sparkContext.defaultParallelism))
    blocks, single = min(max(1, -(-number // block)), most), number >= SINGLE

    def kind(width: int) -> np.dtype:
        return np.dtype([("z", "<i8"), ("times", "<i8"), ("scale", "<f4"), ("x", "i1", (width,))])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column(3).to_pylist()), np.int8).reshape(b.num_rows, -1)
            e = np.zeros(b.num_rows, kind(x.shape[1]))
            e["z"], e["times"], e["scale"], e["x"] = *(b.column(i).to_numpy() for i in range(3)), x
            at = ((e["z"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % blocks
            for a in np.unique(at).tolist():
                raw = e[at == a].tobytes()
                units = [min(a, other) * blocks + max(a, other) for other in range(blocks)]
                yield pa.RecordBatch.from_arrays([pa.array(units, pa.int32()), pa.array([a] * blocks, pa.int32()), pa.array([x.shape[1]] * blocks, pa.int32()), pa.array([raw] * blocks, pa.binary())], ["unit", "a", "width", "entries"])

    def summed(unit: int, sides: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        low, high = divmod(unit, blocks)
        if low not in sides or high not in sides:
            return
        left, right = (np.concatenate(sides[side]) for side in (low, high))
        totals = [np.zeros(len(left)), np.zeros(len(right))]

        def scaled(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            x = e["x"] * e["scale"].astype(np.float64)[:, None]
            return x, (x * x).sum(axis=1)

        def similar(here: np.ndarray, there: np.ndarray) -> np.ndarray:
            (u, own), (v, square) = scaled(here), scaled(there)
            both = own[:, None] + square
            gaps = u @ v.T
            gaps *= -2
            gaps += both
            # Vectors that are equal are at no distance; the difference would leave a trace of rounding.
            gaps[gaps < 1e-14 * both] = 0
            return gaps

        def wide(e: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(low, 1, -2 u, high, 1) by (1, low, v, 1, high) is the squared distance, low and high the parts of the square; with the squares, and
            whether they and the counts suit single precision. A square in one part would be off alike for all pairs of a row."""
            out, squares = np.ones((len(e), e["x"].shape[1] + 4), np.float32), np.zeros(len(e))
            for at in range(0, len(e), _TILE[1]):
                x, squares[at : at + _TILE[1]] = scaled(e[at : at + _TILE[1]])
                out[at : at + _TILE[1], 2:-2] = -2 * x if first else x
            out[:, -2 if first else -1] = squares
            out[:, 0 if first else 1] = squares - out[:, -2 if first else -1]
            return out, squares, single & (e["times"] <= HEAVY * n) & (squares > 1e-12) & (squares < 1e12)

        lefts, rights = (wide(left, True), wide(right, False)) if single else (None, None)
        for j in range(0, len(right), _TILE[1]):
            there = right[(to := slice(j, j + _TILE[1]))]
            # Two tiles of one block meet once; where they overlap, each row meets all others of it.
            for i in range(0, len(left) if low != high else min(len(left), j + _TILE[1]), _TILE[0]):
                here, close = left[(at := slice(i, i + _TILE[0]))], None
                if single and lefts[2][at].all() and rights[2][to].all():
                    gaps = lefts[0][at] @ rights[0][to].T
                    close = np.flatnonzero(gaps < np.float32(NEAR * (lefts[1][at].max() + rights[1][to].max())))
                if close is None or 8 * len(close) > gaps.size:
                    gaps = similar(here, there)
                elif len(close):
                    p, q = np.divmod(close, gaps.shape[1])
                    gaps[p, q] = ((scaled(here[p])[0] - scaled(there[q])[0]) ** 2).sum(axis=1)
                np.sqrt(gaps, out=gaps)
                gaps += 1
                np.reciprocal(gaps, out=gaps)
                # Sums of what is left of a common value round less.
                common = gaps.dtype.type(gaps[0].mean())
                gaps -= common
                totals[0][at] += gaps @ there["times"].astype(gaps.dtype) + float(common) * there["times"].sum()
                if low != high or i < j:
                    totals[low != high][to] += here["times"].astype(gaps.dtype) @ gaps + float(common) * here["times"].sum()
        for e, total in ((left, totals[0]), (right, totals[1]))[: 1 + (low != high)]:
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e["z"])), pa.array(total)], ["z", "total"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, sides = None, {}
        for b in batches:
            for u, a, width, raw in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                if u != unit:
                    yield from summed(unit, sides) if sides else ()
                    unit, sides = u, {}
                sides.setdefault(a, []).append(np.frombuffer(raw.as_buffer(), kind(width)))
        yield from summed(unit, sides) if sides else ()

    laid = index.select("z", "times", "scale", "embedding").mapInArrow(packed, "unit int, a int, width int, entries binary")
    laid = laid.repartitionById(blocks * blocks, F.col("unit")).sortWithinPartitions("unit")
    found = laid.mapInArrow(sums, "z long, total double").groupBy("z").agg((F.sum("total") / n).alias("centrality"))
    known = index.join(found, "z").select("embedding", "scale", "centrality")
    return rows.select("track_id", "embedding", "scale").join(known, ["embedding", "scale"]).select("track_id", "centrality")


def feel_spread(m: DataFrame) -> DataFrame:
    """Population deviation of each feel value over all servable rows, floored."""
    return m.filter(F.col("feel").isNotNull()).agg(F.array(*[F.greatest(F.coalesce(F.stddev_pop(F.get("feel", F.lit(i))), F.lit(1.0)), F.lit(1e-6)) for i in range(FEEL)]).alias("spread"))


def feel_distance(rec: Column, seed: Column, spread: Column) -> Column:
    """Mean of the differences in deviations; a missing feel is never a penalty."""
    parts = F.zip_with(F.zip_with(rec, seed, lambda a, b: F.abs(a - b)), spread, lambda x, s: x / s)
    return F.coalesce(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(spread), F.lit(0.0))


def tempo_distance(rec: Column, seed: Column) -> Column:
    """Octaves apart, double and half tempo folded, at most one half; a missing tempo is never a penalty."""
    d = F.log2(F.try_divide(seed, rec))
    # least() passes over nulls, so a missing tempo is settled first.
    return F.when(d.isNotNull(), F.least(F.abs(d), F.abs(d - 1), F.abs(d + 1), F.lit(0.5))).otherwise(0.0)


def blended(m: DataFrame, seed: DataFrame, feel: float = 0.3, tempo: float = 0.2) -> DataFrame:
    """Cosine less the weighted distances. A term of weight 0 leaves the plan: its scan and join are not made."""
    checked("feel", feel, 0, 3), checked("tempo", tempo, 0, 3)
    rows, score = scored(m, seed), F.col("sim")
    rows = rows.withColumn("feel_distance", F.lit(0.0)).withColumn("tempo_distance", F.lit(0.0))
    if feel:
        rows = rows.crossJoin(F.broadcast(feel_spread(m))).withColumn("feel_distance", feel_distance(F.col("feel"), F.col("seed_feel"), F.col("spread"))).drop("spread")
        score = score - feel * F.col("feel_distance")
    if tempo:
        rows = rows.withColumn("tempo_distance", tempo_distance(F.col("tempo"), F.col("seed_tempo")))
        score = score - tempo * F.col("tempo_distance")
    return rows.withColumn("score", score)


def percentile(rows: DataFrame, by: str, into: str) -> DataFrame:
    """Ordinal rank in per cent, ties by id. The rank is global by definition: range partitions are counted and offset, so no task holds all rows."""
    ordered = rows.repartitionByRange(F.col(by), F.col("track_id")).withColumn("_p", F.spark_partition_id())
    # Written, so that the number of a range is the same for whoever reads it.
    kept = Scratch(rows.sparkSession, "percentile").save(ordered)
    local = kept.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(by, "track_id")))
    counts = local.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    return local.join(F.broadcast(before.drop("_n")), "_p").withColumn(into, F.when(F.col("_all") < 2, 0.0).otherwise((F.col("_before") + F.col("_r") - 1) * 100.0 / (F.col("_all") - 1))).drop("_p", "_r", "_before", "_all")


def collapse(rows: DataFrame, limit: int, near: float = 0.995) -> DataFrame:
    """Greedy, in rank order: a row is refused for an accepted row's (or the seed's) key, or a cosine above near to an accepted row. A refused row
    claims nothing, so a window per key would be wrong. rows: at most 101 (a top-k), folded in one lambda."""
    item = F.struct(F.col("rank"), F.col("track_id"), F.col("dedupe_key").alias("key"), V.unit(F.col("vec")).alias("unit"), F.col("score"), F.col("seed_key"))
    kept = F.aggregate(
        F.array_sort(F.collect_list(item)),
        F.expr("cast(array() as array<struct<rank:int,track_id:string,key:string,unit:array<double>,score:double,seed_key:string>>)"),
        lambda acc, x: F.when(
            F.coalesce((x["key"] == x["seed_key"]) & (F.length(x["key"]) > 1), F.lit(False))
            | F.exists(acc, lambda a: F.coalesce((a["key"] == x["key"]) & (F.length(x["key"]) > 1), F.lit(False)) | (V.dot(a["unit"], x["unit"]) > near)),
            acc,
        ).otherwise(F.concat(acc, F.array(x))),
    )
    out = rows.agg(kept.alias("kept")).select(F.posexplode(F.slice("kept", 1, limit)).alias("position", "x"))
    return out.select("position", F.col("x.track_id").alias("track_id"), F.col("x.score").alias("score"))


def ranked(rows: DataFrame) -> DataFrame:
    """The rank of a top-k result (small by construction)."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "track_id")))
