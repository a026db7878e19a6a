"""Wheel keys, tempo and tag scoring of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tempo tolerance in natural logarithms at unison and at half or double.
UNISON, OCTAVE = 0.06, 0.025


def wheel(key: Column, mode: Column) -> Column:
    """Position 1 to 12 on the wheel of fifths: a minor key stands with its relative major."""
    major = F.pmod(key * 7, F.lit(12))
    minor = F.pmod((key + 3) * 7, F.lit(12))
    return F.pmod(F.when(mode == "minor", minor).otherwise(major) + 7, F.lit(12)) + 1


def key_score(a: Column, mode_a: Column, b: Column, mode_b: Column) -> Column:
    apart = F.abs(wheel(a, mode_a) - wheel(b, mode_b))
    d = F.least(apart, 12 - apart)
    base = F.greatest(F.lit(0.0), 1 - d / 5)
    return F.when(d == 0, 1.0).when(mode_a != mode_b, base * 0.75).otherwise(base)


def tempo_score(a: Column, b: Column) -> Column:
    def one(times: float, sigma: float) -> Column:
        r = F.log(F.try_divide(a * times, b))
        return F.exp(-r * r / (2 * sigma * sigma))

    return F.coalesce(F.greatest(one(1.0, UNISON), one(0.5, OCTAVE), one(2.0, OCTAVE)), F.lit(0.0))


def connection(embedding: Column, tempo: Column, key: Column) -> Column:
    return 0.6 * F.greatest(F.lit(0.0), embedding) + 0.2 * tempo + 0.2 * key


def reasons(embedding: Column, tempo: Column, key: Column) -> Column:
    return F.array_compact(F.array(
        F.when(embedding >= 0.85, F.lit("very similar sound")).when(embedding >= 0.6, F.lit("similar sound")),
        F.when(tempo >= 0.8, F.lit("matching tempo")), F.when(key >= 1.0, F.lit("same key")).when(key >= 0.6, F.lit("compatible key")),
    ))


def shared_tags(a: Column, b: Column, n: int = 5, least: float = 0.1) -> Column:
    """Names among the first n tags of both whose score is above least."""
    pick = lambda t: F.transform(F.filter(F.slice(t, 1, n), lambda x: x["score"] > least), lambda x: x["name"])
    return F.array_intersect(pick(a), pick(b))


def families(tags: DataFrame, key: str, style: str, score: str, separator: str = "---", n: int = 5) -> DataFrame:
    """(key, family, score): scores summed by what stands before the separator (the whole style without one), the n greatest a key."""
    summed = tags.groupBy(key, F.substring_index(style, separator, 1).alias("family")).agg(F.sum(score).alias("score"))
    return summed.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "family"))).filter(F.col("_n") <= n).drop("_n")


def top_edges(edges: DataFrame, k: int = 6) -> DataFrame:
    """Edges (a, b, score) that are among the k best of either end."""
    both = edges.select("a", "b", "score", F.col("a").alias("end")).unionByName(edges.select("a", "b", "score", F.col("b").alias("end")))
    best = both.withColumn("n", F.row_number().over(Window.partitionBy("end").orderBy(F.desc("score"), "a", "b"))).filter(F.col("n") <= k)
    return best.select("a", "b", "score").distinct()


def round_robin(rows: DataFrame, source: str, order: str, key: str) -> DataFrame:
    """Lists interleaved by position, then source; each key at its first place."""
    placed = rows.withColumn("_turn", F.row_number().over(Window.partitionBy(source).orderBy(order)))
    first = placed.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_turn", source))).filter("_n = 1")
    return first.drop("_n").withColumnRenamed("_turn", "turn")
