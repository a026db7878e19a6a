"""Consolidating pairwise matches into groups: connected components by alternating large-star and small-star edge rewrites.

Every round is two aggregations and two joins; nothing but counts and the (bounded) list of heavy hubs reaches the driver. Rounds are cut by
tables in the shared folder, so a lost executor costs tasks, not rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecstrand.plans.durable import Scratch
from vecstrand.plans.skew import HEAVY_ROWS, HEAVY_SHARE, join_unique

#: Rounds are about log2 of the longest chain squared; this only stops a defect.
MAX_ROUNDS = 60


def _stats(edges: DataFrame) -> tuple[int, int]:
    n, h = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return n, int(h or 0)


def _seen(edges: DataFrame, large: bool) -> DataFrame:
    """Large star looks at both directions of every edge, small star from the greater end only."""
    seen = edges.select(F.col("u").alias("n"), F.col("v").alias("w"))
    return seen.unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("w"))) if large else seen


def _moved(met: DataFrame, least: DataFrame, large: bool) -> DataFrame:
    """Every neighbour (of the greater ones only, in large star) to the node's least one; in small star the node itself too."""
    moved = met.select(F.col("w").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def _star(edges: DataFrame, count: int, scratch: Scratch, large: bool) -> DataFrame:
    """One rewrite: large star moves greater neighbours to the least one seen; small star moves the node and its lesser neighbours there. A hub's
    least neighbour meets its edges by broadcast."""
    seen, rows = _seen(edges, large), 2 * count if large else count
    least = scratch.save(seen.groupBy("n").agg(F.least(F.col("n"), F.min("w")).alias("m"), F.count("*").alias("c")))
    bound = max(HEAVY_ROWS, int(rows * HEAVY_SHARE))
    heavy = [r[0] for r in least.filter(F.col("c") > bound).select("n").collect()] if rows > bound else []
    met = join_unique(seen.filter(F.col("w") > F.col("n")) if large else seen, least.select("n", "m"), "n", heavy=heavy)
    out = scratch.save(_moved(met, least, large))
    scratch.free(least)
    return out


def _both_stars(edges: DataFrame) -> DataFrame:
    """Both rewrites as one plan, where no hub can be heavy."""
    for large in (True, False):
        seen = _seen(edges, large)
        least = seen.groupBy("n").agg(F.least(F.col("n"), F.min("w")).alias("m"))
        edges = _moved((seen.filter(F.col("w") > F.col("n")) if large else seen).join(least, "n"), least, large)
    return edges


def connected_components(spark: SparkSession, links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """links(left, right) -> (node, component): every node of a link between two different nodes, with the least node it reaches.

    Nodes compare as Spark compares their type; strings by code point. Defined cases: null ends and self-links are no links (a node with no
    other link is absent from the result); repeated and reversed links count once; no links give no rows; other columns are ignored.
    """
    scratch = scratch or Scratch(spark, "components")
    left, right = F.col("left"), F.col("right")
    edges = scratch.save(links.filter(left.isNotNull() & right.isNotNull() & (left != right)).select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct())
    stats = _stats(edges)
    for _ in range(MAX_ROUNDS):
        if not stats[0]:
            break
        if 2 * stats[0] <= HEAVY_ROWS:
            narrow = scratch.save(_both_stars(edges))
            scratch.free(edges)
        else:
            wide = _star(edges, stats[0], scratch, large=True)
            narrow = _star(wide, stats[0], scratch, large=False)
            scratch.free(edges, wide)
        edges, before = narrow, stats
        stats = _stats(edges)
        if stats == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def mark_links(tracks: DataFrame) -> DataFrame:
    """Links by duplicate_of. A mark that names the row itself, or a track that is not there, links nothing."""
    marks = tracks.filter(F.col("duplicate_of").isNotNull() & F.col("track_id").isNotNull() & (F.col("duplicate_of") != F.col("track_id"))).select(F.col("track_id").alias("left"), F.col("duplicate_of").alias("right"))
    there = tracks.filter(F.col("track_id").isNotNull()).select(F.col("track_id").alias("right")).distinct()
    return join_unique(marks, there, "right", "left_semi").select("left", "right")


def keyed(df: DataFrame) -> DataFrame:
    """Rows whose stored key names a recording: text before and after the (first) pipe."""
    key = F.col("dedupe_key")
    return df.filter((F.trim(F.substring_index(key, "|", 1)) != "") & (F.instr(key, "|") > 0) & (F.trim(F.expr("substring(dedupe_key, instr(dedupe_key, '|') + 1)")) != ""))


def key_links(tracks: DataFrame, scratch: Scratch) -> DataFrame:
    """Links by equal stored keys: each row to the least id of its key, so that a key of n rows costs n links, not n * n."""
    rows = keyed(tracks.filter(F.col("track_id").isNotNull())).select("dedupe_key", "track_id")
    least = scratch.save(rows.groupBy("dedupe_key").agg(F.min("track_id").alias("left"), F.count("*").alias("c")).filter("c > 1"))
    bound = max(HEAVY_ROWS, int(tracks.count() * HEAVY_SHARE))
    heavy = [r[0] for r in least.filter(F.col("c") > bound).select("dedupe_key").collect()]
    return join_unique(rows, least.drop("c"), "dedupe_key", heavy=heavy).filter(F.col("left") != F.col("track_id")).select("left", F.col("track_id").alias("right"))


def pair_links(tracks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links by accepted pairs; pairs with an id that is not in tracks link nothing."""
    same = pairs.filter((F.col("verdict") == "same") & (F.col("left_id") != F.col("right_id"))).select(F.col("left_id").alias("left"), F.col("right_id").alias("right")).distinct()
    there = tracks.filter(F.col("track_id").isNotNull()).select("track_id").distinct()
    once = join_unique(same, there.withColumnRenamed("track_id", "left"), "left", "left_semi")
    return join_unique(once, there.withColumnRenamed("track_id", "right"), "right", "left_semi").select("left", "right")


def track_groups(spark: SparkSession, tracks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(track_id, group_id) of every track linked with another by its mark, its stored key or an accepted pair."""
    scratch = Scratch(spark, "groups")
    links = reduce(DataFrame.unionByName, [mark_links(tracks), key_links(tracks, scratch), pair_links(tracks, pairs)])
    return connected_components(spark, links, scratch).select(F.col("node").alias("track_id"), F.col("component").alias("group_id"))
