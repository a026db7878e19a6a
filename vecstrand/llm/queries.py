"""Queries of the training-data operators, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecstrand.llm import arrivals, bpe, components, leaks, names, neighbours, spam, survivors
from vecstrand.llm.oracles import ORACLE_SQL  # noqa: F401
from vecstrand.plans.durable import Scratch
from vecstrand.sources.tables import live, table, usable


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tracks in a group tied by duplicate_of, with their group_id."""
    tracks = table(spark, sf_dir, "tracks")
    groups = components.connected_components(spark, components.mark_links(tracks), Scratch(spark, "marks"))
    fields = ["track_id", "features_version", "analyzed_at", "album", "artwork_url", "attribution", "embedding", "feel", "rhythm"]
    return tracks.select(*fields).join(groups.select(F.col("node").alias("track_id"), F.col("component").alias("group_id")), "track_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.track_survivors(_marked(spark, sf_dir))


def p1_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p1_found, but vector, feel and rhythm of a group come from one features version."""
    return survivors.track_survivors(_marked(spark, sf_dir), agree=True)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.track_groups(spark, table(spark, sf_dir, "tracks"), table(spark, sf_dir, "match_pairs"))


def p2_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups there are of each size."""
    return p2_found(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("members")).groupBy("members").agg(F.count("*").alias("groups"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrivals.repeats(spark, table(spark, sf_dir, "tracks"), table(spark, sf_dir, "arrivals"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.variant_pairs(spark, table(spark, sf_dir, "tracks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(live(table(spark, sf_dir, "tracks"))).select(F.col("track_id").alias("id"), F.col("embedding").alias("vec"))
    return neighbours.k_nearest(spark, rows).select(F.col("id").alias("track_id"), F.col("neighbour").alias("neighbour_id"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with whether decoding its ids gives back its text (an empty text for a null one)."""
    documents = table(spark, sf_dir, "documents")
    back = bpe.decode_corpus(bpe.encode_corpus(documents)).withColumnRenamed("text", "back")
    return documents.select("doc_id", "text").join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("back")).alias("same"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.stuffed_pages(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p8_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stuffed pages and their figures, by language."""
    found = spam.stuffed_pages(table(spark, sf_dir, "documents"))
    return found.groupBy("language").agg(F.count("*").alias("pages"), *[F.round(F.avg(c), 4).alias(c) for c in ("top_word", "top_pair", "repeated_lines", "links", "separators", "function_words")])


QUERIES = {f.__name__: f for f in (p1_found, p1_consistent, p2_found, p2_sizes, p3_found, p4_found, p5_found, p6_ids, p6_round_trip, p7_found, p8_found, p8_figures)}
