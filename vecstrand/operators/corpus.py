"""Scans, look-ups, merges and predicates over the track corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecstrand.functions.text import dedupe_key_column
from vecstrand.functions.vector import with_vectors
from vecstrand.sources.tables import FEATURES_VERSION, live, usable

RHYTHM_KEYS = ("tempo_bpm", "beat_strength", "loudness_lufs", "loudness_range", "key", "mode", "key_strength")
DEFAULT_SOURCE = "halyard"
FEEL = 8


def matrix(tracks: DataFrame) -> DataFrame:
    """The servable vectors: (track_id, title, artist, dedupe_key, feel, tempo, analyzed_at, vec). LIVE and usability reach the scan; a feel of another
    width or with gaps, and a tempo of nothing, are absent."""
    feel = F.when((F.size("feel") == FEEL) & ~F.exists("feel", lambda x: x.isNull() | F.isnan(x)), F.col("feel"))
    tempo = F.when((F.col("rhythm.tempo_bpm") > 0) & ~F.isnan("rhythm.tempo_bpm"), F.col("rhythm.tempo_bpm"))
    rows = usable(live(tracks)).select("track_id", "title", "artist", "dedupe_key", feel.alias("feel"), tempo.alias("tempo"), "analyzed_at", "embedding", "scale")
    return with_vectors(rows)


def stale() -> Column:
    """Analysed, not retired, of an older version, not given up. A missing version is neither live nor stale."""
    return F.col("analyzed_at").isNotNull() & F.col("duplicate_of").isNull() & (F.col("features_version") < FEATURES_VERSION) & F.col("reanalysis_failed_at").isNull()


def since(tracks: DataFrame, stamp: Column) -> DataFrame:
    """Live rows analysed at or after the stamp; inclusive, since stamps tie, so readers drop ids they have."""
    return live(tracks).filter(F.col("analyzed_at") >= stamp)


def multi_get(requests: DataFrame, tracks: DataFrame) -> DataFrame:
    """requests(pos, track_id): one slot for each request, repeats and misses included."""
    return requests.join(tracks, "track_id", "left")


def contract(tracks: DataFrame) -> DataFrame:
    """The published fields; a preview address is never stored."""
    return tracks.select("track_id", "title", "artist", "album", "artwork_url", F.lit("").alias("preview_url"), "source", F.col("attribution.url").alias("attribution_url"))


def source_of(track_id: Column, source: Column) -> Column:
    """The stated source, else the prefix of a namespaced id, else the default."""
    prefix = F.when(F.instr(track_id, ":") > 1, F.substring_index(track_id, ":", 1))
    return F.coalesce(F.nullif(source, F.lit("")), prefix, F.lit(DEFAULT_SOURCE))


def with_meta(tracks: DataFrame) -> DataFrame:
    return tracks.withColumn("dedupe_key", dedupe_key_column(F.col("title"), F.col("artist"))).withColumn("source", source_of(F.col("track_id"), F.col("source")))


def readiness(tracks: DataFrame) -> Column:
    """Whether a named row may be a seed: its vector is current, of another version, or not there."""
    return F.when(F.col("embedding").isNull(), "unanalyzed").when(F.coalesce(F.col("features_version"), F.lit(0)) == FEATURES_VERSION, "ready").otherwise("stale")


def upsert(base: DataFrame, changes: DataFrame, key: str, order: str, keep: list[str]) -> DataFrame:
    """Latest change of a key wins; fields named in keep fall back to the older value where the change has none. One shuffle on the key."""
    changed = changes.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(order)))).filter("_n = 1").drop("_n")
    joined = base.alias("b").join(changed.alias("c"), key, "full_outer")
    out = [F.col(key)]
    for name in base.columns:
        if name == key:
            continue
        new, old = F.col(f"c.{name}"), F.col(f"b.{name}")
        seen = F.col(f"c.{order}").isNotNull()
        out.append((F.coalesce(new, old) if name in keep else F.when(seen, new).otherwise(old)).alias(name))
    return joined.select(*out)


def mark_duplicates(tracks: DataFrame, marks: DataFrame) -> DataFrame:
    """marks(track_id, primary): retired rows get their primary."""
    return tracks.join(marks, "track_id", "left").withColumn("duplicate_of", F.coalesce("primary", "duplicate_of")).drop("primary")


def backlog(tracks: DataFrame, as_of: Column, ttl_seconds: int, limit: int) -> DataFrame:
    """Rows to analyse again: fresh priorities first (newest first), then by last attempt, never attempted first."""
    fresh = F.coalesce(F.col("reanalyze_priority") >= as_of - F.make_dt_interval(secs=F.lit(ttl_seconds)), F.lit(False))
    queue = tracks.filter(stale()).select("track_id", fresh.alias("fresh"), "reanalyze_priority", "reanalysis_attempted_at", "analyzed_at")
    order = [F.desc("fresh"), F.when(F.col("fresh"), F.col("reanalyze_priority")).desc_nulls_last(), F.asc_nulls_first("reanalysis_attempted_at"), F.asc("analyzed_at"), F.asc("track_id")]
    return queue.orderBy(*order).limit(limit)


def write_corpus(tracks: DataFrame, path: str) -> None:
    """The corpus sink: the version is a partition, so LIVE prunes files; stamps are sorted, so increments prune row groups."""
    tracks.repartitionByRange("features_version", "analyzed_at").sortWithinPartitions("analyzed_at").write.partitionBy("features_version").mode("overwrite").parquet(path)


def text_search(tracks: DataFrame, needle: str) -> DataFrame:
    lower = needle.lower()
    return tracks.filter(F.contains(F.lower("title"), F.lit(lower)) | F.contains(F.lower("artist"), F.lit(lower)) | F.contains(F.lower("album"), F.lit(lower)))



def export_f32(df: DataFrame, key: str, binary: str, scale: str) -> DataFrame:
    """(key, code): int8 vectors, scaled, as base64 of little-endian float32."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(np.frombuffer(v, np.int8) * np.float64(s)).astype("<f4").tobytes() for v, s in zip(b.column(1), b.column(2).to_pylist()) for v in (v.as_buffer(),)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["key", "raw"])

    out = df.select(F.col(key).alias("key"), binary, scale).mapInArrow(run, f"key {kind}, raw binary")
    return out.select(F.col("key").alias(key), F.translate(F.base64("raw"), "\r\n", "").alias("code"))
