"""File sources: catalogue JSON, cached analyses, audio containers, and a Python data source of catalogue payloads."""

from __future__ import annotations

import io
import json
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TRACK = "track_id string, title string, artist string, album string, artwork_url string, preview_url string"


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """{"tracks": [...]} files: one row a track."""
    return spark.read.schema(f"tracks array<struct<{TRACK.replace(' ', ': ').replace(',:', ',')}>>").option("multiLine", True).json(path).select(F.explode("tracks").alias("t")).select("t.*")


def read_analyses(spark: SparkSession, path: str, schema: str, version: int) -> DataFrame:
    """A folder of cached analyses, one JSON document a file; one of another version stops the read."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    stale = F.coalesce(F.col("version"), F.lit(0)) != version
    return rows.withColumn("version", F.when(stale, F.raise_error(F.lit("an analysis has another version"))).otherwise(F.col("version")))


def read_audio(spark: SparkSession, path: str, rate: int = 44_100, seconds: int = 30, least_bytes: int = 0) -> DataFrame:
    """(path, samples, error): WAV files as mono samples at the rate, at most so long. A file that cannot be read has an error instead of samples
    and never stops the others; less than a second is an error too."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") >= least_bytes).select("path", "content")

    def decode(content: bytes) -> np.ndarray:
        with wave.open(io.BytesIO(content)) as w:
            n, channels, own = w.getsampwidth(), w.getnchannels(), w.getframerate()
            if n != 2:
                raise ValueError("only 16-bit samples")
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, channels).mean(axis=1) / 32768
        if own != rate:
            x = np.interp(np.arange(int(len(x) * rate / own)) * own / rate, np.arange(len(x)), x)
        if len(x) < rate:
            raise ValueError("less than a second")
        return x[: seconds * rate]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    x, error = decode(c).astype(np.float32), None
                except Exception as e:  # one slot a file
                    x, error = None, f"{type(e).__name__}: {e}"[:500]
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([x], pa.list_(pa.float32())), pa.array([error], pa.string())], ["path", "samples", "error"])

    return files.mapInArrow(run, "path string, samples array<float>, error string")


class CatalogueSource(DataSource):
    """Pages of canned catalogue payloads: spark.read.format("vecstrand-catalogue").option("payloads", json).load(). Rows without an id or a name are
    dropped; a page is a partition."""

    @classmethod
    def name(cls) -> str:
        return "vecstrand-catalogue"

    def schema(self) -> str:
        return "track_id string, title string, artist string, attribution_url string"

    def reader(self, schema):
        return _Pages(json.loads(self.options.get("payloads", "[]")), int(self.options.get("page", "100")))


class _Pages(DataSourceReader):
    def __init__(self, rows: list[dict], page: int):
        self.rows, self.page = rows, page

    def partitions(self):
        return [InputPartition(at) for at in range(0, len(self.rows), self.page)] or [InputPartition(0)]

    def read(self, partition):
        for r in self.rows[partition.value : partition.value + self.page]:
            if r.get("id") is not None and r.get("name"):
                yield str(r["id"]), r["name"], r.get("artist_name"), r.get("shareurl") or None
