"""Structured Streaming: increments, windows, de-duplication and keyed state.

All streams read files, so each query can be run to the end of what is there (availableNow) and again for what has come since; the checkpoint
holds the position. Stamps are naive UTC and become instants, which watermarks need.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from vecstrand.plans.durable import Scratch


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The events of one file, or of a folder of part files, as a stream with instants."""
    schema = spark.read.parquet(path).schema
    where = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        events = reader.parquet(path)
    else:
        events = reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Runs a stream to the end of its input into a table of the shared folder, and reads that.

    Complete output keeps the last state. Update output names its keys: every micro-batch is a folder of its own (written anew if the batch is
    repeated), and of each key the row of its last batch is read, so that keys no later batch touches stay. No input gives no rows.
    """
    if mode == "update" and not keys:
        raise ValueError("update output needs the keys that its rows replace")
    spark = stream.sparkSession
    scratch = Scratch(spark, "stream")
    out = f"{scratch.root}/out"
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", out).outputMode("append")
    else:

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

        writer = stream.writeStream.outputMode(mode).foreachBatch(keep)
    writer.option("checkpointLocation", f"{scratch.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not scratch.exists(out):
        return spark.createDataFrame([], stream.schema)
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(out)
    log = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x"))
    return last.select(*[F.col(c) if c in keys else F.col("x")[c].alias(c) for c in stream.columns])


def marked(events: DataFrame, late: str | None) -> DataFrame:
    """With a watermark, rows that come later than it are left out and state is dropped behind it; without one (late is None), as files in any
    order need, every row counts and all state is kept in the state store."""
    return events if late is None else events.withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    return marked(events, late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", slide: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    return marked(events, late).groupBy(F.window("ts", width, slide)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    return marked(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str | None = "10 minutes") -> DataFrame:
    """Each key once: within the watermark's reach, or ever."""
    return events.dropDuplicates(keys) if late is None else events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def tallies(events: DataFrame) -> DataFrame:
    """Keyed state of one's own: each user's events and longest run of one type, updated batch by batch. Events are put in order within a
    batch; from batch to batch the order is that of arrival, so a late event extends the run that is open when it comes."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, kind, run_now, longest = state.get if state.exists else (0, "", 0, 0)
        for b in batches:
            for k in b.sort_values(["ts", "event_id"])["event_type"]:
                n, run_now = n + 1, run_now + 1 if k == kind else 1
                kind, longest = k, max(longest, run_now)
        state.update((n, kind, run_now, longest))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "longest": [longest]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, longest long", "n long, kind string, run long, longest long", "update", GroupStateTimeout.NoTimeout)


def append_increment(spark: SparkSession, new: DataFrame, store: str, key: str, stamp: str) -> int:
    """Adds rows of new at or after the store's high-water mark whose key it lacks; returns how many. Inclusive, since stamps tie."""
    try:
        have = spark.read.parquet(store)
        mark = have.agg(F.max(stamp)).first()[0]
        fresh = new.filter(F.col(stamp) >= F.lit(mark)) if mark is not None else new
        fresh = fresh.join(have.select(key), key, "left_anti")
    except Exception as error:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        fresh = new
    fresh = Scratch(spark, "increment").save(fresh.dropDuplicates([key]))
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(store)
    return n
