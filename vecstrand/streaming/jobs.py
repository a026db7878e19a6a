"""The job stream in batch: replays of an ordered event log, queues, backoff, breaker and expiring entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ATTEMPTS = 3


def latest(jobs: DataFrame) -> DataFrame:
    """Rows delivered twice come down to one a job: the latest claim, then creation."""
    order = [F.desc_nulls_last("claimed_at"), F.desc_nulls_last("created_at"), F.desc_nulls_last("attempts"), "state"]
    return jobs.withColumn("_n", F.row_number().over(Window.partitionBy("job_id").orderBy(*order))).filter("_n = 1").drop("_n")


def swept(jobs: DataFrame, as_of: Column, seconds: int = 600) -> DataFrame:
    """Running jobs claimed too long ago go back to the queue, or fail after MAX_ATTEMPTS claims."""
    late = (F.col("state") == "running") & (F.col("claimed_at") < as_of - F.make_dt_interval(secs=F.lit(seconds)))
    return jobs.withColumn("state", F.when(late & (F.col("attempts") >= MAX_ATTEMPTS), "failed").when(late, "queued").otherwise(F.col("state")))


def claims(jobs: DataFrame, limit: int) -> DataFrame:
    """The next jobs: analyses before attributions, oldest first."""
    queued = jobs.filter("state = 'queued'").withColumn("priority", F.when(F.col("kind") == "embed", 0).otherwise(1))
    return queued.orderBy("priority", F.asc_nulls_first("created_at"), "job_id").limit(limit)


def replay(events: DataFrame, key: str, order: list[str], kind: str) -> DataFrame:
    """(key, state, attempts) after all events of a key in order: enqueue, claim, complete, fail. A failed job can be enqueued again with no
    attempts; a completed one is gone. The fold runs over the key's own events, sorted in its group."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(kind).alias("k")))), lambda x: x["k"])
    start = F.struct(F.lit("none").alias("state"), F.lit(0).alias("attempts"))

    def step(s, k):
        queue = (k == "enqueue") & s["state"].isin("none", "failed")
        claim = (k == "claim") & (s["state"] == "queued")
        done = (k == "complete") & (s["state"] == "running")
        fail = (k == "fail") & (s["state"] == "running")
        state = F.when(queue, "queued").when(claim, "running").when(done, "none").when(fail, "failed").otherwise(s["state"])
        return F.struct(state.alias("state"), F.when(queue, 0).when(claim, s["attempts"] + 1).otherwise(s["attempts"]).alias("attempts"))

    out = events.groupBy(key).agg(F.aggregate(steps, start, step).alias("s"))
    return out.select(key, F.col("s.state").alias("state"), F.col("s.attempts").alias("attempts"))


def backoff(yields: Column, base: int = 60, most: int = 3600) -> Column:
    """The wait after a list of yields: doubled by each empty one up to a cap, reset by any other."""
    return F.aggregate(yields, F.lit(base), lambda w, y: F.when(y > 0, base).otherwise(F.least(F.lit(most), w * 2)))


def breaker(outcomes: Column, limit: int = 3) -> Column:
    """How often so many failures in a row would halt the stream; a halt and any success start the count anew."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("halts"))

    def step(s, ok):
        run = F.when(ok, 0).otherwise(s["run"] + 1)
        return F.struct(F.when(run >= limit, 0).otherwise(run).alias("run"), (s["halts"] + F.when(run >= limit, 1).otherwise(0)).alias("halts"))

    return F.aggregate(outcomes, start, step)["halts"]


def retryable(error: Column) -> Column:
    """Whether an error is about the world rather than about the row."""
    return ~(F.coalesce(error.startswith("decode"), F.lit(False)) | F.coalesce(error.startswith("fetch: 404"), F.lit(False)))


def snapshot_fresh(age: Column, held: Column, live: Column, missing: Column) -> Column:
    """A snapshot serves while it is young, the corpus has not shrunk or grown by a twentieth, and nothing asked for is missing from it."""
    return (age < 300) & (held <= live) & (live < held * 1.05) & (missing == 0)
