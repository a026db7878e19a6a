"""Queries over the job log, expiring entries and the event stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vecstrand.sources.tables import table
from vecstrand.streaming import jobs as J
from vecstrand.streaming import streams as S

QUERIES: dict = {}
SQL: dict[str, str] = {}

_AS_OF = "2026-11-08 00:00:00"
_LATEST = "latest AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY claimed_at DESC NULLS LAST, created_at DESC NULLS LAST, attempts DESC NULLS LAST, state) = 1)"
_SWEPT = f"""{_LATEST}, swept AS (SELECT * REPLACE (CASE WHEN state = 'running' AND claimed_at < TIMESTAMP '{_AS_OF}' - INTERVAL 600 SECONDS THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END ELSE state END AS state) FROM latest)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _swept(spark, d):
    return J.swept(J.latest(table(spark, d, "jobs")), F.lit(_AS_OF).cast("timestamp_ntz"))


@query(f"WITH {_SWEPT} SELECT state, kind, count(*) AS jobs FROM swept GROUP BY ALL")
def job_states(spark, d):
    return _swept(spark, d).groupBy("state", "kind").agg(F.count("*").alias("jobs"))


@query(f"WITH {_SWEPT} SELECT job_id FROM swept WHERE state = 'queued' ORDER BY CASE WHEN kind = 'embed' THEN 0 ELSE 1 END, created_at NULLS FIRST, job_id LIMIT 20")
def priority_claims(spark, d):
    return J.claims(_swept(spark, d), 20).select("job_id")


@query(f"WITH {_LATEST} SELECT error LIKE 'decode%' OR error LIKE 'fetch: 404%' AS about_row, count(*) AS jobs FROM latest WHERE state = 'failed' AND error IS NOT NULL GROUP BY 1")
def failure_classes(spark, d):
    failed = J.latest(table(spark, d, "jobs")).filter("state = 'failed' AND error IS NOT NULL")
    return failed.groupBy((~J.retryable(F.col("error"))).alias("about_row")).agg(F.count("*").alias("jobs"))


_KINDS = "CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'claim' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'beat' END"


@query(f"""WITH RECURSIVE log AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, {_KINDS} AS k FROM events),
  fold(user_id, n, state, attempts) AS (SELECT DISTINCT user_id, 0::BIGINT, 'none', 0 FROM events
    UNION ALL SELECT f.user_id, l.n, CASE WHEN k = 'enqueue' AND state IN ('none', 'failed') THEN 'queued' WHEN k = 'claim' AND state = 'queued' THEN 'running' WHEN k = 'complete' AND state = 'running' THEN 'none' WHEN k = 'fail' AND state = 'running' THEN 'failed' ELSE state END,
      CASE WHEN k = 'enqueue' AND state IN ('none', 'failed') THEN 0 WHEN k = 'claim' AND state = 'queued' THEN attempts + 1 ELSE attempts END FROM fold f JOIN log l ON l.user_id = f.user_id AND l.n = f.n + 1)
  SELECT user_id, arg_max(state, n) AS state, arg_max(attempts, n)::INT AS attempts FROM fold GROUP BY user_id""")
def job_replay(spark, d):
    kinds = F.when(F.col("event_type") == "signup", "enqueue").when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "fail").otherwise("beat")
    return J.replay(table(spark, d, "events").withColumn("kind", kinds), "user_id", ["ts", "event_id"], "kind")


@query("""WITH RECURSIVE log AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type <> 'error' AS ok, event_type = 'purchase' AS paid FROM events),
  fold(user_id, n, run, halts, wait) AS (SELECT DISTINCT user_id, 0::BIGINT, 0, 0, 60 FROM events
    UNION ALL SELECT f.user_id, l.n, CASE WHEN ok OR run + 1 >= 3 THEN 0 ELSE run + 1 END, halts + CASE WHEN NOT ok AND run + 1 >= 3 THEN 1 ELSE 0 END, CASE WHEN paid THEN 60 ELSE least(3600, wait * 2) END FROM fold f JOIN log l ON l.user_id = f.user_id AND l.n = f.n + 1)
  SELECT user_id, arg_max(halts, n)::INT AS halts, arg_max(wait, n)::INT AS wait FROM fold GROUP BY user_id""")
def breaker_replay(spark, d):
    """Circuit breaker and idle backoff over each user's events in order."""
    lists = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    ok = F.transform("e", lambda x: x["event_type"] != "error")
    paid = F.transform("e", lambda x: F.when(x["event_type"] == "purchase", 1).otherwise(0))
    return lists.select("user_id", J.breaker(ok).alias("halts"), J.backoff(paid).alias("wait"))


@query("""SELECT user_id, value, ts FROM (SELECT user_id, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, max(ts) OVER () AS now FROM events) WHERE n = 1 AND ts + INTERVAL 6 HOURS > now""")
def ttl_cache(spark, d):
    """The last write of each key, if it has not expired."""
    e = table(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max_by(F.struct("value", "ts"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.value", "x.ts")
    now = e.agg(F.max("ts").alias("now"))
    return last.crossJoin(F.broadcast(now)).filter(F.col("ts") + F.expr("INTERVAL 6 HOURS") > F.col("now")).drop("now")


@query("""WITH days AS (SELECT date_trunc('day', ts) AS day, count(DISTINCT user_id) AS held FROM events GROUP BY 1), s AS (SELECT day, held, coalesce(lead(held) OVER (ORDER BY day), held) AS live FROM days)
  SELECT day, held, live, held <= live AND live < held * 1.05::DOUBLE AS fresh FROM s""")
def snapshot_policy(spark, d):
    days = table(spark, d, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count_distinct("user_id").alias("held"))
    s = days.withColumn("live", F.coalesce(F.lead("held").over(Window.orderBy("day")), F.col("held")))  # one row a day
    return s.withColumn("fresh", J.snapshot_fresh(F.lit(0), F.col("held"), F.col("live"), F.lit(0)))


def _stream(spark, d):
    return S.read_events(spark, f"{d}/events.parquet")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    return S.run(S.tumbling(_stream(spark, d), late=None), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) - h * INTERVAL 1 HOUR AS start, count(*) AS n FROM events, range(0, 2) t(h) GROUP BY 1")
def stream_sliding(spark, d):
    return S.run(S.sliding(_stream(spark, d), late=None), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS stop, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark, d):
    done = S.run(S.sessions(_stream(spark, d), late=None), "complete")
    return done.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("stop"), "n")


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT event_id, user_id, event_type FROM events) GROUP BY 1, 2")
def stream_dedupe(spark, d):
    """Events once each, though the stream may deliver them twice."""
    e = _stream(spark, d)
    return S.run(S.first_seen(e.unionByName(e), ["event_id"], late=None)).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events),
  l AS (SELECT user_id, event_type, g, count(*) AS n FROM r GROUP BY ALL) SELECT user_id, sum(n)::BIGINT AS n, max(n) AS longest FROM l GROUP BY user_id""")
def stream_state(spark, d):
    return S.run(S.tallies(_stream(spark, d)), "update", ["user_id"])
