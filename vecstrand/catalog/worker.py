"""Queries of the service around the corpus: snapshots, exports, admission of work and its accounting."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vecstrand.operators import signal as S
from vecstrand.sources.tables import FEATURES_VERSION, live, table
from vecstrand.streaming import jobs as J

QUERIES: dict = {}
SQL: dict[str, str] = {}

_LIVE = "analyzed_at IS NOT NULL AND duplicate_of IS NULL AND features_version = 4"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH p AS (SELECT left_id AS seed, right_id AS rec, max(score) AS score FROM match_pairs WHERE left_id <> right_id AND score IS NOT NULL GROUP BY 1, 2)
  SELECT seed, rec, place FROM (SELECT p.*, row_number() OVER (PARTITION BY seed ORDER BY score DESC, rec) AS place FROM p JOIN (SELECT track_id FROM tracks WHERE {_LIVE}) s ON s.track_id = p.rec) WHERE place <= 3""")
def snapshot_recs(spark, d):
    """Each seed's three best that the snapshot holds: it is filtered before the limit, so that what it lacks costs no place."""
    p = table(spark, d, "match_pairs").filter("left_id <> right_id AND score IS NOT NULL").groupBy(F.col("left_id").alias("seed"), F.col("right_id").alias("rec")).agg(F.max("score").alias("score"))
    held = p.join(live(table(spark, d, "tracks")).select(F.col("track_id").alias("rec")), "rec", "left_semi")
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "rec"))
    return held.withColumn("place", place).filter("place <= 3").select("seed", "rec", "place")


@query("""WITH asked AS (SELECT batch_no, track_id FROM arrivals WHERE batch_no IS NOT NULL GROUP BY ALL)
  SELECT batch_no, count(*) AS asked, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM tracks t WHERE t.track_id = a.track_id)) AS missing, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM tracks t WHERE t.track_id = a.track_id)) > 0 AS rebuild FROM asked a GROUP BY batch_no""")
def subset_rebuild(spark, d):
    """Whether the ids asked for are a subset of what is held; a snapshot that lacks one is built anew."""
    asked = table(spark, d, "arrivals").filter("batch_no IS NOT NULL").select("batch_no", "track_id").distinct()
    held = table(spark, d, "tracks").select("track_id", F.lit(1).alias("held"))
    missing = F.count(F.when(F.col("held").isNull(), 1))
    return asked.join(held, "track_id", "left").groupBy("batch_no").agg(F.count("*").alias("asked"), missing.alias("missing"), (missing > 0).alias("rebuild"))


_EDGES = "e AS (SELECT least(left_id, right_id) AS a, greatest(left_id, right_id) AS b, max(score) AS score FROM match_pairs WHERE left_id <> right_id AND score IS NOT NULL GROUP BY 1, 2)"


def _edges(spark, d):
    p = table(spark, d, "match_pairs").filter("left_id <> right_id AND score IS NOT NULL")
    return p.groupBy(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b")).agg(F.max("score").alias("score"))


@query(f"WITH {_EDGES}, r AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM e) SELECT min(score) AS least, max(score) FILTER (WHERE i = n // 2) AS median, max(score) AS most, count(*) AS edges FROM r")
def edge_scores(spark, d):
    """Least, (upper) median and greatest score of the graph's edges."""
    upper = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY score DESC)")
    return _edges(spark, d).agg(F.min("score").alias("least"), upper.alias("median"), F.max("score").alias("most"), F.count("*").alias("edges"))


@query(f"""WITH {_EDGES}, nodes AS (SELECT a AS id FROM e UNION SELECT b FROM e)
  SELECT 'node' AS part, '{{"id":' || to_json(id)::VARCHAR || ',"title":' || to_json(coalesce(t.title, ''))::VARCHAR || '}}' AS line FROM nodes JOIN tracks t ON t.track_id = nodes.id
  UNION ALL SELECT 'edge', '{{"source":"' || a || '","target":"' || b || '","score":' || round(score * 10000)::BIGINT || '}}' FROM e""")
def graph_export(spark, d):
    """The match graph as JSON lines: nodes that are in the corpus, and edges (scores in ten-thousandths)."""
    e = _edges(spark, d)
    ids = e.select(F.col("a").alias("track_id")).union(e.select("b")).distinct()
    titled = table(spark, d, "tracks").select("track_id", F.coalesce("title", F.lit("")).alias("title"))
    nodes = ids.join(titled, "track_id").select(F.lit("node").alias("part"), F.to_json(F.struct(F.col("track_id").alias("id"), "title")).alias("line"))
    edges = e.select(F.lit("edge").alias("part"), F.to_json(F.struct(F.col("a").alias("source"), F.col("b").alias("target"), F.round(F.col("score") * 10000).cast("long").alias("score"))).alias("line"))
    return nodes.unionByName(edges)


_KEPT = {"BRASS": "Winds", "COPPER": "Winds", "TIN": "Strings", "STEEL": "Strings"}


@query("""SELECT family, count(*) AS parts FROM (SELECT CASE w WHEN 'BRASS' THEN 'Winds' WHEN 'COPPER' THEN 'Winds' WHEN 'TIN' THEN 'Strings' WHEN 'STEEL' THEN 'Strings' ELSE 'Other' END AS family
  FROM (SELECT list_filter(string_split(p_type, ' '), lambda x: x IN ('BRASS', 'COPPER', 'TIN', 'STEEL'))[1] AS w FROM part)) GROUP BY family""")
def family_default(spark, d):
    """The family of the first word that has one, or the default."""
    known = F.create_map(*[F.lit(x) for pair in _KEPT.items() for x in pair])
    first = F.filter(F.transform(F.split("p_type", " "), lambda w: known[w]), lambda f: f.isNotNull())
    return table(spark, d, "part").select(F.coalesce(F.get(first, F.lit(0)), F.lit("Other")).alias("family")).groupBy("family").agg(F.count("*").alias("parts"))


@query("""WITH w AS (SELECT user_id, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) - 80 AS level, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS n FROM events WHERE value IS NOT NULL),
  k AS (SELECT user_id, level FROM w WHERE n = 3 AND level > -70) SELECT u.user_id, round(CASE WHEN count(level) < 2 THEN 0 ELSE quantile_cont(level, 0.95) - quantile_cont(level, 0.1) END, 6) AS loudness_range FROM (SELECT DISTINCT user_id FROM events WHERE value IS NOT NULL) u LEFT JOIN k USING (user_id) GROUP BY u.user_id""")
def loudness_ranges(spark, d):
    """Whole windows of three readings, one apart, without silent ones: the spread between the tenth and the ninety-fifth percentile."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(0, 2)
    w = table(spark, d, "events").filter("value IS NOT NULL").select("user_id", (F.avg("value").over(order) - 80).alias("level"), F.count("*").over(order).alias("n"))
    kept = F.when((F.col("n") == 3) & (F.col("level") > -70), F.col("level"))
    spread = F.percentile(kept, 0.95) - F.percentile(kept, 0.1)
    return w.groupBy("user_id").agg(F.round(F.when(F.count(kept) < 2, 0.0).otherwise(spread), 6).alias("loudness_range"))


_LATEST = "latest AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY claimed_at DESC NULLS LAST, created_at DESC NULLS LAST, attempts DESC NULLS LAST, state) = 1)"
_VERDICT = "(error LIKE 'decode%' OR error LIKE 'fetch: 404%')"


@query(f"WITH {_LATEST} SELECT track_id, count(*) AS attempts, count(*) FILTER (WHERE {_VERDICT}) AS verdicts, count(*) FILTER (WHERE {_VERDICT}) >= 3 AS retired FROM latest WHERE state = 'failed' AND track_id IS NOT NULL GROUP BY track_id")
def failure_accounts(spark, d):
    """Every failure counts as an attempt, only one about the row itself as a verdict; three verdicts retire the row."""
    failed = J.latest(table(spark, d, "jobs")).filter("state = 'failed' AND track_id IS NOT NULL")
    verdicts = F.count(F.when(~J.retryable(F.col("error")), 1))
    return failed.groupBy("track_id").agg(F.count("*").alias("attempts"), verdicts.alias("verdicts"), (verdicts >= 3).alias("retired"))


@query(f"""WITH RECURSIVE {_LATEST}, q AS (SELECT job_id, kind = 'embed' AS embed, row_number() OVER (ORDER BY created_at NULLS FIRST, job_id) AS n FROM (SELECT * FROM latest WHERE state = 'queued' ORDER BY created_at NULLS FIRST, job_id LIMIT 200)),
  f(n, g, size) AS (SELECT 0::BIGINT, 0, 3 UNION ALL SELECT q.n, CASE WHEN size >= 3 OR NOT q.embed THEN g + 1 ELSE g END, CASE WHEN NOT q.embed THEN 3 WHEN size >= 3 THEN 1 ELSE size + 1 END FROM f JOIN q ON q.n = f.n + 1)
  SELECT job_id, g AS claim FROM f JOIN q ON q.n = f.n""")
def group_claims(spark, d):
    """The next 200 queued jobs as claims of a worker: up to three analyses together, any other job alone and never lost."""
    queued = J.latest(table(spark, d, "jobs")).filter("state = 'queued'").orderBy(F.asc_nulls_first("created_at"), "job_id").limit(200)
    order = Window.orderBy(F.asc_nulls_first("created_at"), "job_id")  # at most 200 rows, the width of a claim round
    embed = F.col("kind") == "embed"
    run = queued.withColumn("others", F.sum(F.when(embed, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(order))
    within = Window.partitionBy("others", embed).orderBy("n")
    part = run.withColumn("slot", F.when(embed, F.floor((F.row_number().over(within) - 1) / 3)).otherwise(-1))
    first = part.withColumn("first", F.min("n").over(Window.partitionBy("others", "slot")))
    return first.select("job_id", F.dense_rank().over(Window.orderBy("first")).alias("claim"))


@query(f"SELECT DISTINCT a.track_id FROM arrivals a JOIN tracks t USING (track_id) WHERE t.features_version < {FEATURES_VERSION} AND octet_length(t.embedding) > 0")
def boot_priority(spark, d):
    """Stored rows of an older version that the batch asks for again: they are analysed first. Rows without features or of this version are not."""
    stale = table(spark, d, "tracks").filter((F.col("features_version") < FEATURES_VERSION) & (F.octet_length("embedding") > 0)).select("track_id")
    return stale.join(table(spark, d, "arrivals").select("track_id"), "track_id", "left_semi")


@query(f"SELECT DISTINCT a.track_id FROM arrivals a WHERE NOT EXISTS (SELECT 1 FROM tracks t WHERE t.track_id = a.track_id AND t.features_version = {FEATURES_VERSION})")
def resume_guard(spark, d):
    """What a resumed run has still to do: only rows stored at the current version are skipped."""
    stored = table(spark, d, "tracks").filter(F.col("features_version") == FEATURES_VERSION).select("track_id")
    return table(spark, d, "arrivals").select("track_id").distinct().join(stored, "track_id", "left_anti")


def cold_start(fixture, corpus, queue):
    """The fixture's rows, once each, if corpus and queue are both empty; else none."""
    held = corpus.select(F.lit(1).alias("x")).limit(1).unionByName(queue.select(F.lit(1).alias("x")).limit(1)).agg(F.count("*").alias("held"))
    return fixture.select("track_id").distinct().crossJoin(F.broadcast(held)).filter("held = 0").select("track_id")


@query("SELECT DISTINCT track_id FROM arrivals")
def cold_start_seeds(spark, d):
    """Seeding of an empty corpus with an empty queue."""
    return cold_start(table(spark, d, "arrivals"), table(spark, d, "tracks").filter("features_version > 1000"), table(spark, d, "jobs").filter("state = 'no such state'"))


@query("""WITH asked AS (SELECT DISTINCT 'attr:' || seed_id || ':' || rec_id AS cache_id FROM jobs WHERE seed_id IS NOT NULL AND rec_id IS NOT NULL),
  held AS (SELECT cache_id, value_json FROM cache_entries WHERE value_json IS NOT NULL AND (expires_at IS NULL OR expires_at > TIMESTAMP '2026-11-01 00:00:00'))
  SELECT state, count(*) AS requests FROM (SELECT CASE WHEN h.cache_id IS NULL THEN 'pending' WHEN h.value_json LIKE '%"error"%' THEN 'failed' ELSE 'ready' END AS state FROM asked a LEFT JOIN held h USING (cache_id)) GROUP BY state""")
def mailbox(spark, d):
    """Requests against what is kept of earlier results: an answer, a failure that is remembered until it expires, or work to enqueue."""
    asked = table(spark, d, "jobs").filter("seed_id IS NOT NULL AND rec_id IS NOT NULL").select(F.concat(F.lit("attr:"), "seed_id", F.lit(":"), "rec_id").alias("cache_id")).distinct()
    fresh = F.col("expires_at").isNull() | (F.col("expires_at") > F.lit("2026-11-01 00:00:00").cast("timestamp_ntz"))
    held = table(spark, d, "cache_entries").filter(F.col("value_json").isNotNull() & fresh).select("cache_id", "value_json")
    state = F.when(F.col("value_json").isNull(), "pending").when(F.contains("value_json", F.lit('"error"')), "failed").otherwise("ready")
    return asked.join(held, "cache_id", "left").groupBy(state.alias("state")).agg(F.count("*").alias("requests"))


@query("""WITH f AS (SELECT artist, min(struct_pack(t := coalesce(analyzed_at, TIMESTAMP '1970-01-01'), i := track_id)) AS seen FROM tracks WHERE artist IS NOT NULL GROUP BY artist),
  r AS (SELECT artist, row_number() OVER (ORDER BY seen, artist) AS n FROM f) SELECT artist, (n - 1) // 5 AS step FROM r WHERE n <= 200""")
def growing_roots(spark, d):
    """Names as they are first seen, five a step, until the crawl has its two hundred roots."""
    seen = F.min(F.struct(F.coalesce("analyzed_at", F.lit("1970-01-01").cast("timestamp_ntz")).alias("t"), F.col("track_id").alias("i")))
    first = table(spark, d, "tracks").filter("artist IS NOT NULL").groupBy("artist").agg(seen.alias("seen")).orderBy("seen", "artist").limit(200)
    return first.select("artist", F.floor((F.row_number().over(Window.orderBy("seen", "artist")) - 1) / 5).alias("step"))  # 200 rows


@query("""WITH b AS (SELECT n_nationkey AS k, 100.0 * (n_nationkey + 1) AS low, 100.0 * (n_nationkey + 1) + 40.0 * (n_nationkey % 4) + 5 AS high FROM nation),
  e AS (SELECT k, ceil(low * 256 / 8000)::INT AS f, floor(high * 256 / 8000)::INT AS l FROM b),
  g AS (SELECT k, i AS bin, CASE WHEN f > l OR l < 0 OR f >= 129 THEN 1.0::DOUBLE ELSE 0.5 - 0.5 * cos(pi() * least(greatest(f - i, i - l, 0), 5) / 5) END AS stop FROM e, range(129) t(i)) SELECT k, bin, round(stop, 9) AS stop, round(1 - stop, 9) AS solo FROM g""")
def band_gains(spark, d):
    """Stop and solo masks of a band for each nation's number: together one at every bin; a band between two bins stops nothing."""
    out = None
    for (k,) in table(spark, d, "nation").select("n_nationkey").orderBy("n_nationkey").collect():  # 25 bands
        low = 100.0 * (k + 1)
        part = spark.range(1).select(F.lit(k).alias("k"), F.posexplode(S.stop_gain(129, 8000, 256, low, low + 40.0 * (k % 4) + 5)).alias("bin", "stop"))
        out = part if out is None else out.unionByName(part)
    return out.select("k", F.col("bin").cast("long").alias("bin"), F.round("stop", 9).alias("stop"), F.round(1 - F.col("stop"), 9).alias("solo"))
