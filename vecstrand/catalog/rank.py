"""Queries over ranking, fusion, statistics and explanation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vecstrand.catalog.corpus import MATRIX
from vecstrand.functions import vector as V
from vecstrand.operators import corpus as C
from vecstrand.operators import rank as R
from vecstrand.operators import stats as S
from vecstrand.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

SEED = f"""{MATRIX}, seed AS (SELECT * FROM corpus WHERE feel IS NOT NULL AND tempo IS NOT NULL ORDER BY track_id LIMIT 1),
scored AS (SELECT c.*, s.track_id AS seed_id, s.vec AS seed_vec, s.feel AS seed_feel, s.tempo AS seed_tempo, s.dedupe_key AS seed_key,
  list_cosine_similarity(c.vec, s.vec) AS sim, list_distance(c.vec, s.vec) AS gap FROM corpus c CROSS JOIN seed s)"""
SPREAD = "spread AS (SELECT " + ", ".join(f"greatest(stddev_pop(feel[{i}]), 1e-6) AS s{i}" for i in range(1, 9)) + " FROM corpus WHERE feel IS NOT NULL)"
BLEND = f"""{SEED}, {SPREAD}, parts AS (SELECT c.*, coalesce(({" + ".join(f"abs(feel[{i}] - seed_feel[{i}]) / s{i}" for i in range(1, 9))}) / 8, 0.0) AS fd,
  CASE WHEN tempo IS NULL OR seed_tempo IS NULL THEN 0.0 ELSE least(abs(log2(seed_tempo / tempo)), abs(log2(seed_tempo / tempo) - 1), abs(log2(seed_tempo / tempo) + 1), 0.5) END AS td FROM scored c CROSS JOIN spread),
blended AS (SELECT *, sim - 0.3 * fd - 0.2 * td AS score FROM parts)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _both(spark, d):
    m = C.matrix(table(spark, d, "tracks"))
    return m, R.seed_of(m)


@query(f"WITH {SEED} SELECT track_id, round(sim, 6) AS score FROM scored WHERE track_id <> seed_id ORDER BY sim DESC, track_id LIMIT 10")
def recommend_sounds_like(spark, d):
    m, seed = _both(spark, d)
    rows = R.scored(m, seed).filter("track_id <> seed_id").withColumn("score", F.col("sim"))
    return R.top(rows, 10).select("track_id", F.round("score", 6).alias("score"))


@query(f"WITH {SEED} SELECT track_id, round(1 / (1 + gap), 6) AS score FROM scored WHERE track_id <> seed_id ORDER BY gap, track_id LIMIT 10")
def euclid_topk(spark, d):
    m, seed = _both(spark, d)
    return R.top(R.scored(m, seed, "euclidean").filter("track_id <> seed_id").withColumn("score", F.col("sim")), 10).select("track_id", F.round("score", 6).alias("score"))


@query(f"WITH {BLEND} SELECT track_id, round(score, 6) AS score, round(fd, 6) AS feel_distance, round(td, 6) AS tempo_distance FROM blended WHERE track_id <> seed_id ORDER BY score DESC, track_id LIMIT 21")
def recommend_blended(spark, d):
    """The flagship: cosine less weighted feel and tempo distances, over-fetched for the collapse."""
    m, seed = _both(spark, d)
    rows = R.top(R.blended(m, seed).filter("track_id <> seed_id"), 21)
    return rows.select("track_id", F.round("score", 6).alias("score"), F.round("feel_distance", 6).alias("feel_distance"), F.round("tempo_distance", 6).alias("tempo_distance"))


@query(f"""WITH RECURSIVE {BLEND}, top AS (SELECT row_number() OVER (ORDER BY score DESC, track_id) AS rank, track_id, dedupe_key AS key, vec, score, seed_key FROM blended WHERE track_id <> seed_id ORDER BY score DESC, track_id LIMIT 21),
  fold(rank, track_id, score, ok, keys, vecs) AS (
    SELECT 0::BIGINT, NULL::VARCHAR, NULL::DOUBLE, false, []::VARCHAR[], []::DOUBLE[][]
    UNION ALL SELECT t.rank, t.track_id, t.score, x.ok, CASE WHEN x.ok AND length(t.key) > 1 THEN list_append(f.keys, t.key) ELSE f.keys END, CASE WHEN x.ok THEN list_append(f.vecs, t.vec) ELSE f.vecs END
    FROM fold f JOIN top t ON t.rank = f.rank + 1, LATERAL (SELECT NOT (coalesce(t.key = t.seed_key AND length(t.key) > 1, false) OR coalesce(list_contains(f.keys, t.key), false)
      OR len(list_filter(f.vecs, lambda v: list_cosine_similarity(v, t.vec) > 0.995)) > 0) AS ok) x)
  SELECT row_number() OVER (ORDER BY rank) - 1 AS position, track_id, round(score, 6) AS score FROM fold WHERE ok ORDER BY rank LIMIT 10""")
def recommend_collapsed(spark, d):
    m, seed = _both(spark, d)
    rows = R.ranked(R.top(R.blended(m, seed).filter("track_id <> seed_id"), 21))
    return R.collapse(rows, 10).select(F.col("position").cast("long").alias("position"), "track_id", F.round("score", 6).alias("score"))


_CENTRAL = f"""{SEED}, units AS (SELECT track_id, list_transform(vec, lambda x: x / sqrt(list_sum(list_transform(vec, lambda y: y * y)))) AS unit FROM corpus),
  means AS (SELECT list(m ORDER BY i) AS mean FROM (SELECT i, avg(unit[i]) AS m FROM units, range(1, 65) t(i) GROUP BY i)),
  central AS (SELECT track_id, list_dot_product(unit, mean) AS centrality FROM units, means)"""


@query(f"WITH {_CENTRAL} SELECT track_id, round(centrality, 6) AS centrality FROM central")
def centrality_cosine(spark, d):
    return R.centrality(C.matrix(table(spark, d, "tracks"))).select("track_id", F.round("centrality", 6).alias("centrality"))


@query(f"WITH {_CENTRAL} SELECT s.track_id, round(s.sim, 6) AS score, round(-(s.sim - c.centrality), 6) AS corrected FROM scored s JOIN central c USING (track_id) WHERE s.track_id <> s.seed_id ORDER BY -(s.sim - c.centrality) DESC, s.track_id LIMIT 10")
def recommend_surprise(spark, d):
    """The farthest, hubness taken off: sorted by the corrected value, reported with the raw one."""
    m, seed = _both(spark, d)
    axis = R.AXES["surprise"]
    rows = R.scored(R.centrality(m), seed).filter("track_id <> seed_id").withColumn("score", axis.direction * (F.col("sim") - F.col("centrality")))
    return R.top(rows, 10).select("track_id", F.round("sim", 6).alias("score"), F.round("score", 6).alias("corrected"))


@query(f"""WITH {_CENTRAL}, raw AS (SELECT track_id, row_number() OVER (ORDER BY sim, track_id) AS a FROM scored WHERE track_id <> seed_id QUALIFY a <= 10),
  fixed AS (SELECT s.track_id, row_number() OVER (ORDER BY s.sim - c.centrality, s.track_id) AS b FROM scored s JOIN central c USING (track_id) WHERE s.track_id <> s.seed_id QUALIFY b <= 10)
  SELECT coalesce(r.track_id, f.track_id) AS track_id, a AS raw_rank, b AS corrected_rank, a - b AS moved FROM raw r FULL OUTER JOIN fixed f ON r.track_id = f.track_id""")
def rank_movement(spark, d):
    """Raw and corrected rankings side by side."""
    m, seed = _both(spark, d)
    rows = R.scored(R.centrality(m), seed).filter("track_id <> seed_id")
    raw = R.ranked(R.top(rows.withColumn("score", -F.col("sim")), 10)).select("track_id", F.col("rank").cast("long").alias("raw_rank"))
    fixed = R.ranked(R.top(rows.withColumn("score", F.col("centrality") - F.col("sim")), 10)).select("track_id", F.col("rank").cast("long").alias("corrected_rank"))
    return raw.join(fixed, "track_id", "full_outer").withColumn("moved", F.col("raw_rank") - F.col("corrected_rank"))


@query(f"""WITH {SEED}, a AS (SELECT track_id, (row_number() OVER (ORDER BY round(sim, 9), track_id) - 1) * 100.0::DOUBLE / (count(*) OVER () - 1) AS p FROM scored),
  b AS (SELECT track_id, (row_number() OVER (ORDER BY round(f, 9), track_id) - 1) * 100.0::DOUBLE / (count(*) OVER () - 1) AS p FROM (SELECT track_id, list_cosine_similarity(feel, seed_feel) AS f FROM scored WHERE feel IS NOT NULL))
  SELECT a.track_id, round((0.6 * a.p + 0.4 * coalesce(b.p, 0.0)) / 100, 4) AS score FROM a LEFT JOIN b USING (track_id)""")
def percentile_fusion(spark, d):
    """Two feature spaces fused by ordinal percentiles; a row without the second feature has 0 there."""
    m, seed = _both(spark, d)
    rows = R.scored(m, seed).withColumn("by_sound", F.round("sim", 9))
    a = R.percentile(rows.select("track_id", "by_sound"), "by_sound", "pa").select("track_id", "pa")
    felt = rows.filter("feel IS NOT NULL").select("track_id", F.round(V.cosine(F.col("feel"), F.col("seed_feel")), 9).alias("by_feel"))
    b = R.percentile(felt, "by_feel", "pb").select("track_id", "pb")
    return a.join(b, "track_id", "left").select("track_id", F.round((0.6 * F.col("pa") + 0.4 * F.coalesce("pb", F.lit(0.0))) / 100, 4).alias("score"))


@query(f"""WITH {BLEND} SELECT track_id, round(list_dot_product(vec, seed_vec), 6) AS product, round(sqrt(list_dot_product(vec, vec)), 6) AS rec_norm, round(sqrt(list_dot_product(seed_vec, seed_vec)), 6) AS seed_norm,
  round(gap, 6) AS distance, round(tempo, 4) AS rec_tempo, round(seed_tempo, 4) AS seed_tempo FROM blended WHERE track_id <> seed_id ORDER BY score DESC, track_id LIMIT 10""")
def score_math(spark, d):
    m, seed = _both(spark, d)
    rows = R.top(R.blended(m, seed).filter("track_id <> seed_id"), 10)
    v, s = F.col("vec"), F.col("seed_vec")
    return rows.select(
        "track_id", F.round(V.dot(v, s), 6).alias("product"), F.round(V.norm(v), 6).alias("rec_norm"), F.round(V.norm(s), 6).alias("seed_norm"),
        F.round(1 / V.euclidean(v, s) - 1, 6).alias("distance"), F.round("tempo", 4).alias("rec_tempo"), F.round("seed_tempo", 4).alias("seed_tempo"),
    )


@query(f"WITH {MATRIX}, {SPREAD} SELECT unnest([{', '.join(f'round(s{i}, 6)' for i in range(1, 9))}]) AS spread, unnest(range(0, 8)) AS dim FROM spread")
def feel_sigma(spark, d):
    return R.feel_spread(C.matrix(table(spark, d, "tracks"))).select(F.posexplode("spread").alias("dim", "spread")).select(F.col("dim").cast("long").alias("dim"), F.round("spread", 6).alias("spread"))


@query("WITH q AS (SELECT list_transform(range(64), lambda i: sin(i + 1.0)) AS q) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 4) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 25")
def text_vector_search(spark, d):
    """A supplied query vector (a text encoder's output) against all rows."""
    q = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.sin(i + 1.0))
    rows = table(spark, d, "embeddings").withColumn("s", V.cosine(F.col("embedding"), q))
    return rows.orderBy(F.desc("s"), "vec_id").limit(25).select("vec_id", F.round("s", 4).alias("score"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, greatest(list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / 127, 1e-300) AS s FROM embeddings)
  SELECT vec_id, round(s, 9) AS scale, list_sum(list_transform(v, lambda x: abs(round_even(x / s, 0))))::BIGINT AS magnitude, round(list_max(list_transform(v, lambda x: abs(x - round_even(x / s, 0) * s))), 9) AS worst FROM e""")
def quantize_roundtrip(spark, d):
    e = table(spark, d, "embeddings").withColumn("q", V.quantize(F.col("embedding")))
    back = V.dequantize(F.col("q.q"), F.col("q.scale"))
    worst = F.array_max(F.zip_with("embedding", back, lambda a, b: F.abs(a.cast("double") - b)))
    return e.select("vec_id", F.round("q.scale", 9).alias("scale"), F.aggregate("q.q", F.lit(0).cast("long"), lambda s, x: s + F.abs(x)).alias("magnitude"), F.round(worst, 9).alias("worst"))


@query("SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))), 6)) AS unit FROM embeddings")
def unit_norm(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(V.unit(F.col("embedding")), lambda x: F.round(x, 6)).alias("unit"))


@query("SELECT vec_id, round(1 / (1 + exp(-25 * (embedding[1]::DOUBLE - embedding[2]::DOUBLE))), 6) AS score FROM embeddings")
def axis_scores(spark, d):
    """Zero-shot axis score: the softmax over two cosines is a logistic of their difference."""
    return table(spark, d, "embeddings").select("vec_id", F.round(1 / (1 + F.exp(-25 * (F.get("embedding", F.lit(0)).cast("double") - F.get("embedding", F.lit(1)).cast("double")))), 6).alias("score"))


@query(f"""WITH {SEED}, b AS (SELECT least(60, floor((sim + 1) * 30)::INT + 1) AS bin FROM scored WHERE track_id <> seed_id AND sim BETWEEN -1 AND 1)
  SELECT t.bin, round(-1 + (t.bin - 0.5) / 30, 6) AS centre, count(b.bin) AS n FROM range(1, 61) t(bin) LEFT JOIN b ON b.bin = t.bin GROUP BY t.bin""")
def cosine_histogram(spark, d):
    m, seed = _both(spark, d)
    return S.histogram(R.scored(m, seed).filter("track_id <> seed_id"), "sim").withColumn("bin", F.col("bin").cast("long"))


@query(f"""WITH {SEED}, v AS (SELECT sim FROM scored WHERE track_id <> seed_id), t AS (SELECT min(sim) AS threshold FROM (SELECT sim FROM v ORDER BY sim DESC LIMIT 10))
  SELECT round(any_value(threshold), 6) AS threshold, round(100.0 * avg(CASE WHEN sim <= threshold THEN 1 ELSE 0 END), 6) AS percentile, round(avg(sim), 6) AS mean, round(stddev_pop(sim), 6) AS sd, 0.0::DOUBLE AS null_mean, round(1 / sqrt(64), 6) AS null_sd FROM v, t""")
def histogram_summary(spark, d):
    m, seed = _both(spark, d)
    return S.summary(R.scored(m, seed).filter("track_id <> seed_id"), "sim", 64)


@query("SELECT event_type, round(median(value), 6) AS median, round(quantile_cont(value, 0.95) - quantile_cont(value, 0.1), 6) AS spread FROM events GROUP BY 1")
def value_spread(spark, d):
    """Percentiles with linear interpolation, as the loudness range takes them."""
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.percentile("value", 0.95) - F.percentile("value", 0.1), 6).alias("spread"))


@query(f"WITH {MATRIX}, f AS (SELECT track_id, list_sort(feel) AS s FROM corpus WHERE feel IS NOT NULL) SELECT track_id, s[floor(0.9 * 7)::INT + 1] AS p90, s[round_even(0.02 * 7, 0)::INT + 1] AS low, s[round_even(0.98 * 7, 0)::INT + 1] AS high FROM f")
def feel_percentiles(spark, d):
    """Percentiles by floor index and by rounded index over a row's array."""
    m = C.matrix(table(spark, d, "tracks")).filter("feel IS NOT NULL").withColumn("s", F.sort_array("feel"))
    return m.select("track_id", S.percentile_floor("s", 0.9).alias("p90"), S.percentile_round("s", 0.02).alias("low"), S.percentile_round("s", 0.98).alias("high"))


@query("""SELECT user_id, round(60 / median(gap), 6) AS per_minute FROM (SELECT user_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) WHERE gap IS NOT NULL GROUP BY user_id HAVING count(*) >= 2 AND median(gap) > 0""")
def median_rate(spark, d):
    """Median distance of consecutive beats (events) as a rate a minute; three beats at least."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    gaps = table(spark, d, "events").withColumn("gap", seconds - F.lag(seconds).over(w)).filter("gap IS NOT NULL")
    return gaps.groupBy("user_id").agg(F.count("*").alias("n"), F.percentile("gap", 0.5).alias("g")).filter("n >= 2 AND g > 0").select("user_id", F.round(60 / F.col("g"), 6).alias("per_minute"))


@query("SELECT user_id, count(*) AS events, round(count(*) * 60.0::DOUBLE / nullif(epoch(max(ts)) - epoch(min(ts)), 0), 6) AS per_minute FROM events GROUP BY 1")
def throughput(spark, d):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("events"), F.round(F.try_divide(F.count("*") * 60.0, F.max(seconds) - F.min(seconds)), 6).alias("per_minute"))
