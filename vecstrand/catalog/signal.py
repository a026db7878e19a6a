"""Queries over signal formulas, key and tempo scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecstrand.catalog.rank import SEED
from vecstrand.operators import corpus as C
from vecstrand.operators import legacy as L
from vecstrand.operators import rank as R
from vecstrand.operators import signal as G
from vecstrand.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _waves(spark, d):
    """One wave a part: a sine of its own pitch."""
    return _wave(table(spark, d, "part"))


def _wave(parts):
    parts = parts.select(F.col("p_partkey").alias("id"), (110.0 + F.col("p_partkey") % 400).alias("hz"))
    return parts.withColumn("wave", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.round(F.sin(2 * 3.141592653589793 * F.col("hz") * i / 8000), 9)))


_WAVES = "waves AS (SELECT p_partkey AS id, 110.0::DOUBLE + p_partkey % 400 AS hz, list_transform(range(256), lambda i: round(sin(2 * 3.141592653589793::DOUBLE * (110.0::DOUBLE + p_partkey % 400) * i / 8000), 9)) AS wave FROM part)"


@query("SELECT k, round(20.0::DOUBLE * pow(1000.0::DOUBLE, k / 10.0::DOUBLE), 6) AS edge FROM range(0, 11) t(k)")
def band_edges(spark, d):
    return spark.range(1).select(F.posexplode(G.band_edges(20.0, 20000.0, 10)).alias("k", "edge")).select(F.col("k").cast("long").alias("k"), F.round("edge", 6).alias("edge"))


@query("SELECT band, round(700 * (pow(10.0::DOUBLE, (band * 2595 * log10(1 + 22050 / 700.0::DOUBLE) / 97) / 2595) - 1), 4) AS hz FROM range(0, 98) t(band)")
def mel_points(spark, d):
    top = 2595 * F.log10(1 + F.lit(22050) / 700.0)
    return spark.range(98).select(F.col("id").alias("band"), F.round(G.mel_to_hz(F.col("id") * top / 97), 4).alias("hz"))


@query("SELECT i, round(0.5 - 0.5 * cos(2 * 3.141592653589793::DOUBLE * i / 64), 9) AS periodic, round(0.5 - 0.5 * cos(2 * 3.141592653589793::DOUBLE * i / 63), 9) AS symmetric FROM range(0, 64) t(i)")
def hann_windows(spark, d):
    both = F.arrays_zip(G.hann(64).alias("p"), G.hann(64, False).alias("s"))
    return spark.range(1).select(F.posexplode(both).alias("i", "x")).select(F.col("i").cast("long").alias("i"), F.round("x.p", 9).alias("periodic"), F.round("x.s", 9).alias("symmetric"))


@query(f"WITH {_WAVES}, framed AS (SELECT id, f, list_sum(list_transform(wave[f * 32 + 1 : f * 32 + 64], lambda x: x * x)) AS energy FROM waves, range(0, 7) t(f)) SELECT id, f AS frame, round(greatest(10 * log10(greatest(energy, 1e-10)), -80), 6) AS db FROM framed")
def frame_levels(spark, d):
    framed = _waves(spark, d).select("id", F.posexplode(G.frames("wave", 64, 32)).alias("frame", "x"))
    return framed.select("id", F.col("frame").cast("long").alias("frame"), F.round(G.decibels(F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("db"))


@query(f"WITH {_WAVES} SELECT id, list_transform(range(10), lambda c: round(list_avg(wave[(256 * c // 10) + 1 : 256 * (c + 1) // 10]), 6) + 0.0) AS pooled FROM waves")
def ssm_pool(spark, d):
    return _waves(spark, d).select("id", F.transform(G.pool("wave", 10), lambda x: F.round(x, 6) + 0.0).alias("pooled"))


@query(f"""WITH {_WAVES}, cols AS (SELECT id, c, wave[c * 16 + 1 : c * 16 + 16] AS v FROM waves, range(0, 16) t(c)) SELECT a.id, a.c AS a, b.c AS b, round(list_cosine_similarity(a.v, b.v), 5) AS cosine FROM cols a JOIN cols b ON a.id = b.id""")
def ssm_gram(spark, d):
    """Self-similarity of the sixteen columns of each wave. Waves of one id are equal, so n of them are n * n rows."""
    parts = table(spark, d, "part").select("p_partkey")
    # Ids are small and their waves are not: the number of partitions is given, else adaptive execution makes one of all.
    tasks = max(spark.sparkContext.defaultParallelism, -(-parts.count() // 20_000))
    ids = parts.repartition(tasks, "p_partkey").groupBy("p_partkey").agg(F.count("*").alias("n"))
    each = ids.select("p_partkey", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") * F.col("n"))))
    columns = _wave(each).select("id", F.array(*[F.slice("wave", c * 16 + 1, 16) for c in range(16)]).alias("columns"))
    return G.self_similarity(columns, "id", "columns").withColumn("cosine", F.round("cosine", 5))


@query(f"""WITH {_WAVES}, s AS (SELECT id, wave, list_sort(wave) AS o FROM waves), l AS (SELECT id, wave, o[round_even(0.02 * 255, 0)::INT + 1] AS lo, o[round_even(0.98 * 255, 0)::INT + 1] AS hi FROM s)
  SELECT id, CASE WHEN hi <= lo THEN 0.5 ELSE round(greatest(0, least(1, (wave[40] - lo) / (hi - lo))), 6) END AS level FROM l""")
def ssm_stretch(spark, d):
    from vecstrand.operators.stats import percentile_round

    w = _waves(spark, d).withColumn("o", F.sort_array("wave"))
    low, high = percentile_round("o", 0.02), percentile_round("o", 0.98)
    return w.select("id", F.round(G.stretch(F.get("wave", F.lit(39)), low, high), 6).alias("level"))


@query(f"WITH {_WAVES} SELECT id, round(CASE WHEN list_max(list_transform(wave, lambda x: abs(x * 2))) > 0.98 THEN 0.98 / list_max(list_transform(wave, lambda x: abs(x * 2))) ELSE 1.0 END, 6) AS gain FROM waves")
def shared_gain(spark, d):
    return _waves(spark, d).withColumn("loud", F.transform("wave", lambda x: x * 2)).select("id", F.round(G.shared_gain("loud"), 6).alias("gain"))


@query()
def mel_spectrogram(spark, d):
    """Mean level of each mel band of each wave."""
    long = G.mel_spectrogram(_waves(spark, d), "id", "wave", 8000, 128, 64, 24)
    return long.groupBy("id", "band").agg(F.round(F.avg("db"), 4).alias("db"))


@query(f"""WITH {SEED}, k AS (SELECT track_id, rhythm.key AS key, rhythm.mode AS mode FROM tracks), w AS (SELECT s.track_id, s.seed_id, greatest(0, s.sim) AS e, s.tempo, s.seed_tempo,
    (CASE WHEN k.mode = 'minor' THEN (k.key + 3) * 7 % 12 ELSE k.key * 7 % 12 END + 7) % 12 + 1 AS a, (CASE WHEN z.mode = 'minor' THEN (z.key + 3) * 7 % 12 ELSE z.key * 7 % 12 END + 7) % 12 + 1 AS b, k.mode AS ma, z.mode AS mb
    FROM scored s JOIN k ON k.track_id = s.track_id JOIN k z ON z.track_id = s.seed_id WHERE k.key IS NOT NULL AND z.key IS NOT NULL),
  c AS (SELECT *, least(abs(a - b), 12 - abs(a - b)) AS d FROM w),
  t AS (SELECT *, CASE WHEN d = 0 THEN 1.0 WHEN ma <> mb THEN greatest(0, 1 - d / 5.0::DOUBLE) * 0.75 ELSE greatest(0, 1 - d / 5.0::DOUBLE) END::DOUBLE AS ks,
    coalesce(greatest(exp(-pow(ln(tempo / seed_tempo), 2) / (2 * 0.06 * 0.06)), exp(-pow(ln(tempo * 0.5 / seed_tempo), 2) / (2 * 0.025 * 0.025)), exp(-pow(ln(tempo * 2 / seed_tempo), 2) / (2 * 0.025 * 0.025))), 0.0) AS ts FROM c)
  SELECT track_id, round(0.6 * e + 0.2 * ts + 0.2 * ks, 6) AS score, round(ks, 6) AS key_score, round(ts, 6) AS tempo_score,
    len(list_filter([CASE WHEN e >= 0.85 THEN 'a' WHEN e >= 0.6 THEN 'b' END, CASE WHEN ts >= 0.8 THEN 'c' END, CASE WHEN ks >= 1.0 THEN 'd' WHEN ks >= 0.6 THEN 'e' END], lambda x: x IS NOT NULL)) AS reasons FROM t WHERE track_id <> seed_id""")
def connection_scores(spark, d):
    tracks = table(spark, d, "tracks")
    m = C.matrix(tracks)
    seed = R.seed_of(m)
    keys = tracks.select("track_id", F.col("rhythm.key").alias("key"), F.col("rhythm.mode").alias("mode")).filter("key IS NOT NULL")
    # The seed's own key is one row: joined before it is broadcast with the seed.
    whole = seed.join(keys.select(F.col("track_id").alias("seed_id"), F.col("key").alias("seed_k"), F.col("mode").alias("seed_m")), "seed_id")
    rows = R.scored(m, whole).filter("track_id <> seed_id").join(keys, "track_id")
    ks, ts, e = L.key_score(F.col("key"), F.col("mode"), F.col("seed_k"), F.col("seed_m")), L.tempo_score(F.col("tempo"), F.col("seed_tempo")), F.greatest(F.lit(0.0), F.col("sim"))
    return rows.select("track_id", F.round(L.connection(e, ts, ks), 6).alias("score"), F.round(ks, 6).alias("key_score"), F.round(ts, 6).alias("tempo_score"), F.size(L.reasons(e, ts, ks)).cast("long").alias("reasons"))


@query("""WITH e AS (SELECT DISTINCT least(left_id, right_id) AS a, greatest(left_id, right_id) AS b, max(score) OVER (PARTITION BY least(left_id, right_id), greatest(left_id, right_id)) AS score FROM match_pairs WHERE left_id <> right_id AND score IS NOT NULL),
  b AS (SELECT a, b, score, a AS e FROM e UNION ALL SELECT a, b, score, b FROM e) SELECT DISTINCT a, b, score FROM (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY e ORDER BY score DESC, a, b) <= 2)""")
def graph_topk_edges(spark, d):
    p = table(spark, d, "match_pairs").filter("left_id <> right_id AND score IS NOT NULL")
    edges = p.groupBy(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b")).agg(F.max("score").alias("score"))
    return L.top_edges(edges, 2)


@query("""WITH r AS (SELECT source, arrival_id, track_id, row_number() OVER (PARTITION BY source ORDER BY arrival_id) AS turn FROM arrivals WHERE source IS NOT NULL)
  SELECT track_id, source, turn FROM r QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY turn, source) = 1""")
def round_robin(spark, d):
    rows = table(spark, d, "arrivals").filter("source IS NOT NULL").select("source", "arrival_id", "track_id")
    return L.round_robin(rows, "source", "arrival_id", "track_id").select("track_id", "source", F.col("turn").cast("long").alias("turn"))
