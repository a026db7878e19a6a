"""Queries over views, display values and the remaining scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecstrand.catalog.rank import SEED
from vecstrand.operators import corpus as C
from vecstrand.operators import display as D
from vecstrand.operators import graph as G
from vecstrand.operators import legacy as L
from vecstrand.operators import rank as R
from vecstrand.sources.tables import live, table, usable

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {SEED}, x AS (SELECT track_id FROM corpus ORDER BY track_id DESC LIMIT 3) SELECT track_id FROM (SELECT track_id FROM scored ORDER BY sim DESC, track_id LIMIT 500) UNION SELECT track_id FROM x")
def view_ids(spark, d):
    """The 500 rows nearest to the seed and three named extras."""
    m = C.matrix(table(spark, d, "tracks"))
    extra = [r[0] for r in m.select("track_id").orderBy(F.desc("track_id")).limit(3).collect()]
    view = G.View(m, R.seed_of(m), extra, 500)
    return view.map_rows(lambda ids, unit, rows: [(ids[i],) for i in rows], "track_id string")


@query(f"""WITH {SEED} SELECT a.track_id, round(avg(1 / (1 + list_distance(a.vec, b.vec))), 6) AS centrality FROM corpus a CROSS JOIN corpus b GROUP BY a.track_id""")
def centrality_euclid(spark, d):
    """Mean euclidean similarity of the scaled vectors with all usable rows, itself included."""
    rows = usable(live(table(spark, d, "tracks"))).select("track_id", "embedding", "scale")
    return R.euclidean_centrality(rows).withColumn("centrality", F.round("centrality", 6))


@query("SELECT p_partkey, round(p_size / 50.0::DOUBLE, 6) AS level, " + ", ".join(
    f"round(CASE WHEN l >= 4 THEN {s[4]} + ({s[5]} - {s[4]}) * (x - 4) WHEN l = 3 THEN {s[3]} + ({s[4]} - {s[3]}) * (x - 3) WHEN l = 2 THEN {s[2]} + ({s[3]} - {s[2]}) * (x - 2) WHEN l = 1 THEN {s[1]} + ({s[2]} - {s[1]}) * (x - 1) ELSE {s[0]} + ({s[1]} - {s[0]}) * x END, 4) AS {n}"
    for n, s in zip(("red", "green", "blue"), zip(*D.HEAT))) + " FROM (SELECT *, least(1, p_size / 50.0::DOUBLE) * 5 AS x, floor(least(1, p_size / 50.0::DOUBLE) * 5) AS l FROM part)")
def heat_colours(spark, d):
    level = F.col("p_size") / 50.0
    return table(spark, d, "part").select("p_partkey", F.round(level, 6).alias("level"), *[F.round(D.heat(level, c), 4).alias(n) for c, n in enumerate(("red", "green", "blue"))])


@query("SELECT track_id, round(greatest(0, least(1, (rhythm.loudness_lufs - (SELECT max(rhythm.loudness_lufs) FROM tracks) + 70) / 70)), 6) AS level FROM tracks WHERE rhythm.loudness_lufs IS NOT NULL")
def loudness_levels(spark, d):
    """Loudness on a 70 dB scale anchored at the corpus's peak."""
    t = table(spark, d, "tracks").select("track_id", F.col("rhythm.loudness_lufs").alias("db")).filter("db IS NOT NULL")
    return t.crossJoin(F.broadcast(t.agg(F.max("db").alias("peak")))).select("track_id", F.round(D.pixel_level(F.col("db"), F.col("peak")), 6).alias("level"))


@query("SELECT b AS bin, round(1000 * (1 / 30.0::DOUBLE) * exp(-pow(-1 + (b - 0.5) / 30 - 0.1, 2) / (2 * 0.125 * 0.125)) / (0.125 * sqrt(2 * pi())), 6) AS height FROM range(1, 61) t(b)")
def null_curve(spark, d):
    x = -1 + (F.col("id") - 0.5) / 30
    return spark.range(1, 61).select(F.col("id").alias("bin"), F.round(D.gaussian(x, 0.1, 0.125, F.lit(1000), 1 / 30), 6).alias("height"))


@query("""SELECT track_id, CASE WHEN coalesce(rhythm.key_strength, 0) > 0 THEN concat_ws(' ', (['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'])[rhythm.key + 1], rhythm.mode) ELSE '-' END AS key,
  CASE WHEN rhythm.tempo_bpm > 0 AND NOT isnan(rhythm.tempo_bpm) THEN round(rhythm.tempo_bpm, 0)::INT || ' BPM' ELSE '-' END AS tempo FROM tracks""")
def rhythm_text(spark, d):
    r = F.col("rhythm")
    return table(spark, d, "tracks").select("track_id", D.key_name(r["key"], r["mode"], r["key_strength"]).alias("key"), D.tempo_text(r["tempo_bpm"]).alias("tempo"))


@query("SELECT event_id, CASE WHEN isfinite(w) THEN greatest(0, least(2, w)) ELSE 0.3 END AS weight FROM (SELECT event_id, try_cast(CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'x' WHEN 2 THEN 'NaN' ELSE (value / 10)::VARCHAR END AS DOUBLE) AS w FROM events)")
def clamped_weights(spark, d):
    text = F.expr("CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'x' WHEN 2 THEN 'NaN' ELSE cast(value / 10 AS string) END")
    return table(spark, d, "events").select("event_id", D.clamped(text, 0.3, 0.0, 2.0).alias("weight"))


@query("SELECT track_id, substr(regexp_replace(title, '[^A-Za-z0-9 _-]', '_', 'g'), 1, 60) AS name FROM tracks WHERE title IS NOT NULL")
def file_names(spark, d):
    return table(spark, d, "tracks").filter("title IS NOT NULL").select("track_id", D.safe_name(F.col("title")).alias("name"))


@query("""SELECT track_id, (CASE WHEN rhythm.mode = 'minor' THEN (rhythm.key + 3) * 7 % 12 ELSE rhythm.key * 7 % 12 END + 7) % 12 + 1 AS wheel FROM tracks WHERE rhythm.key IS NOT NULL""")
def wheel_positions(spark, d):
    return table(spark, d, "tracks").filter("rhythm.key IS NOT NULL").select("track_id", L.wheel(F.col("rhythm.key"), F.col("rhythm.mode")).cast("int").alias("wheel"))


@query("""WITH w AS (SELECT doc_id, lower(w) AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS w FROM documents)), c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL),
  t AS (SELECT doc_id, w, n FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) <= 5) SELECT doc_id, list(w ORDER BY n DESC, w) AS tags, sum(n)::BIGINT AS weight FROM t GROUP BY doc_id""")
def top_tags(spark, d):
    """The five most frequent words of each document as its tags. Counted before the shuffle; the group limit prunes before the window's."""
    from pyspark.sql import Window

    words = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("w")).select("doc_id", F.lower("w").alias("w"))
    counts = words.groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "w"))).filter("r <= 5")
    return top.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]).alias("tags"), F.sum("n").alias("weight"))


@query("SELECT p_brand, family, score FROM (SELECT p_brand, split_part(p_type, ' ', 1) AS family, sum(p_size)::BIGINT AS score FROM part GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, family) <= 3")
def style_families(spark, d):
    """The three weightiest families of styles (the first word of a type) of each brand."""
    return L.families(table(spark, d, "part"), "p_brand", "p_type", "p_size", " ", 3)


@query("""SELECT n.n_name AS nation, count(DISTINCT s.s_suppkey) AS suppliers, count(l.l_partkey) AS lines FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey LEFT JOIN lineitem l ON l.l_suppkey = s.s_suppkey GROUP BY 1""")
def deep_cuts(spark, d):
    """Roots flattened two levels down (nation, supplier, line) and counted."""
    lines = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("l_partkey").alias("lines"))
    s = table(spark, d, "supplier").join(lines, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    per = s.groupBy("s_nationkey").agg(F.count("s_suppkey").alias("suppliers"), F.sum("lines").alias("lines"))
    return table(spark, d, "nation").join(per, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("n_name").alias("nation"), F.coalesce("suppliers", F.lit(0).cast("long")).alias("suppliers"), F.coalesce("lines", F.lit(0).cast("long")).alias("lines"))
