"""Queries over graphs, projections and vector de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecstrand.catalog.rank import SEED
from vecstrand.functions.text import dedupe_key_column, normal_artist_column
from vecstrand.operators import corpus as C
from vecstrand.operators import dedupe as D
from vecstrand.operators import graph as G
from vecstrand.operators import project as P
from vecstrand.operators import rank as R
from vecstrand.operators import stats as S
from vecstrand.sources.tables import live, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

_VIEW = f"""{SEED}, view AS (SELECT track_id, vec FROM scored ORDER BY sim DESC, track_id LIMIT 8000),
pairs AS (SELECT a.track_id AS src, b.track_id AS dst, round(1 - list_cosine_similarity(a.vec, b.vec), 9) AS distance FROM view a JOIN view b ON a.track_id <> b.track_id),
knn AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY src ORDER BY distance, dst) <= 8)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _view(spark, d) -> G.View:
    m = C.matrix(table(spark, d, "tracks"))
    return G.View(m, R.seed_of(m))


@query(f"WITH {_VIEW} SELECT src, dst, round(distance, 6) AS distance FROM knn")
def knn_edges(spark, d):
    return G.knn_edges(_view(spark, d)).withColumn("distance", F.round("distance", 6))


@query(f"WITH {_VIEW} SELECT src, dst, round(min(distance), 6) AS distance FROM (SELECT * FROM knn UNION ALL SELECT dst, src, distance FROM knn) GROUP BY src, dst")
def knn_symmetric(spark, d):
    return G.symmetric(G.knn_edges(_view(spark, d))).withColumn("distance", F.round("distance", 6))


@query(f"WITH {_VIEW}, counts AS (SELECT dst, count(*) AS n FROM knn GROUP BY dst), means AS (SELECT src, avg(1 - distance) AS c FROM pairs GROUP BY src) SELECT v.track_id, coalesce(n, 0) AS count, round(c, 6) AS centrality FROM view v LEFT JOIN counts ON dst = v.track_id JOIN means ON src = v.track_id")
def hub_counts(spark, d):
    return G.hubs(_view(spark, d)).withColumn("centrality", F.round("centrality", 6))


@query(f"""WITH {_VIEW}, counts AS (SELECT v.track_id, count(k.dst) AS n FROM view v LEFT JOIN knn k ON k.dst = v.track_id GROUP BY 1), means AS (SELECT src AS track_id, avg(1 - distance) AS c FROM pairs GROUP BY src)
  (SELECT 'hub' AS list, track_id FROM counts ORDER BY n DESC, track_id LIMIT 5) UNION ALL (SELECT 'central', track_id FROM means ORDER BY round(c, 9) DESC, track_id LIMIT 5) UNION ALL (SELECT 'isolated', track_id FROM means ORDER BY round(c, 9), track_id LIMIT 5)""")
def hub_lists(spark, d):
    h = G.hubs(_view(spark, d)).withColumn("c", F.round("centrality", 9))
    lists = {"hub": [F.desc("count")], "central": [F.desc("c")], "isolated": [F.col("c")]}
    out = None
    for name, order in lists.items():
        part = h.orderBy(*order, "track_id").limit(5).select(F.lit(name).alias("list"), "track_id")
        out = part if out is None else out.unionByName(part)
    return out


@query()
def mst_edges(spark, d):
    return G.spanning_tree(_view(spark, d)).withColumn("distance", F.round("distance", 6))


@query()
def h0_barcode(spark, d):
    """The barcode in at most 60 bars: the longest of each slice."""
    bars = G.barcode(_view(spark, d)).agg(F.transform(F.array_sort(F.collect_list(F.struct("bar", "death"))), lambda x: x["death"]).alias("deaths"))
    return bars.select(F.posexplode(S.slice_max("deaths", 60)).alias("bar", "death")).withColumn("death", F.round("death", 6))


@query(f"""WITH RECURSIVE {SEED}, view AS (SELECT track_id, vec FROM scored ORDER BY sim DESC, track_id LIMIT 8000),
  near AS (SELECT a.track_id AS a, b.track_id AS b FROM view a JOIN view b ON a.track_id <> b.track_id AND round(1 - list_cosine_similarity(a.vec, b.vec), 9) <= 0.02),
  reached(a, b) AS (SELECT track_id, track_id FROM view UNION SELECT r.a, n.b FROM reached r JOIN near n ON n.a = r.b) SELECT a AS track_id, min(b) AS component FROM reached GROUP BY a""")
def h0_components(spark, d):
    return G.components_at(_view(spark, d), 0.02)


@query()
def knn_walk(spark, d):
    """From the seed to the row least like it of all that its graph connects."""
    m = C.matrix(table(spark, d, "tracks"))
    seed = R.seed_of(m)
    return G.walk(G.View(m, seed), seed.first()["seed_id"]).select("hops", F.round("geodesic", 6).alias("geodesic"), F.round("ambient", 6).alias("ambient"), F.round("detour", 6).alias("detour"), F.array_join("path", ">").alias("path"))


@query("""WITH RECURSIVE edges AS (SELECT n.n_nationkey AS src, o.n_nationkey AS dst FROM nation n JOIN nation o ON n.n_regionkey = o.n_regionkey OR n.n_nationkey = o.n_nationkey + 1),
  hop(node, h) AS (SELECT 0, 0 UNION SELECT e.dst, h + 1 FROM hop JOIN edges e ON e.src = hop.node WHERE h < 3) SELECT node, min(h) AS hop FROM hop GROUP BY node""")
def snowball_bfs(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    o = n.select(F.col("k").alias("k2"), F.col("r").alias("r2"))
    same = n.join(o, F.col("r") == F.col("r2"))
    next_to = n.join(o, F.col("k") == F.col("k2") + 1)
    edges = same.unionByName(next_to).select(F.col("k").alias("src"), F.col("k2").alias("dst")).distinct()
    return G.bfs(edges, spark.createDataFrame([(0,)], "node int"), 3)


_UNITS = f"{SEED}, units AS (SELECT list_transform(vec, lambda x: x / sqrt(list_sum(list_transform(vec, lambda y: y * y)))) AS unit FROM corpus)"


@query(f"WITH {_UNITS}, parts AS (SELECT i, count(*) * var_pop(unit[i]) AS v FROM units, range(1, 65) t(i) GROUP BY i) SELECT round(sum(v), 4) AS total, (SELECT count(*) FROM units) AS n FROM parts")
def pca_total(spark, d):
    """The spectrum's total against the trace of the covariance."""
    m = C.matrix(table(spark, d, "tracks"))
    n = P.gram(m)[0]
    return spark.createDataFrame([(round(P.principal(m)[3], 4), n)], "total double, n long")


@query()
def pca_variance(spark, d):
    fractions = P.principal(C.matrix(table(spark, d, "tracks")))[2]
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(fractions)], "component int, fraction double")


@query()
def pca_coords(spark, d):
    coords, _ = P.coordinates(C.matrix(table(spark, d, "tracks")))
    return coords.select("track_id", F.transform("coords", lambda x: F.round(x, 4)).alias("coords"))


@query()
def pc_extremes(spark, d):
    coords, _ = P.coordinates(C.matrix(table(spark, d, "tracks")))
    return P.extremes(coords, 0).withColumn("value", F.round("value", 4))


@query()
def tour_projection(spark, d):
    coords, _ = P.coordinates(C.matrix(table(spark, d, "tracks")))
    return P.fit(P.tour(coords, 12.5)).select("track_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"""WITH RECURSIVE {SEED.split(', seed AS')[0]}, t AS (SELECT c.track_id, k.artist, coalesce(c.analyzed_at, TIMESTAMP '1970-01-01') AS stamp, c.vec FROM corpus c JOIN tracks k USING (track_id) WHERE k.artist IS NOT NULL),
  small AS (SELECT artist FROM t GROUP BY artist), o AS (SELECT t.*, row_number() OVER (PARTITION BY artist ORDER BY stamp, track_id) AS n FROM t JOIN small USING (artist)),
  near AS (SELECT a.artist, a.n, b.n AS m FROM o a JOIN o b ON a.artist = b.artist AND b.n < a.n AND list_cosine_similarity(a.vec, b.vec) > 0.995),
  fold(artist, n, marked) AS (SELECT artist, 0::BIGINT, MAP([]::BIGINT[], []::BIGINT[]) FROM small
    UNION ALL SELECT f.artist, f.n + 1, CASE WHEN p.m IS NULL THEN f.marked ELSE map_concat(f.marked, MAP([f.n + 1], [p.m])) END
    FROM fold f JOIN o ON o.artist = f.artist AND o.n = f.n + 1, LATERAL (SELECT min(x.m) AS m FROM near x WHERE x.artist = f.artist AND x.n = f.n + 1 AND NOT list_contains(map_keys(f.marked), x.m)) p),
  last AS (SELECT artist, arg_max(marked, n) AS marked FROM fold GROUP BY artist), flat AS (SELECT artist, unnest(map_entries(marked)) AS e FROM last)
  SELECT a.track_id, b.track_id AS primary_id FROM flat f JOIN o a ON a.artist = f.artist AND a.n = f.e.key JOIN o b ON b.artist = f.artist AND b.n = f.e.value""")
def vector_marks(spark, d):
    """The vector pass: near duplicates within an artist, greedily, oldest first."""
    m = C.matrix(table(spark, d, "tracks")).filter("artist IS NOT NULL").withColumn("at", F.coalesce("analyzed_at", F.lit("1970-01-01").cast("timestamp_ntz")))
    return D.vector_marks(m.select("artist", "track_id", "at", "vec"))


@query()
def corpus_vector_marks(spark, d):
    """The vector pass over the survivors of the key pass, within an artist however typed."""
    tracks = table(spark, d, "tracks")
    at = F.coalesce("analyzed_at", F.lit("1970-01-01").cast("timestamp_ntz"))
    key = F.coalesce(F.nullif("dedupe_key", F.lit("")), dedupe_key_column(F.col("title"), F.col("artist")))
    kept = live(tracks).groupBy(key.alias("key")).agg(F.min(F.struct(at.alias("at"), "track_id"))["track_id"].alias("track_id"))
    m = C.matrix(tracks).join(kept.select("track_id"), "track_id", "left_semi")
    return D.vector_marks(m.select(normal_artist_column(F.col("artist")).alias("artist"), "track_id", at.alias("at"), "vec"))
