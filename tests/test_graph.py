import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecstrand.operators import graph as G
from vecstrand.operators import project as P
from vecstrand.operators import rank as R


def view(spark, x, limit=8000):
    m = spark.createDataFrame([(f"{i:03d}", [float(c) for c in v], [0.5] * 8, 100.0, None) for i, v in enumerate(x)], "track_id string, vec array<double>, feel array<double>, tempo double, dedupe_key string")
    return m, G.View(m, R.seed_of(m, "000"), limit=limit)


@pytest.fixture(scope="module")
def random_rows():
    return np.random.default_rng(3).standard_normal((60, 8))


def test_tree_of_a_quarter_circle_is_its_path(spark):
    _, v = view(spark, [(math.cos(a), math.sin(a)) for a in np.linspace(0, math.pi / 2, 7)])
    edges = [(r["a"], r["b"]) for r in G.spanning_tree(v).collect()]
    assert sorted(edges) == [(f"{i:03d}", f"{i + 1:03d}") for i in range(6)]


def test_tree_against_kruskal(spark, random_rows):
    u = random_rows / np.linalg.norm(random_rows, axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 9)
    parent = list(range(60))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    want = []
    for w, i, j in sorted((d[i, j], i, j) for i in range(60) for j in range(i + 1, 60)):
        if find(i) != find(j):
            parent[find(i)] = find(j)
            want.append((i, j))
    assert sorted((i, j) for i, j, _ in G.tree(u)) == sorted(want)
    assert G.tree(u[:1]) == []


def test_hub_counts_total_n_times_k(spark, random_rows):
    _, v = view(spark, random_rows)
    assert G.hubs(v, 5).agg(F.sum("count")).first()[0] == 300


def test_walk_follows_the_samples(spark):
    _, v = view(spark, [(math.cos(a), math.sin(a)) for a in np.linspace(0, 3.0, 30)])
    r = G.walk(v, "000", "029", 2).first()
    assert r["path"][0] == "000" and r["path"][-1] == "029" and r["hops"] >= 14
    assert r["detour"] == pytest.approx(r["geodesic"] / r["ambient"])
    assert G.walk(v, "000", "000", 2).first()["hops"] == 0
    _, far = view(spark, [(1, 0, 0), (1, 0.01, 0), (1, 0.02, 0), (0, 0, 1), (0, 0.01, 1), (0, 0.02, 1)])
    assert G.walk(far, "000", "005", 2).count() == 0


def test_components_at_thresholds(spark):
    _, v = view(spark, [(1, 0), (1, 0.01), (0, 1), (0.01, 1)])
    got = {r["track_id"]: r["component"] for r in G.components_at(v, 0.01).collect()}
    assert got == {"000": "000", "001": "000", "002": "002", "003": "002"}


def test_principal_components_equal_svd(spark, random_rows):
    m, _ = view(spark, random_rows)
    u = random_rows / np.linalg.norm(random_rows, axis=1, keepdims=True)
    c = u - u.mean(axis=0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    coords, fractions = P.coordinates(m, 8)
    assert fractions == pytest.approx(s**2 / (s**2).sum(), abs=1e-8)
    got = np.array([r["coords"] for r in coords.orderBy("track_id").collect()])
    assert np.abs(np.abs(got) - np.abs(c @ vt.T)).max() < 1e-6
    assert all(got[np.abs(got[:, k]).argmax(), k] > 0 for k in range(8))


def test_fewer_than_two_rows_project_to_nothing(spark):
    m, _ = view(spark, [(1.0, 0.0)])
    assert P.principal(m, 2)[3] == 0.0


def test_tour_frames_are_orthonormal():
    for t in (0, 1.5, 77):
        f = P.tour_frame(t)
        assert f.T @ f == pytest.approx(np.eye(2))


def test_bfs_keeps_the_first_hop(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3), (3, 0)], "src int, dst int")
    got = {r["node"]: r["hop"] for r in G.bfs(edges, spark.createDataFrame([(0,)], "node int"), 3).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 2}


def test_vector_marks_skip_marked_rows(spark):
    from vecstrand.operators.dedupe import vector_marks

    rows = [("x", "a", 1, 0.0), ("x", "b", 2, 0.09), ("x", "c", 3, 0.18), ("y", "d", 4, 0.0), ("x", "e", 1, 3.0)]
    df = spark.createDataFrame([(n, t, at, [math.cos(a), math.sin(a)]) for n, t, at, a in rows], "artist string, track_id string, at int, vec array<double>")
    # b is near a and marked; c is near b alone, and a marked row is nobody's primary.
    assert {(r[0], r[1]) for r in vector_marks(df).collect()} == {("b", "a")}


def test_vector_marks_of_an_artist_of_many_rows(spark):
    from vecstrand.operators.dedupe import vector_marks

    rng = np.random.default_rng(5)
    # A crowd of more rows than any one block, another of a few, both with chains of near rows.
    x = np.repeat(rng.standard_normal((300, 8)), 3, axis=0) + 0.05 * rng.standard_normal((900, 8))
    rows = [("crowd" if i < 840 else "few", f"{i:03d}", int(at), [float(c) for c in x[i]]) for i, at in enumerate(rng.integers(0, 50, 900))]
    want, kept = set(), {"crowd": [], "few": []}
    for artist, t, _, v in sorted(rows, key=lambda r: (r[2], r[1])):
        u = np.array(v) / np.linalg.norm(v)
        if first := next((k for k, w in kept[artist] if u @ w > 0.995), None):
            want.add((t, first))
        else:
            kept[artist].append((t, u))
    df = spark.createDataFrame(rows, "artist string, track_id string, at int, vec array<double>")
    assert len(want) > 100 and any(a < "840" for a, _ in want)
    for block in (2_000, 100):
        assert {(r[0], r[1]) for r in vector_marks(df, block=block).collect()} == want


def test_vector_marks_of_survivors_by_normal_artist(spark, tmp_path):
    from vecstrand.queries import QUERIES

    def row(n, artist, key, day, angle, version=4):
        v = np.zeros(64)
        v[:2] = np.cos(angle), np.sin(angle)
        return (n, "A Title", artist, key, None, None, f"2026-01-{day:02d}", None, version, bytearray(np.rint(v * 127).astype(np.int8).tobytes()), 0.1)

    rows = [
        row("a", "Renée Ostrand", "x|1", 1, 0.0), row("b", "renee ostrand feat. Someone", "x|2", 2, 0.02), row("c", "RENEE  OSTRAND", "x|3", 3, 1.0),
        # d falls in the key pass, so e, near d alone, is no duplicate; f has no stored key.
        row("d", "Renée Ostrand", "x|1", 4, 0.5), row("e", "Renée Ostrand", "x|5", 5, 0.5), row("f", "Renee Ostrand", None, 6, 1.01),
        row("g", "Another One", "y|1", 7, 0.0), row("h", "Renée Ostrand", "x|8", 1, 1.0, 3),
    ]
    schema = "track_id string, title string, artist string, dedupe_key string, feel array<double>, rhythm struct<tempo_bpm double>, analyzed_at string, duplicate_of string, features_version int, embedding binary, scale float"
    spark.createDataFrame(rows, schema).withColumn("analyzed_at", F.col("analyzed_at").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/tracks.parquet")
    assert {(r[0], r[1]) for r in QUERIES["corpus_vector_marks"](spark, str(tmp_path)).collect()} == {("b", "a"), ("f", "c")}
