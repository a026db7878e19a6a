import math

import pytest
from pyspark.sql import functions as F

from vecstrand.operators import rank as R

SCHEMA = "track_id string, vec array<double>, feel array<double>, tempo double, dedupe_key string"


def corpus(spark, rows):
    """rows: id, angle, feel, tempo, key."""
    return spark.createDataFrame([(i, [math.cos(a), math.sin(a)], None if f is None else [f] * 8, t, k) for i, a, f, t, k in rows], SCHEMA)


def test_ties_go_to_the_smaller_id_and_nan_never_ranks(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", float("nan")), ("d", None)], "track_id string, score double")
    assert [r["track_id"] for r in R.top(df, 5).collect()] == ["a", "b"]


def test_blend_flips_the_winner_and_missing_is_no_penalty(spark):
    m = corpus(spark, [("s", 0.0, 0.5, 120.0, None), ("near", 0.1, 0.9, 120.0, None), ("felt", 0.3, 0.5, 120.0, None), ("none", 0.2, None, None, None)])
    seed = R.seed_of(m, "s")
    plain = [r["track_id"] for r in R.top(R.blended(m, seed, 0, 0).filter("track_id <> 's'"), 3).collect()]
    assert plain == ["near", "none", "felt"]
    felt = {r["track_id"]: r for r in R.blended(m, seed, 1.0, 1.0).collect()}
    assert felt["none"]["score"] == pytest.approx(math.cos(0.2))
    assert felt["near"]["score"] < felt["felt"]["score"]


def test_tempo_folds_octaves(spark):
    df = spark.createDataFrame([(240.0,), (60.0,), (120.0,), (170.0,), (None,), (0.0,)], "t double")
    got = [r[0] for r in df.select(R.tempo_distance(F.when(F.col("t") > 0, F.col("t")), F.lit(120.0))).collect()]
    assert got[:3] == pytest.approx([0, 0, 0]) and 0.4 < got[3] <= 0.5 and got[4:] == [0.0, 0.0]


def test_collapse_keeps_the_first_of_each_recording(spark):
    m = corpus(spark, [("s", 0.0, 0.5, 1.0, "k|s"), ("a1", 0.1, None, None, "x|a"), ("a2", 0.2, None, None, "x|a"), ("c1", 0.4, None, None, "y|a"), ("d1", 0.4001, None, None, "z|d"), ("e1", 0.8, None, None, "|"), ("f1", 1.2, None, None, "|"), ("s2", 0.05, None, None, "k|s")])
    seed = R.seed_of(m, "s")
    rows = R.ranked(R.top(R.scored(m, seed).filter("track_id <> 's'").withColumn("score", F.col("sim")), 20))
    assert [r["track_id"] for r in R.collapse(rows, 10, 0.9999).orderBy("position").collect()] == ["a1", "c1", "e1", "f1"]


def test_percentile_is_ordinal(spark):
    df = spark.createDataFrame([(f"{i:03d}", float(i // 2)) for i in range(101)], "track_id string, v double")
    got = R.percentile(df, "v", "p").orderBy("track_id").select("p").collect()
    assert [r[0] for r in got] == pytest.approx([float(i) for i in range(101)])


def test_limits_are_checked(spark):
    with pytest.raises(ValueError):
        R.top(spark.createDataFrame([], "track_id string, score double"), 0)


def test_centrality_counts_the_row_itself(spark):
    m = corpus(spark, [("a", 0.0, None, None, None), ("b", math.pi / 2, None, None, None)])
    assert [r["centrality"] for r in R.centrality(m, 2).collect()] == pytest.approx([0.5, 0.5])


def test_euclidean_centrality_is_of_all_rows(spark, tmp_path):
    import numpy as np

    from vecstrand.queries import QUERIES

    rng = np.random.default_rng(11)
    # More rows than a view holds, some of equal direction.
    x = rng.integers(-127, 128, (8_300, 64)).astype(np.int8)
    x[:40] = x[40:80]
    schema = "track_id string, title string, artist string, dedupe_key string, feel array<double>, rhythm struct<tempo_bpm double>, analyzed_at timestamp_ntz, duplicate_of string, features_version int, embedding binary, scale float"
    ids = spark.createDataFrame([(f"{i:04d}", None, None, None, [0.5] * 8, (100.0,), None, None, 4, bytearray(v.tobytes()), 0.01 + 0.001 * (i % 40 % 7)) for i, v in enumerate(x)], schema)
    ids.withColumn("analyzed_at", F.lit("2026-01-01").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/tracks.parquet")
    u = x * np.float32([0.01 + 0.001 * (i % 40 % 7) for i in range(len(x))]).astype(float)[:, None]
    some = [0, 5, 45, 4_000, 8_299]
    want = [(1 / (1 + np.sqrt(((u - u[i]) ** 2).sum(axis=1)))).mean() for i in some]
    got = {r[0]: r[1] for r in QUERIES["centrality_euclid"](spark, str(tmp_path)).collect()}
    assert len(got) == len(x) and [got[f"{i:04d}"] for i in some] == pytest.approx(want, abs=1e-6)
    small = {r[0]: r[1] for r in R.euclidean_centrality(ids.limit(900), 100).collect()}
    want = (1 / (1 + np.sqrt(((u[:900, None] - u[None, :900]) ** 2).sum(axis=2)))).mean(axis=1)
    assert [small[f"{i:04d}"] for i in range(900)] == pytest.approx(list(want), abs=1e-9)


def test_euclidean_centrality_shuffles_few_copies(spark):
    """However many blocks its rows would make; rows of one vector and scale travel once."""
    import numpy as np

    x = np.random.default_rng(12).integers(-127, 128, (2_000, 64)).astype(np.int8)
    x[1_000:] = x[:1_000]
    rows = spark.createDataFrame([(f"{i:04d}", bytearray(v.tobytes()), 0.01) for i, v in enumerate(x)], "track_id string, embedding binary, scale float")
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = written()
    got = {r[0]: r[1] for r in R.euclidean_centrality(rows, 20).collect()}
    assert written() - before < 12 * x.nbytes
    u = x * np.float64(np.float32(0.01))
    want = [(1 / (1 + np.sqrt(((u - u[i]) ** 2).sum(axis=1)))).mean() for i in (3, 1_700)]
    assert [got["0003"], got["1700"]] == pytest.approx(want, abs=1e-9) and len(got) == 2_000


def test_euclidean_centrality_of_many_rows_in_single_precision(spark, monkeypatch):
    """Near, equal and frequent vectors are taken in double; a squared distance of far ones in single keeps the mean."""
    import numpy as np

    rng = np.random.default_rng(13)
    x = rng.integers(-100, 101, (5_000, 64)).astype(np.int8)
    x[:1_500] = np.clip(x[0].astype(int) + rng.integers(-1, 2, (1_500, 64)), -127, 127)
    x[1_500:1_600], x[4_000:] = x[1_600:1_700], x[3_999]
    scale = np.float32(0.01) + np.float32(1e-6) * (np.arange(5_000) % 3).astype(np.float32)
    rows = spark.createDataFrame([(f"{i:04d}", bytearray(v.tobytes()), float(s)) for i, (v, s) in enumerate(zip(x, scale))], "track_id string, embedding binary, scale float")
    off = []
    monkeypatch.setattr(R, "SINGLE", 1)
    monkeypatch.setattr(R, "HEAVY", 0.05)
    for block in (700, 8_000):
        got = {r[0]: r[1] for r in R.euclidean_centrality(rows, block).collect()}
        u = x * scale.astype(np.float64)[:, None]
        some = [0, 7, 1_499, 1_550, 1_650, 2_500, 3_999, 4_500]
        want = [(1 / (1 + np.sqrt(((u - u[i]) ** 2).sum(axis=1)))).mean() for i in some]
        assert len(got) == 5_000
        off.append(max(abs(got[f"{i:04d}"] - w) for i, w in zip(some, want)))
    assert max(off) < 1e-8
