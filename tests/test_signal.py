import numpy as np
import pytest
from pyspark.sql import functions as F

from vecstrand.operators import signal as S


def sine(hz, n=8000, rate=8000):
    return np.sin(2 * np.pi * hz * np.arange(n) / rate)


def test_band_stop_removes_its_band_and_nothing_else():
    low, high = sine(200), sine(2000)
    out = S.band_stop(low + high, 8000, 1500, 2500)
    assert np.abs(out[2000:6000] - low[2000:6000]).max() < 0.05
    assert np.array_equal(S.band_stop(low, 8000, 500, 500), low)


def test_mel_peak_is_at_the_tone_and_short_waves_have_none(spark):
    df = spark.createDataFrame([(1, sine(1000).tolist()), (2, [0.0] * 10)], "id int, wave array<double>")
    m = S.mel_spectrogram(df, "id", "wave", 8000, 512, 256, 24)
    assert {r[0] for r in m.select("id").distinct().collect()} == {1}
    best = m.groupBy("band").agg(F.avg("db").alias("x")).orderBy(F.desc("x")).first()["band"]
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    assert abs(best - (mel(1000) / mel(4000) * 25 - 1)) <= 1


def test_attribution_finds_the_band_that_matters(spark):
    wave = (sine(200) + sine(3000)).tolist()

    def embed(x):
        power = np.abs(np.fft.rfft(x)) ** 2
        return np.array([power[: len(power) // 2].sum(), power[len(power) // 2 :].sum()])

    df = spark.createDataFrame([("t", wave, [0.0, 1.0])], "id string, wave array<double>, rec array<double>")
    got = {r["band"]: r["delta"] for r in S.attribution(df, "id", "wave", "rec", 8000, [50.0, 1000.0, 3900.0], embed).collect()}
    assert got[1] > 0.3 and got[0] < 0


def test_key_of_a_major_triad(spark):
    chroma = [1.0, 0.0, 0.0, 0.0, 0.8, 0.0, 0.0, 0.9, 0.0, 0.0, 0.0, 0.2]
    df = spark.createDataFrame([(chroma,), ([0.0] * 12,)], "c array<double>").select(S.key_of("c").alias("k"))
    a, b = [r["k"] for r in df.collect()]
    assert (a["tonic"], a["mode"]) == (0, "major") and b["strength"] == 0


def test_frames_pool_and_windows(spark):
    df = spark.createDataFrame([([float(i) for i in range(10)],), ([1.0],)], "w array<double>")
    got = df.select(S.frames("w", 4, 2).alias("f"), S.pool("w", 4).alias("p"), S.windows("w", 4).alias("x")).collect()
    assert [f[0] for f in got[0]["f"]] == [0, 2, 4, 6] and got[1]["f"] == []
    assert got[0]["p"] == pytest.approx([0.5, 3.0, 5.5, 8.0]) and got[1]["p"] == [1.0]
    assert [x[0] for x in got[0]["x"]] == [0, 3, 6] and got[1]["x"] == [[1.0] * 4]


def test_band_filters_against_the_rule_frame_by_frame():
    """Overlap-add written out; stop and solo add up to the wave; a band too narrow for a bin stops nothing."""
    rng = np.random.default_rng(0)
    x, rate, size = rng.standard_normal(5_000), 8_000, 512
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    gain = np.ones(size // 2 + 1)
    inside = [k for k in range(len(gain)) if 1_000 <= k * rate / size <= 1_200]
    for k in range(len(gain)):
        away = max(inside[0] - k, k - inside[-1], 0)
        gain[k] = 0.5 * (1 - np.cos(np.pi * away / 5)) if away < 5 else 1
    padded = np.concatenate([np.zeros(size), x, np.zeros(2 * size)])
    out, weight = np.zeros(len(padded)), np.zeros(len(padded))
    for at in range(0, len(padded) - size + 1, size // 2):
        out[at : at + size] += np.fft.irfft(np.fft.rfft(padded[at : at + size] * window) * gain, size)
        weight[at : at + size] += window
    want = (out / np.where(weight > 1e-8, weight, 1))[size : size + len(x)]
    stop, solo = S.band_stop(x, rate, 1_000, 1_200, size), S.band_solo(x, rate, 1_000, 1_200, size)
    assert np.allclose(stop, want) and np.allclose(stop + solo, x)
    assert np.array_equal(S.band_stop(x, rate, 1_001, 1_002, size), x)


def test_self_similarity_joins_nothing(spark, tmp_path):
    """Each wave within its row: a broadcast of all columns is more than a driver holds. Ids that are there twice count as in the SQL's join."""
    import duckdb

    from vecstrand.queries import ORACLE_SQL, QUERIES

    spark.createDataFrame([(1,), (2,), (2,), (7,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["ssm_gram"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = con.execute(ORACLE_SQL["ssm_gram"]).fetchall()
    assert len(want) == 6 * 256 and sorted(tuple(r) for r in got.select("id", "a", "b", "cosine").collect()) == sorted(want)
