import numpy as np
import pytest
from pyspark.sql import functions as F

from vecstrand.functions import vector as V


def rows(spark, data, schema="id string, a array<double>, b array<double>"):
    return spark.createDataFrame(data, schema)


def test_zero_vector_has_cosine_zero_and_widths_never_mix(spark):
    df = rows(spark, [("zero", [0.0, 0.0], [1.0, 0.0]), ("same", [2.0, 0.0], [1.0, 0.0]), ("wide", [1.0, 0.0, 0.0], [1.0, 0.0])])
    got = {r["id"]: r["c"] for r in df.select("id", V.cosine(F.col("a"), F.col("b")).alias("c")).collect()}
    assert got == {"zero": 0.0, "same": 1.0, "wide": None}


def test_euclidean_is_one_at_no_distance(spark):
    df = rows(spark, [("x", [3.0, 4.0], [0.0, 0.0]), ("y", [1.0, 1.0], [1.0, 1.0])])
    got = [r[0] for r in df.orderBy("id").select(V.euclidean(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1 / 6, 1.0])


def test_unknown_metric_is_refused(spark):
    with pytest.raises(ValueError):
        V.similarity("manhattan", F.col("a"), F.col("b"))


def test_quantize_rounds_halves_to_even_and_keeps_zero(spark):
    df = rows(spark, [("h", [127.0, 2.5, 3.5, -2.5], None), ("z", [0.0, 0.0], None)]).select("id", V.quantize(F.col("a")).alias("q"))
    got = {r["id"]: (r["q"]["q"], r["q"]["scale"]) for r in df.collect()}
    assert got["h"] == ([127, 2, 4, -2], 1.0) and got["z"] == ([0, 0], 1.0)


def test_dequantize_within_half_a_step(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((20, 16))
    df = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "id string, a array<double>").withColumn("q", V.quantize(F.col("a")))
    for r in df.select("a", V.dequantize(F.col("q.q"), F.col("q.scale")).alias("b"), F.col("q.scale").alias("s")).collect():
        assert np.abs(np.array(r["a"]) - np.array(r["b"])).max() <= r["s"] / 2 + 1e-12
