import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecstrand.functions.udf import register
from vecstrand.operators import corpus as C
from vecstrand.operators import legacy as L
from vecstrand.sources import files
from vecstrand.streaming import streams as S


def test_catalogue_and_cached_analyses(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"tracks": [{"track_id": "1", "title": "A"}, {"track_id": "2", "title": None, "more": 1}]}))
    assert [r["track_id"] for r in files.read_catalogue(spark, str(tmp_path / "c.json")).orderBy("track_id").collect()] == ["1", "2"]
    cache = tmp_path / "cache"
    cache.mkdir()
    (cache / "a.json").write_text('{"version": 4, "bpm": 120.0}')
    assert files.read_analyses(spark, str(cache), "version int, bpm double", 4).first()["bpm"] == 120.0
    with pytest.raises(Exception, match="another version"):
        files.read_analyses(spark, str(cache), "version int, bpm double", 5).collect()


def test_audio_has_one_slot_a_file(spark, tmp_path):
    for name, seconds in (("long", 2), ("short", 0.2)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
            tone = (np.sin(2 * np.pi * 440 * np.arange(int(8000 * seconds)) / 8000) * 20000).astype("<i2")
            w.writeframes(np.repeat(tone, 2).tobytes())
    (tmp_path / "bad.wav").write_bytes(b"no audio")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.read_audio(spark, str(tmp_path), 8000).collect()}
    assert len(got["long.wav"]["samples"]) == 16000 and got["long.wav"]["error"] is None
    assert got["short.wav"]["samples"] is None and "second" in got["short.wav"]["error"] and got["bad.wav"]["error"]


def test_catalogue_source_pages(spark):
    spark.dataSource.register(files.CatalogueSource)
    rows = [{"id": i, "name": f"n{i}", "artist_name": "a", "shareurl": ""} for i in range(5)] + [{"id": None, "name": "x"}, {"id": 9}]
    df = spark.read.format("vecstrand-catalogue").option("payloads", json.dumps(rows)).option("page", "2").load()
    assert sorted(r["track_id"] for r in df.collect()) == ["0", "1", "2", "3", "4"]


def test_functions_in_sql(spark):
    register(spark)
    r = spark.sql("SELECT cosine_similarity(array(1D, 0D), array(1D, 0D)) AS c, exact_fold('Björk!') AS f, dedupe_key('Song (Live)', 'A & B') AS k").first()
    assert tuple(r) == (1.0, "bjork", "a|song")
    assert spark.sql("SELECT mean_vector(v) AS m FROM VALUES (array(1D, 3D)), (array(3D, 5D)) t(v)").first()["m"] == [2.0, 4.0]
    assert spark.sql("SELECT * FROM log_bands(10D, 1000D, 2)").count() == 2


def test_corpus_is_written_by_version_and_read_by_increment(spark, data, tmp_path):
    tracks = spark.read.parquet(f"{data}/tracks.parquet")
    C.write_corpus(tracks, str(tmp_path / "corpus"))
    assert spark.read.parquet(str(tmp_path / "corpus")).count() == tracks.count()
    part = tracks.filter("analyzed_at IS NOT NULL").select("track_id", "analyzed_at")
    cut = part.orderBy("analyzed_at").limit(50)
    assert S.append_increment(spark, cut, str(tmp_path / "store"), "track_id", "analyzed_at") == 50
    S.append_increment(spark, part, str(tmp_path / "store"), "track_id", "analyzed_at")
    assert S.append_increment(spark, part, str(tmp_path / "store"), "track_id", "analyzed_at") == 0
    assert spark.read.parquet(str(tmp_path / "store")).count() == part.count()


def test_retired_rows_get_their_primary(spark):
    t = spark.createDataFrame([("a", None), ("b", "x"), ("c", None)], "track_id string, duplicate_of string")
    marks = spark.createDataFrame([("c", "a")], "track_id string, primary string")
    assert {r["track_id"]: r["duplicate_of"] for r in C.mark_duplicates(t, marks).collect()} == {"a": None, "b": "x", "c": "a"}


def test_tags_and_keys(spark):
    tag = "array<struct<name:string,score:double>>"
    df = spark.createDataFrame([([("a", 0.5), ("b", 0.05)], [("b", 0.9), ("a", 0.2)])], f"x {tag}, y {tag}")
    assert df.select(L.shared_tags(F.col("x"), F.col("y"))).first()[0] == ["a"]
    one = spark.range(1).select(
        L.key_score(F.lit(0), F.lit("major"), F.lit(9), F.lit("minor")).alias("relative"), L.key_score(F.lit(0), F.lit("major"), F.lit(7), F.lit("major")).alias("fifth"),
        L.tempo_score(F.lit(60.0), F.lit(120.0)).alias("octave"),
    ).first()
    assert one["relative"] == 1.0 and one["fifth"] == pytest.approx(0.8) and one["octave"] == pytest.approx(1.0)
