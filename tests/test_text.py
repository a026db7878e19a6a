import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecstrand.functions import text as X

TITLES = {
    "Song (2009 Remaster)": "song", "Song (Reprise)": "song reprise", "Song - Live - 2001 Remaster": "song", "Song - Part Two": "song part two", "Söng [Radio Edit]": "song",
    "(feat. Someone) Song": "song", "Take Five": "take five", "A - B - Live": "a b", "": "", " - Live": "", "Live": "live", "X (a) (Live)": "x a", "½ Time": "12 time",
}
ARTISTS = {"Björk feat. Guest": "bjork", "A & B": "a", "One, Two": "one", "Fear & X with Y": "fear", "Someone ft. Else": "someone", "Band": "band", "": "", "Featherweight": "featherweight"}


@pytest.mark.parametrize("title, want", TITLES.items())
def test_normal_title(title, want):
    assert X.normal_title(title) == want


@pytest.mark.parametrize("artist, want", ARTISTS.items())
def test_normal_artist(artist, want):
    assert X.normal_artist(artist) == want


def test_columns_agree_with_python(spark):
    titles = [t for t in TITLES if "½" not in t]
    df = spark.createDataFrame([(t,) for t in titles] + [(None,)], "t string").select("t", X.normal_title_column(F.col("t")).alias("p"))
    assert all(r["p"] == X.normal_title(r["t"]) for r in df.collect())
    df = spark.createDataFrame([(t,) for t in ARTISTS] + [(None,)], "t string").select("t", X.normal_artist_column(F.col("t")).alias("p"))
    assert all(r["p"] == X.normal_artist(r["t"]) for r in df.collect())


@given(st.text(max_size=40))
@settings(max_examples=200, deadline=None)
def test_fold_is_plain_and_stable(s):
    once = X.fold(s)
    assert once == X.fold(once) and all(c in "abcdefghijklmnopqrstuvwxyz0123456789 " for c in once)
