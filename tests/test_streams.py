"""Streams over tables of several part files: whichever way the rows are split, none is lost."""

import os

import pytest
from pyspark.sql import functions as F

from vecstrand.catalog.streams import QUERIES, SQL
from vecstrand.streaming import streams as S


@pytest.fixture(scope="module", params=["user", "time"])
def split(request, spark, data, tmp_path_factory):
    """The event table as a folder of three files, split by user or by time, in order of age."""
    import pandas as pd

    root = tmp_path_factory.mktemp(f"events-{request.param}")
    folder = root / "events.parquet"
    folder.mkdir()
    rows = pd.read_parquet(f"{data}/events.parquet").sort_values(["ts", "event_id"])
    part = rows["user_id"] % 3 if request.param == "user" else pd.Series(range(len(rows)), index=rows.index) * 3 // len(rows)
    for k in range(3):
        path = folder / f"part-{k}.parquet"
        rows[part == k].to_parquet(path, index=False, coerce_timestamps="us")
        os.utime(path, (1_000_000 + 60 * k, 1_000_000 + 60 * k))
    return str(root)


@pytest.mark.parametrize("name", ["stream_tumbling", "stream_sliding", "stream_session", "stream_dedupe", "stream_state"])
def test_part_files_give_the_rows_of_one_file(name, spark, split, duck, data):
    got = {tuple(map(str, r)) for r in QUERIES[name](spark, split).collect()}
    whole = {tuple(map(str, r)) for r in QUERIES[name](spark, data).collect()}
    assert got == whole and got


def test_update_output_needs_keys(spark, split):
    with pytest.raises(ValueError, match="keys"):
        S.run(S.tallies(S.read_events(spark, f"{split}/events.parquet")), "update")


def test_an_empty_stream_gives_no_rows(spark, tmp_path):
    schema = "event_id long, user_id long, event_type string, ts timestamp_ntz, value double"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "e.parquet"))
    events = S.read_events(spark, str(tmp_path / "e.parquet"))
    assert S.run(S.tallies(events), "update", ["user_id"]).count() == 0
    assert S.run(events.select("user_id", F.col("value"))).count() == 0
