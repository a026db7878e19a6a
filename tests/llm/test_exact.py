"""The exact operators: components, survivors, byte-pair encoding."""

import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecstrand.llm import bpe, components, survivors
from vecstrand.llm.oracles import ORACLE_SQL
from vecstrand.llm.queries import QUERIES

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, same):
    same(QUERIES[name], ORACLE_SQL[name])


def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {x: find(x) for x in parent}


def components_of(spark, edges):
    df = spark.createDataFrame(edges, "left string, right string")
    return {r["node"]: r["component"] for r in components.connected_components(spark, df).collect()}


@given(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from("abcdefghijkl")), st.sampled_from("abcdefghijkl")), max_size=14))
@FEW
def test_components_against_union_find(spark, edges):
    assert components_of(spark, edges) == union_find(edges)


def test_components_of_chains_stars_and_loops(spark):
    chain = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)]
    star = [("hub", f"s{i:03d}") for i in range(300)]
    loop = [("x", "y"), ("y", "z"), ("z", "x"), ("x", "x"), ("y", "x")]
    edges = chain + star + loop
    assert components_of(spark, edges) == union_find(edges)


def test_heavy_hubs_are_met_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(components, "HEAVY_ROWS", 20)
    star = [("m", f"s{i:03d}") for i in range(200)] + [("s000", "a")]
    assert set(components_of(spark, star).values()) == {"a"}


def test_no_links_and_other_columns(spark):
    empty = spark.createDataFrame([], "left string, right string, node string, u int")
    assert components.connected_components(spark, empty).count() == 0
    df = spark.createDataFrame([("b", "a", "q", 1), ("b", "a", "r", 2)], "left string, right string, node string, u int")
    assert {tuple(r) for r in components.connected_components(spark, df).collect()} == {("a", "a"), ("b", "a")}


def test_links_of_tracks(spark):
    t = spark.createDataFrame(
        [("1", "2", None), ("2", None, None), ("3", "gone", "a|b"), ("4", None, "a|b"), ("5", "5", "|"), ("6", None, "|"), ("7", None, "a|"), ("8", None, "a|"), ("9", "gone", None)],
        "track_id string, duplicate_of string, dedupe_key string",
    )
    pairs = spark.createDataFrame([("4", "2", "same"), ("2", "4", "same"), ("5", "6", "different"), ("5", "away", "same"), ("6", "6", "same"), ("7", "8", None)], "left_id string, right_id string, verdict string")
    got = {r["track_id"]: r["group_id"] for r in components.track_groups(spark, t, pairs).collect()}
    assert got == {"1": "1", "2": "1", "3": "1", "4": "1"}


def brute_choice(lists, agrees, n):
    best = None
    for picks in itertools.product(*[[*range(len(c)), -1] for c in lists]):
        fixed, ok = {}, True
        for b, i in enumerate(picks):
            if i >= 0:
                for d in agrees[b]:
                    if fixed.setdefault(d, lists[b][i][d]) != lists[b][i][d]:
                        ok = False
        cost = sum(len(lists[b]) if i < 0 else i for b, i in enumerate(picks))
        if ok and (best is None or cost < best):
            best = cost
    return best


@given(st.lists(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("xyz")), max_size=3), min_size=1, max_size=4), st.lists(st.sampled_from([(), (0,), (1,), (0, 1)]), min_size=4, max_size=4))
@settings(max_examples=200, deadline=None)
def test_branch_and_bound_is_optimal(lists, agrees):
    agrees = agrees[: len(lists)]
    picks = survivors.search(lists, agrees, 2)
    fixed = {}
    for b, i in enumerate(picks):
        if i >= 0:
            for d in agrees[b]:
                assert fixed.setdefault(d, lists[b][i][d]) == lists[b][i][d]
    assert sum(len(lists[b]) if i < 0 else i for b, i in enumerate(picks)) == brute_choice(lists, agrees, 2)


GROUP = "group_id string, track_id string, features_version int, analyzed_at timestamp_ntz, album string, artwork_url string, attribution struct<source:string,url:string,license:string>, embedding binary, feel array<double>, rhythm struct<tempo_bpm:double,beat_strength:double,loudness_lufs:double,loudness_range:double,key:int,mode:string,key_strength:double>, _g string, field string"


def track(i, version, album=None, art=None, attribution=None, embedding=None, feel=None, rhythm=None):
    return ("g", i, version, None, album, art, attribution, embedding, feel, rhythm, "clash", "clash")


def test_what_counts_as_filled(spark):
    rows = [
        track("a", 4, " n/a ", "https://x.test/cover//250.jpg", (None, None, None), bytes(64), [0.0] * 8, (None,) * 7),
        track("b", None, "Real", "https://x.test/cover/1/250.jpg", (None, "u", None), b"\x01" * 64, [0.0, 0.5], (0.0, None, None, None, None, None, None)),
        track("c", None, "[No Album]", "", None, b"", [], None),
        track("d", None, "Real too", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows * 2, GROUP)
    got = {r["field"]: r["track_id"] for r in survivors.track_survivors(df).collect()}
    assert got == {f: "b" for f in ("album", "artwork_url", "attribution", "embedding", "feel", "rhythm")}
    assert survivors.track_survivors(df.filter("false")).count() == 0


def test_dependent_bundles_come_from_one_version(spark):
    full = (1.0, None, None, None, None, None, None)
    rows = [track("a", 4, embedding=b"\x01" * 64), track("b", 3, embedding=b"\x02" * 64, feel=[0.5], rhythm=full), track("c", 2, feel=[0.4])]
    df = spark.createDataFrame(rows, GROUP)
    free = {r["field"]: r["track_id"] for r in survivors.track_survivors(df).collect()}
    tied = {r["field"]: r["track_id"] for r in survivors.track_survivors(df, agree=True).collect()}
    assert free == {"embedding": "a", "feel": "b", "rhythm": "b"} and tied == {"embedding": "b", "feel": "b", "rhythm": "b"}


@pytest.fixture(scope="module")
def encoders():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    with open(bpe.VOCABULARY, "rb") as f:
        return bpe.Encoder.parse(f.read()), t


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_ids_and_round_trip(encoders, s):
    mine, theirs = encoders
    try:
        s.encode()
    except UnicodeEncodeError:
        return
    ids = mine.encode(s)
    assert mine.decode(ids).decode() == s
    assert ids == theirs.encode(s, add_special_tokens=False).ids


def test_very_long_pieces(encoders):
    mine, theirs = encoders
    for s in ("a" * 30_000, "ab" * 9_000 + "漢" * 500, " " * 4_000 + "x", "<|endoftext|>"):
        assert mine.encode(s) == theirs.encode(s, add_special_tokens=False).ids


def test_corpus_encoding_of_null_and_empty(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "Hello world", 9), (3, "Hello world", 9), (None, " ", 9)], "doc_id long, text string, ids int")
    got = sorted((r["doc_id"] or 0, r["ids"]) for r in bpe.encode_corpus(df).collect())
    assert got == [(0, [220]), (1, []), (2, []), (3, [15496, 995]), (3, [15496, 995])]
    assert bpe.encode_corpus(df.filter("false")).count() == 0


def test_documents_of_the_tables(spark, data, encoders):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode_corpus(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        want = encoders[1].encode(r["text"], add_special_tokens=False).ids if r["text"] else []
        assert ids[r["doc_id"]] == want
