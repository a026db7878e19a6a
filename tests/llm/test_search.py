"""Vector search, new batches, names, leaks and stuffed pages."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecstrand.llm import arrivals, leaks, names, neighbours, spam


def clusters(n=300, width=16, seed=0, spread=0.35):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, width))
    x = centres[rng.integers(0, 12, n)] + spread * rng.standard_normal((n, width))
    return np.clip(np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 127), -127, 127).astype(np.int8)


def brute(ids, x, k=5):
    n = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    sims = (x.astype(np.float64) @ x.T.astype(np.float64)) / (n[:, None] * n)
    return {(ids[i], ids[j]) for i in range(len(ids)) for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-sims[i, j], ids[j]))[:k]}


def asked(spark, ids, x, **more):
    df = spark.createDataFrame([(i, bytearray(v.tobytes()), "clash") for i, v in zip(ids, x)], "id string, vec binary, z string")
    return [(r["id"], r["neighbour"]) for r in neighbours.k_nearest(spark, df, width=x.shape[1], **more).collect()]


def test_nearest_against_brute_force(spark):
    x = clusters()
    ids = [f"t{i:04d}" for i in range(len(x))]
    got, want = asked(spark, ids, x), brute(ids, x)
    assert len(got) == len(set(got)) == 5 * len(ids)
    assert len(set(got) & want) >= 0.98 * len(want)


def test_one_vector_of_a_third_of_all_rows(spark):
    x = clusters(240)
    x[:80] = x[0]
    ids = [f"t{i:04d}" for i in range(len(x))]
    got = set(asked(spark, ids, x))
    assert {b for a, b in got if a == "t0000"} == {f"t{i:04d}" for i in range(1, 6)}
    assert {b for a, b in got if a == "t0079"} == {f"t{i:04d}" for i in range(5)}


def test_vectors_without_clusters(spark):
    """Nearest vectors far apart: the radius grows until it holds them, if need be over a whole table."""
    x = np.random.default_rng(4).standard_normal((1500, 16))
    x = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 127).astype(np.int8)
    ids = [f"t{i:04d}" for i in range(len(x))]
    got, want = asked(spark, ids, x), brute(ids, x)
    assert len(got) == len(set(got)) == 5 * len(ids)
    assert len(set(got) & want) >= 0.95 * len(want)


def test_radii_sum_to_their_credits(monkeypatch):
    x = clusters(400).astype(np.float32)
    codes = neighbours.Codes(x / np.linalg.norm(x, axis=1, keepdims=True), 100_000)
    need = codes.credits(np.array([1.0, 0.99, 0.9, 0.5, -np.inf]))
    radii = codes.radii(need, np.arange(5))
    for n, r in zip(need, radii):
        assert (r + 1).sum() == (n if n else codes.s + 1)
    assert need[-1] == 0 and (np.diff(codes.radius) >= 0).all()


def test_large_buckets_are_worked_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MAX_BUCKET", 16)
    x = clusters(160, spread=0.2)
    ids = [f"t{i:04d}" for i in range(len(x))]
    got, want = set(asked(spark, ids, x)), brute(ids, x)
    assert len(got & want) >= 0.98 * len(want)


def test_few_silent_null_and_narrow_vectors(spark):
    df = spark.createDataFrame([("a", bytearray([1, 2])), ("b", bytearray([2, 4])), ("c", bytearray([0, 0])), ("d", None), ("e", bytearray([1])), (None, bytearray([1, 1]))], "id string, vec binary")
    assert {(r[0], r[1]) for r in neighbours.k_nearest(spark, df, width=2).select("id", "neighbour").collect()} == {("a", "b"), ("b", "a")}
    assert neighbours.k_nearest(spark, df.filter("false"), width=2).count() == 0


TRACK = "track_id string, artist string, dedupe_key string, embedding binary, scale float, features_version int"
ARRIVAL = "arrival_id long, batch_no int, " + TRACK + ", ord string, cell int"


def test_repeats_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = clusters(200, 64, 2, 0.01)
    artists = [f"{g} Vorodalunek" for g in ("Anna", "Bertil", "Carla")]
    tracks = [(f"t{i}", artists[i % 3], f"a|{i}", bytearray(x[i].tobytes()), 0.1, 4) for i in range(120)]
    new = [(1000 + i, [1, 2, None][i % 3], f"t{i}" if i < 4 else f"n{i}", artists[rng.integers(0, 3)], "a|7" if i == 20 else None if i % 2 else "|", bytearray(x[120 + i].tobytes()), 0.1 if i % 7 else None, 4) for i in range(80)]
    t, a = spark.createDataFrame(tracks, TRACK), spark.createDataFrame([(*r, "clash", 1) for r in new], ARRIVAL)
    got = {r[0] for r in arrivals.repeats(spark, t, a).collect()}
    unit = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = set()
    for i, r in enumerate(new):
        same = [j for j in range(120 + i) if unit[120 + i] @ unit[j] > 0.995 and (tracks[j] if j < 120 else new[j - 120][2:])[1] == r[3] and (j < 120 or (j - 120) % 7)]
        if i < 4 or i == 20 or (r[6] is not None and same):
            want.add(r[0])
    assert got == want and 10 < len(got) < 80
    assert arrivals.repeats(spark, t, a.filter("false")).count() == 0
    assert {r[0] for r in arrivals.repeats(spark, t.filter("false"), a).collect()} <= got


def test_copies_inside_one_batch_and_late_batches(spark):
    v = clusters(1, 64)[0]
    row = lambda n, batch, artist: (n, batch, f"n{n}", artist, None, bytearray(v.tobytes()), 0.1, 4, "x", 1)
    a = spark.createDataFrame([row(5, 1, "Anna Vorodalunek"), row(6, 1, "Anna Vorodalunek"), row(2, 2, "ANNA VORODALUNEK"), row(9, 2, "Bertil Vorodalunek")], ARRIVAL)
    got = {r[0] for r in arrivals.repeats(spark, spark.createDataFrame([], TRACK), a).collect()}
    assert got == {5, 6}


def store_rows(spark, x, first=0, artist="Anna Vorodalunek"):
    return spark.createDataFrame([(first + i, artist, bytearray(v.tobytes())) for i, v in enumerate(x)], "ord long, artist string, vec binary")


def test_a_second_session_goes_on_from_the_store(spark, tmp_path, monkeypatch):
    """The store is opened from its folder alone, reads only the cells that can match, and its cells split as they grow."""
    monkeypatch.setattr(arrivals, "CELL", 8)
    x = clusters(600, 64, 9, 0.05)
    path = f"file://{tmp_path}/store"
    arrivals.CellStore.create(spark, path, store_rows(spark, x[:300]))
    read = []
    plain = arrivals.CellStore._read
    monkeypatch.setattr(arrivals.CellStore, "_read", lambda self, versions, cells=None: read.append(cells) or plain(self, versions, cells))
    opened = arrivals.CellStore.open(spark, path)
    cells = len(opened.tree.cells())
    query = store_rows(spark, x[:3], first=5_000)
    assert {r[0] for r in opened.ingest(query).collect()} == {5_000, 5_001, 5_002}
    assert cells > 10 and 0 < len(read[-1]) < cells / 2
    monkeypatch.setattr(arrivals, "GROWN", 2)
    grown = arrivals.CellStore.open(spark, path)
    # Stored rows of greater number than what comes late are found then.
    unit = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    got = {r[0] for r in grown.ingest(store_rows(spark, x[300:], first=300)).collect()}
    want = {300 + i for i in range(300) if (unit[300 + i] @ unit[: 300 + i].T > 0.995).any()} | {5_000 + i for i in range(3) if (unit[i] @ unit[300:].T > 0.995).any()}
    assert got == want
    assert len(grown.tree.cells()) > cells and grown.tree.rows[grown.tree.cells()].sum() == 603


def test_unfinished_versions_are_not_read(spark, tmp_path):
    x = clusters(40, 64, 3, 0.05)
    path = f"file://{tmp_path}/store"
    store = arrivals.CellStore.create(spark, path, store_rows(spark, x[:20]))
    store._append(store._placed(store._once(store_rows(spark, x[20:], first=20))))  # and the job dies before its commit
    opened = arrivals.CellStore.open(spark, path)
    assert opened._read(opened.versions).count() == 20
    assert {r[0] for r in opened.ingest(store_rows(spark, x[:1], first=90)).collect()} == {90}


SAME_ARTIST = [
    ("Michael Dunogaguvur", "Mick Dunogaguvur"), ("Dunogaguvur, Michael", "Michael Dunogaguvur"), ("M. Dunogaguvur", "Michael Dunogaguvur"), ("The Anna Vorodalunek Quartet", "Vorodalunek, Anna (Quartet)"),
    ("Anna Vorodalunek feat. Someone Else", "Anna Vordalunek"), ("Hajaregovit Big Band", "Hajaregovti Big Band"), ("The Logekudade Ensemble", "Logekudade Ens."), ("OskarT. Susotukatar", "Oskar T. Susotukatar"),
]
OTHER_ARTIST = [("Anna Vorodalunek", "Bertil Vorodalunek"), ("Jonas Vorodalunek", "Tomas Vorodalunek"), ("Anna Vorodalunek", "Anna Kebisadamo"), ("Anna Vorodalunek Trio", "Anna Vorodalunek Quartet"), ("Anna K. Vorodalunek", "Anna B. Vorodalunek")]


@pytest.mark.parametrize("a, b", SAME_ARTIST)
def test_one_artist(a, b):
    assert names.same_lead_artist(a, b) and names.same_lead_artist(b, a)


@pytest.mark.parametrize("a, b", OTHER_ARTIST)
def test_two_artists(a, b):
    assert not names.same_lead_artist(a, b)


def test_title_rules():
    match = lambda a, b: names.title_match(names.read_title(a), names.read_title(b)) != ""
    for a, b in (("Letters to Gorigo Wikiwe", "Lttrs to Gorigo Wikiwe [Radio Edit]"), ("Davile, Nopadu", "Nopadu Davele"), ("Waltz 4 Jofuve Netemo", "Waltz for J0fuve Netemo"), ("Song of Kubara Pt. 3", "Song of Kubara, Part 3"), ("Thestaircase of Dahogu", "The Staircase of Dahogu")):
        assert match(a, b), (a, b)
    for a, b in (("Song of Kubara Pt. 3", "Song of Kubara Pt. 4"), ("Song of Kubara", "Song of Kubara No. 2"), ("Kubara Nisode", "Telapo Gorihu")):
        assert not match(a, b), (a, b)
    assert names.read_title("Intro") is None and names.read_title("(Live)") is None and names.read_title(None) is None


def test_entities_of_names(spark):
    rows = ["Anna Vorodalunek", "anna vorodalunek", "Vorodalunek, Anna", "A. Vorodalunek", "Bertil Vorodalunek", "Michael Kebisadamo", "M. Kebisadamo", "Maria Kebisadamo", None, "", "  "]
    df = spark.createDataFrame([(r, "x", 1) for r in rows * 2], "name string, entity string, node int")
    got = {r["name"]: r["entity"] for r in names.resolve(spark, df, "artist").collect()}
    assert got["Anna Vorodalunek"] == got["Vorodalunek, Anna"] == got["A. Vorodalunek"] != got["Bertil Vorodalunek"]
    # The initial fits two people: it joins neither.
    assert len({got["Michael Kebisadamo"], got["Maria Kebisadamo"], got["M. Kebisadamo"]}) == 3
    assert None not in got and "" not in got
    assert names.resolve(spark, df.filter("false"), "artist").count() == 0


def test_variant_pairs_against_all_pairs(spark, data):
    tracks = spark.read.parquet(f"{data}/tracks.parquet")
    got = {(r[0], r[1], r[2]) for r in names.variant_pairs(spark, tracks).collect()}
    titles = sorted({r[0] for r in tracks.select("title").collect() if r[0] and names.read_title(r[0])})
    direct = {("title", a, b) for a, b in itertools.combinations(titles, 2) if names.normal_title(a) != names.normal_title(b) and names.title_match(names.read_title(a), names.read_title(b))}
    assert direct <= got


def typo(word, rng):
    letters, i = list(word), rng.randrange(len(word))
    kind, c = rng.randrange(4), rng.choice("aeioubdfghklmnprstvz")
    if kind == 0:
        letters[i] = c
    elif kind == 1:
        letters.insert(i, c)
    elif kind == 2 and len(word) > 1:
        del letters[i]
    elif len(word) > 1:
        i = min(i, len(word) - 2)
        letters[i], letters[i + 1] = letters[i + 1], letters[i]
    return "".join(letters)


def test_keys_meet_every_match():
    """Names and titles of all lengths with two random edits: whatever the rules accept has a key in common."""
    import random

    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("aeioubdfghklmnprstvz") for _ in range(n))
    met = {"artist": 0, "title": 0}
    for _ in range(6_000):
        g, s = rng.choice(["", "m", "samuel", "samuel samantha", word(rng.randrange(2, 9))]), word(rng.randrange(2, 24))
        h, t = (typo(g, rng) if len(g) > 1 and rng.random() < 0.2 else g[:1] if rng.random() < 0.2 else g), typo(typo(s, rng), rng)
        if rng.random() < 0.1:
            h, t = "", typo(g + s, rng)
        a, b = (g, "", s, ""), (h, "", t, "")
        pairs = [("artist", a, b)]
        x = " ".join(word(rng.randrange(1, 10)) for _ in range(rng.randrange(1, 5)))
        y = typo(typo(x, rng), rng).strip() if rng.random() < 0.7 else " ".join(reversed(x.split()))
        pairs.append(("title", (x, " ".join(sorted(x.split())), "3"), (y, " ".join(sorted(y.split())), "3")))
        for field, p, q in pairs:
            if names._MATCH[field](p, q, True):
                met[field] += 1
                assert len(np.intersect1d(names.blocking_keys(field, [p])[0], names.blocking_keys(field, [q])[0])), (p, q)
    assert min(met.values()) > 1_000


def test_artist_pairs_against_all_pairs(spark, data):
    """Every two spellings that the rule calls the same are in one entity."""
    tracks = spark.read.parquet(f"{data}/tracks.parquet")
    entity = {r["name"]: r["entity"] for r in names.resolve(spark, tracks.select(F.col("artist").alias("name")), "artist").collect()}
    nodes = {n: names.read_artist(n) for n in entity}
    for a, b in itertools.combinations(sorted(entity), 2):
        if names.artist_match(nodes[a], nodes[b]) == "same":
            assert entity[a] == entity[b], (a, b)


def test_first_names():
    artist = lambda a, b: names.artist_match(names.read_artist(a), names.read_artist(b))
    assert not artist("Martin Smithers", "Martina Smithers") and not artist("Paul Joneson", "Paula Joneson")
    assert artist("Sam Okaforu", "Samuel Okaforu") == artist("Sam Okaforu", "Samantha Okaforu") == "weak" and not artist("Samuel Okaforu", "Samantha Okaforu")
    assert artist("Okaforu Samuel", "Samuel Okaforu") == "same" and artist("Rob Okaforu", "Bob Okaforu") == "same"


def test_merged_profiles_are_matched_again(spark):
    """L. Tudibovar is Leonard by his entity, and so meets the spelling that runs both together; a letter leaves two namesakes apart."""
    rows = ["Leonard Tudibovarin", "L. Tudibovarim", "leonardtudibovarims", "Anthony T. Vorodalunek", "Anthony Vorodalunek", "Anthony R. Vorodalunek", "Lttrs to Gorigo Wikiwe", "Letters to Gorigo Wikiwe"]
    df = spark.createDataFrame([(r,) for r in rows], "name string")
    got = {r["name"]: r["entity"] for r in names.resolve(spark, df, "artist").collect()}
    assert got["Leonard Tudibovarin"] == got["L. Tudibovarim"] == got["leonardtudibovarims"]
    assert got["Anthony T. Vorodalunek"] != got["Anthony R. Vorodalunek"]


def test_large_name_groups_are_worked_in_blocks(spark, monkeypatch):
    rows = [f"{g} Vorodalunek{e}" for g in ("Anna", "Bertil", "Carla", "Dmitri", "Esther") for e in ("", "a", "e", "i", "o")]
    df = spark.createDataFrame([(r,) for r in rows], "name string")
    whole = {r["name"]: r["entity"] for r in names.resolve(spark, df, "artist").collect()}
    monkeypatch.setattr(names, "UNIT", 4)
    blocks = {r["name"]: r["entity"] for r in names.resolve(spark, df, "artist").collect()}
    groups = lambda m: {frozenset(n for n in m if m[n] == e) for e in m.values()}
    assert groups(whole) == groups(blocks) and len(set(whole.values())) == 5


def test_distance():
    assert names.distance("abcd", "abdc", 2) == 1 and names.distance("abc", "xyz", 2) == 3 and names.distance("", "ab", 2) == 2 and names.distance("kitten", "sitting", 3) == 3


PASSAGE = "Few remember that Renata wrote the long waltz under borrowed stage lamps while a retired surveyor counted the bars aloud after the tape machine caught fire near the old press"
WORDS = PASSAGE.split()


def leak_rows(spark, texts, passages=(PASSAGE,)):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, passage string")
    return {(r[0], r[1]) for r in leaks.leaks(docs, items).collect()}


def test_leaks_restyled_and_altered(spark):
    part = WORDS[5:23]
    altered = part[:4] + part[5:11] + ["really"] + part[12:]
    texts = [
        PASSAGE, "Intro. " + " ".join(part).upper() + " outro", "<p>" + " ".join(f"*{w}*" if i % 3 else w for i, w in enumerate(part)) + "</p>", " ".join(w[:1] + "​" + w[1:] for w in part), " ".join(part).replace("a", "а").replace("e", "е"),
        "\n".join("> " + w for w in part), " ".join(altered), " ".join(WORDS[:10]) + " something else entirely", "nothing of the kind", None, "", "  ", PASSAGE,
    ]
    assert leak_rows(spark, texts) == {(i, 0) for i in (0, 1, 2, 3, 4, 5, 6, 12)}


def test_leaks_without_items_or_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, "")], "item_id long, passage string")
    assert leaks.leaks(docs, items).count() == 0
    some = spark.createDataFrame([(1, PASSAGE)], "doc_id long, text string")
    assert leaks.leaks(some, items.filter("false")).count() == 0


def test_walks_reach_the_target_recall():
    n, rng = leaks.walks(), np.random.default_rng(5)
    windows = rng.integers(1, 1 << 62, size=(2_000, leaks.WINDOW)).astype(np.uint64)
    altered = leaks.edited(windows, leaks.WINDOW // leaks.EDIT_EACH, rng)
    met = (leaks.walk_keys(windows) == leaks.walk_keys(altered)).any(axis=1).mean()
    assert met >= leaks.TARGET - 0.02 and leaks.walks.__wrapped__(0.8) < n
    with pytest.raises(ValueError, match="walks reach"):
        leaks.walks.__wrapped__(1.0, most=2)


def test_leak_recall_against_brute_force(data, spark):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    items = spark.read.parquet(f"{data}/eval_items.parquet")
    got = {(r[0], r[1]) for r in leaks.leaks(docs, items).collect()}
    passages = [(r["item_id"], leaks.words_of(r["passage"])) for r in items.collect()]
    anchors = {}
    for k, (_, w) in enumerate(passages):
        for a in range(len(w) - 1):
            anchors.setdefault((w[a], w[a + 1]), []).append((k, a))
    want = set()
    for r in docs.filter("text IS NOT NULL").collect():
        w = leaks.words_of(r["text"])
        for j in range(len(w) - 1):
            for k, a in anchors.get((w[j], w[j + 1]), ()):
                if (r["doc_id"], passages[k][0]) not in want and leaks.is_leak(*leaks.chain(w, passages[k][1], j, a), len(passages[k][1])):
                    want.add((r["doc_id"], passages[k][0]))
    assert got <= want and len(got) >= 0.95 * len(want)


PROSE = "The band had moved to the coast and lost its drummer, but the second take of the song is the best thing on it. You can hear the room in every chorus, and that is fine with us. "


def test_stuffed_pages(spark):
    stuffed = [
        "cheap records, download, cheap records, ringtone, download, download, cheap records, lyrics, ringtone", "#BuyOnline #TopHits #NoSignup #GuitarLessons #Lyrics #Karaoke #Remix",
        "\n".join(f"Song {i} - https://spam.test/song-{i}" for i in range(12)), "\n".join(f"{a} {b}" for a in ("lyrics", "karaoke", "discount") for b in ("Ostrand", "Kelvinbay", "Maravent", "Noviskar")),
        "SKU 45 · LP · gatefold · 180g · mint · sale · OBI · size L · import · black wax", "You can hear the room. " + "ringtone | download | " * 20,
        "Looking for lyrics in Ostrand? Our lyrics is the best lyrics. Cheap lyrics Ostrand, top lyrics, fast lyrics. lyrics Kelvinbay: get lyrics and lyrics today! " * 2,
    ]
    fine = [
        PROSE * 3, PROSE + "\n\nTracks:\n" + "\n".join(f"{i}. Song of the Sea (3:{i:02d})" for i in range(1, 9)), PROSE + "\n\nSources:\n" + "\n".join(f"https://good.test/{i}" for i in range(4)),
        PROSE + "\n\nPersonnel\ncello: Anna Vorodalunek\ntrumpet: Bertil Kebisadamo", "", None, "  \n ", "Intro",
        "Oh the river, oh the river, carry me over the bay,\ncarry me till the end of the day.\n" * 3 + PROSE,
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(stuffed + fine)] + [(100 + i, PROSE, "x") for i in range(5)], "doc_id long, text string, i string")
    assert {r["doc_id"] for r in spam.stuffed_pages(df).collect()} == set(range(len(stuffed)))
    assert spam.stuffed_pages(df.filter("false")).count() == 0


def test_pages_that_repeat_one_sentence(spark):
    phrase = "You can get all of the best records here with us and it is the cheapest shop in the town."
    refrain = "Oh the river, it is the river, carry me over the bay,\nand carry me home till the end of the day.\n"
    stuffed = [(phrase + " ") * 20, (phrase + "\n") * 20, (phrase[:-1].lower() + "\n") * 20, PROSE + "\n\n" + (phrase + "\n\n") * 20]
    fine = [PROSE + "\n\n" + refrain * 5 + "\n" + PROSE.replace("second", "first").replace("coast", "north"), (PROSE + "\n") * 3, PROSE.replace(". ", ".\n") * 3]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(stuffed + fine)] + [(100 + i, PROSE) for i in range(9)], "doc_id long, text string")
    assert {r["doc_id"] for r in spam.stuffed_pages(df).collect()} == set(range(len(stuffed)))


def test_nothing_else_imports_this_folder():
    from pathlib import Path

    root = Path(spam.__file__).resolve().parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "vecstrand.llm" not in p.read_text(), p


def test_titles_that_end_alike_do_not_meet():
    """One common last word is no key: a key of it alone pairs all titles that have it."""
    rng = random.Random(7)
    titles = sorted({"".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(5)) + " shoreline" for _ in range(600)})
    keys, rows = names.blocking_keys("title", [names.read_title(t) for t in titles])
    held = Counter(keys.tolist())
    assert max(held.values()) < 30
    for t in titles[:200]:
        u = t.replace(" ", "")
        for _ in range(5):
            v = u
            for _ in range(2):
                i, c = rng.randrange(len(v)), rng.choice("aeioubdst")
                v = rng.choice([v[:i] + c + v[i + 1 :], v[:i] + c + v[i:], v[:i] + v[i + 1 :], v[:i] + v[i : i + 2][::-1] + v[i + 2 :]])
            if names.distance(u, v, 2) <= 2:
                assert len(np.intersect1d(names.edit_keys([u], 2), names.edit_keys([v], 2))), (u, v)


def test_letters_refuse_no_titles_that_match():
    rng = random.Random(8)
    words = ["ballad", "window", "shoreline", "orchard", "lantern", "meridian", "mn", "lntrn", "orchrd", "windw", "shorelien", "balled"]
    nodes = [names.read_title(" ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))) for _ in range(150)]
    left, right = np.triu_indices(len(nodes), 1)
    may = names.titles_may_match(nodes, left, right)
    found = np.array([names.title_match(nodes[i], nodes[j]) != "" for i, j in zip(left, right)])
    assert found.any() and not (found & ~may).any() and (~may).any()


def test_who_asks_many_units_leaves_in_parts():
    """20 million vectors lie in 512 units a table; a batch whose vectors ask all of them is 2,000 times its size, and must not be held at once."""
    x = clusters(300, 64)
    codes = neighbours.Codes(x / np.linalg.norm(x, axis=1, keepdims=True).astype(np.float32), 20_000_000)
    codes.lay({g: 1_000 for g in range(codes.m << codes.p)})
    e = np.zeros(300, neighbours._entry(64, codes.m))
    e["z"], e["v"], e["need"] = np.arange(300), codes.values(x.astype(np.float32)), codes.m * (codes.s + 1)
    home = [codes.first[t, codes.groups(e["v"])[:, t]] for t in range(codes.m)]
    parts = list(neighbours._asking(e, codes, home, codes.m))
    assert max(len(w) for _, w in parts) * e.itemsize <= neighbours.PACK + e.nbytes < len(e) * codes.units * e.itemsize
    asked = np.concatenate([u * 300 + w for u, w in parts])
    assert len(np.unique(asked)) == len(asked) == 300 * (codes.units - codes.m)


def test_neighbours_on_disk_do_not_grow_with_the_units_asked(spark, monkeypatch, tmp_path):
    """Isotropic vectors ask every unit of a table; no copy of who asks travels, and what a shuffle wrote goes with its table."""
    from vecstrand.plans.durable import Scratch

    x = np.random.default_rng(6).standard_normal((1_200, 16))
    x = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 127).astype(np.int8)
    ids = [f"t{i:04d}" for i in range(len(x))]
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    spent = []
    for most in (65_536, 32):
        monkeypatch.setattr(neighbours, "MAX_BUCKET", most)
        scratch, before = Scratch(spark, "copies", tidy=True), written()
        got = asked(spark, ids, x, scratch=scratch)
        spent.append(written() - before)
        assert len(got) == len(set(got)) == 5 * len(ids)
        assert len(set(got) & brute(ids, x)) >= 0.95 * len(ids) * 5
    # 16 units a table and more blocks: as copies of who asks, many times the shuffle.
    assert spent[1] < 2 * spent[0]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
