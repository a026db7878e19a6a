"""Queries over scans, sinks, predicates and joins of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecstrand.functions import vector as V
from vecstrand.functions.text import dedupe_key_column, fold_column, names_edition_column, normal_artist_column, normal_title_column
from vecstrand.operators import corpus as C
from vecstrand.sources.tables import FEATURES_VERSION, live, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

_LIVE = "analyzed_at IS NOT NULL AND duplicate_of IS NULL AND features_version = 4"
#: The servable vectors in SQL.
MATRIX = f"""
decoded AS (SELECT track_id, title, artist, dedupe_key, CASE WHEN len(feel) = 8 AND len(list_filter(feel, lambda x: x IS NULL OR isnan(x))) = 0 THEN feel END AS feel, CASE WHEN rhythm.tempo_bpm > 0 AND NOT isnan(rhythm.tempo_bpm) THEN rhythm.tempo_bpm END AS tempo, analyzed_at, scale, hex(embedding) AS h FROM tracks
  WHERE {_LIVE} AND octet_length(embedding) = 64 AND scale > 0 AND regexp_matches(hex(embedding), '[^0]')),
corpus AS (SELECT track_id, title, artist, dedupe_key, feel, tempo, analyzed_at,
  list_transform(range(64), lambda i: (CASE WHEN ('0x' || h[2*i+1:2*i+2])::INT > 127 THEN ('0x' || h[2*i+1:2*i+2])::INT - 256 ELSE ('0x' || h[2*i+1:2*i+2])::INT END) * scale::DOUBLE) AS vec FROM decoded)
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tracks")


@query(f"WITH {MATRIX} SELECT track_id, round(list_sum(list_transform(vec, lambda x: x * x)), 6) AS square, round(vec[1], 6) AS first FROM corpus")
def corpus_live(spark, d):
    m = C.matrix(_tracks(spark, d))
    return m.select("track_id", F.round(V.dot(F.col("vec"), F.col("vec")), 6).alias("square"), F.round(F.get("vec", F.lit(0)), 6).alias("first"))


@query(f"SELECT track_id, analyzed_at FROM tracks WHERE {_LIVE} AND analyzed_at >= TIMESTAMP '2026-08-01 00:00:00'")
def corpus_since(spark, d):
    return C.since(_tracks(spark, d), F.lit("2026-08-01 00:00:00").cast("timestamp_ntz")).select("track_id", "analyzed_at")


@query("""SELECT count(*) AS tracks, count(*) FILTER (analyzed_at IS NOT NULL AND duplicate_of IS NULL AND features_version = 4) AS live,
  count(*) FILTER (analyzed_at IS NOT NULL AND duplicate_of IS NULL AND features_version < 4 AND reanalysis_failed_at IS NULL) AS stale,
  count(*) FILTER (reanalysis_failed_at IS NOT NULL) AS failed, count(*) FILTER (duplicate_of IS NOT NULL) AS retired, count(*) * 2048 AS estimated_bytes FROM tracks""")
def live_counts(spark, d):
    is_live = F.col("analyzed_at").isNotNull() & F.col("duplicate_of").isNull() & (F.col("features_version") == FEATURES_VERSION)
    return _tracks(spark, d).agg(
        F.count("*").alias("tracks"), F.count_if(is_live).alias("live"), F.count_if(C.stale()).alias("stale"), F.count_if(F.col("reanalysis_failed_at").isNotNull()).alias("failed"),
        F.count_if(F.col("duplicate_of").isNotNull()).alias("retired"), (F.count("*") * 2048).alias("estimated_bytes"),
    )


@query("SELECT j.job_id, j.rec_id, t.track_id IS NOT NULL AS found, coalesce(t.title, j.rec_id) AS title, coalesce(t.artist, 'Unknown artist') AS artist FROM jobs j LEFT JOIN tracks t ON t.track_id = j.rec_id WHERE j.rec_id IS NOT NULL")
def multi_get(spark, d):
    """One slot a request, repeats and misses included, with placeholders for what is not there."""
    jobs = table(spark, d, "jobs").filter("rec_id IS NOT NULL").select("job_id", F.col("rec_id").alias("track_id"))
    got = C.multi_get(jobs, _tracks(spark, d).select("track_id", "title", "artist", F.lit(True).alias("there")))
    return got.select("job_id", F.col("track_id").alias("rec_id"), F.coalesce("there", F.lit(False)).alias("found"), F.coalesce("title", "track_id").alias("title"), F.coalesce("artist", F.lit("Unknown artist")).alias("artist"))


@query("""SELECT track_id, analyzed_at FROM (SELECT track_id, analyzed_at, reanalysis_attempted_at, reanalyze_priority,
  coalesce(reanalyze_priority >= TIMESTAMP '2026-11-01 00:00:00' - INTERVAL 600 SECONDS, false) AS fresh FROM tracks
  WHERE analyzed_at IS NOT NULL AND duplicate_of IS NULL AND features_version < 4 AND reanalysis_failed_at IS NULL)
  ORDER BY fresh DESC, CASE WHEN fresh THEN reanalyze_priority END DESC NULLS LAST, reanalysis_attempted_at NULLS FIRST, analyzed_at, track_id LIMIT 50""")
def stale_backlog(spark, d):
    return C.backlog(_tracks(spark, d), F.lit("2026-11-01 00:00:00").cast("timestamp_ntz"), 600, 50).select("track_id", "analyzed_at")


@query("SELECT track_id, title, artist, album, artwork_url, '' AS preview_url, source, attribution.url AS attribution_url FROM tracks")
def contract_fields(spark, d):
    return C.contract(_tracks(spark, d))


@query("SELECT track_id, CASE WHEN embedding IS NULL THEN 'unanalyzed' WHEN coalesce(features_version, 0) = 4 THEN 'ready' ELSE 'stale' END AS status FROM tracks")
def seed_readiness(spark, d):
    t = _tracks(spark, d)
    return t.select("track_id", C.readiness(t).alias("status"))


@query("""SELECT track_id, coalesce(nullif(source, ''), CASE WHEN strpos(track_id, ':') > 1 THEN split_part(track_id, ':', 1) END, 'halyard') AS source,
  CASE WHEN strpos(track_id, ':') > 1 THEN substr(track_id, strpos(track_id, ':') + 1) ELSE track_id END AS local_id FROM tracks""")
def source_ids(spark, d):
    local = F.when(F.instr("track_id", ":") > 1, F.expr("substring(track_id, instr(track_id, ':') + 1)")).otherwise(F.col("track_id"))
    return _tracks(spark, d).select("track_id", C.source_of(F.col("track_id"), F.col("source")).alias("source"), local.alias("local_id"))


@query("""WITH registry(source, position) AS (VALUES ('halyard', 0), ('openreel', 1)), t AS (SELECT track_id, CASE WHEN strpos(track_id, ':') > 1 THEN split_part(track_id, ':', 1) ELSE 'halyard' END AS source FROM tracks)
  SELECT t.source, r.position, count(*) AS tracks FROM t LEFT JOIN registry r USING (source) GROUP BY ALL""")
def source_routing(spark, d):
    """Ids go to the registered source of their prefix; an unknown prefix to none."""
    registry = spark.createDataFrame([("halyard", 0), ("openreel", 1)], "source string, position int")
    ids = _tracks(spark, d).select(C.source_of(F.col("track_id"), F.lit(None).cast("string")).alias("source"))
    return ids.groupBy("source").agg(F.count("*").alias("tracks")).join(F.broadcast(registry), "source", "left").select("source", "position", "tracks")


@query("SELECT step, step % 11 AS arm, (step // 11) * 100 AS row_offset FROM range(0, 500) t(step)")
def page_plan(spark, d):
    return spark.range(500).select(F.col("id").alias("step"), (F.col("id") % 11).alias("arm"), F.expr("(id div 11) * 100").alias("row_offset"))


@query("""WITH raw AS (SELECT track_id, title, artist, album, artwork_url, attribution FROM tracks)
  SELECT track_id, title, artist, coalesce(nullif(artwork_url, ''), 'none') AS artwork_url, CASE WHEN attribution.url IS NOT NULL THEN attribution.license END AS license FROM raw WHERE title IS NOT NULL""")
def payload_tracks(spark, d):
    """Source payloads (JSON) to tracks: fixed schema, unknown keys dropped, rows without a title dropped, a licence only beside a link."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "name", "artist", "image")] + [T.StructField("share", T.StructType([T.StructField("url", T.StringType()), T.StructField("license", T.StringType())]))])
    payload = F.to_json(F.struct(F.col("track_id").alias("id"), F.col("title").alias("name"), "artist", F.col("artwork_url").alias("image"), F.col("attribution").alias("share"), F.lit(1).alias("unknown")))
    p = _tracks(spark, d).select(F.from_json(payload, schema).alias("p")).filter("p.name IS NOT NULL")
    return p.select(F.col("p.id").alias("track_id"), F.col("p.name").alias("title"), F.col("p.artist").alias("artist"), F.coalesce(F.nullif(F.col("p.image"), F.lit("")), F.lit("none")).alias("artwork_url"), F.when(F.col("p.share.url").isNotNull(), F.col("p.share.license")).alias("license"))


@query("""WITH hits AS (SELECT track_id, title, artist, 0 AS source_order, analyzed_at FROM tracks WHERE contains(lower(title), 'blues') OR contains(lower(artist), 'blues') OR contains(lower(album), 'blues')
  UNION ALL SELECT track_id, title, artist, 1, analyzed_at FROM arrivals WHERE contains(lower(title), 'blues') OR contains(lower(artist), 'blues') OR contains(lower(album), 'blues')),
  once AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY source_order, analyzed_at NULLS FIRST, title NULLS FIRST) AS n FROM hits) SELECT track_id, title, artist, source_order FROM once WHERE n = 1""")
def federated_search(spark, d):
    """Substring search over two sources, in their order, each id once."""
    cols = ["track_id", "title", "artist", "album", "analyzed_at"]
    hits = C.text_search(_tracks(spark, d).select(*cols), "blues").withColumn("source_order", F.lit(0)).unionByName(C.text_search(table(spark, d, "arrivals").select(*cols), "blues").withColumn("source_order", F.lit(1)))
    w = Window.partitionBy("track_id").orderBy("source_order", F.asc_nulls_first("analyzed_at"), F.asc_nulls_first("title"))
    return hits.withColumn("n", F.row_number().over(w)).filter("n = 1").select("track_id", "title", "artist", "source_order")


@query("""WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY analyzed_at DESC NULLS LAST, arrival_id DESC) AS n FROM arrivals WHERE analyzed_at IS NOT NULL) WHERE n = 1)
  SELECT coalesce(t.track_id, c.track_id) AS track_id, coalesce(c.title, t.title) AS title, CASE WHEN c.track_id IS NOT NULL THEN c.features_version ELSE t.features_version END AS features_version,
  CASE WHEN c.track_id IS NOT NULL THEN c.analyzed_at ELSE t.analyzed_at END AS analyzed_at, hex(coalesce(c.embedding, t.embedding)) AS embedding FROM tracks t FULL OUTER JOIN c ON t.track_id = c.track_id""")
def upsert_arrivals(spark, d):
    """Arrivals merged into the corpus: the latest of an id wins; title and vector are never erased by a change that lacks them."""
    cols = ["track_id", "title", "features_version", "analyzed_at", "embedding"]
    latest = Window.partitionBy("track_id").orderBy(F.desc_nulls_last("analyzed_at"), F.desc("arrival_id"))
    changes = table(spark, d, "arrivals").filter("analyzed_at IS NOT NULL").withColumn("n", F.row_number().over(latest)).filter("n = 1").select(*cols)
    return C.upsert(_tracks(spark, d).select(*cols), changes, "track_id", "analyzed_at", ["title", "embedding"]).withColumn("embedding", F.hex("embedding"))


@query("SELECT track_id, list_transform(feel, lambda x: round(x, 4)) AS feel FROM tracks WHERE feel IS NOT NULL AND len(list_filter(feel, lambda x: isnan(x))) = 0")
def feel_round(spark, d):
    return _tracks(spark, d).filter(F.col("feel").isNotNull() & ~F.exists("feel", lambda x: F.isnan(x))).select("track_id", F.transform("feel", lambda x: F.round(x, 4)).alias("feel"))


@query("SELECT track_id, CASE WHEN NOT isnan(rhythm.tempo_bpm) THEN rhythm.tempo_bpm END AS tempo_bpm, rhythm.key AS key, rhythm.mode AS mode FROM tracks WHERE rhythm IS NOT NULL AND (rhythm.tempo_bpm IS NOT NULL OR rhythm.beat_strength IS NOT NULL OR rhythm.loudness_lufs IS NOT NULL OR rhythm.loudness_range IS NOT NULL OR rhythm.key IS NOT NULL OR rhythm.mode IS NOT NULL OR rhythm.key_strength IS NOT NULL)")
def rhythm_fields(spark, d):
    """Rhythm narrowed to its keys; a struct of nothing but nulls is none, and a tempo that is no number is null."""
    some = F.lit(False)
    for k in C.RHYTHM_KEYS:
        some = some | F.col("rhythm")[k].isNotNull()
    return _tracks(spark, d).filter(F.col("rhythm").isNotNull() & some).select("track_id", F.nullif(F.col("rhythm.tempo_bpm"), F.lit(float("nan"))).alias("tempo_bpm"), F.col("rhythm.key").alias("key"), F.col("rhythm.mode").alias("mode"))


@query("SELECT track_id, 'https://play.test/preview/' || track_id AS preview_url FROM tracks")
def playable_urls(spark, d):
    return _tracks(spark, d).select("track_id", F.concat(F.lit("https://play.test"), F.lit("/preview/"), "track_id").alias("preview_url"))


@query("SELECT job_id, list_filter(list_transform(string_split(' ' || coalesce(seed_id, '') || ', ' || coalesce(rec_id, '') || ',, x ', ','), lambda x: trim(x)), lambda x: x <> '')[1:50] AS ids FROM jobs")
def rec_lists(spark, d):
    text = F.concat(F.lit(" "), F.coalesce("seed_id", F.lit("")), F.lit(", "), F.coalesce("rec_id", F.lit("")), F.lit(",, x "))
    return table(spark, d, "jobs").select("job_id", F.slice(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""), 1, 50).alias("ids"))


@query("SELECT doc_id % 7 AS shard, count(*) AS documents, min(doc_id) AS least FROM documents GROUP BY 1")
def shards(spark, d):
    return table(spark, d, "documents").groupBy(F.pmod("doc_id", F.lit(7)).alias("shard")).agg(F.count("*").alias("documents"), F.min("doc_id").alias("least"))


@query("SELECT cache_id, json_valid(value_json) AS valid FROM cache_entries WHERE value_json IS NOT NULL AND (expires_at IS NULL OR expires_at > TIMESTAMP '2026-11-01 00:00:00') AND starts_with(cache_id, 'attr:')")
def cache_live(spark, d):
    """Entries that have not expired (a null expiry never does), with whether their JSON can be read."""
    fresh = F.col("expires_at").isNull() | (F.col("expires_at") > F.lit("2026-11-01 00:00:00").cast("timestamp_ntz"))
    return table(spark, d, "cache_entries").filter(F.col("value_json").isNotNull() & fresh & F.startswith("cache_id", F.lit("attr:"))).select("cache_id", F.expr("try_parse_json(value_json) IS NOT NULL").alias("valid"))


_F32 = """h AS (SELECT track_id, hex(embedding) AS h, scale::DOUBLE AS scale FROM tracks WHERE octet_length(embedding) > 0 AND scale > 0 AND scale < 1e30),
  f AS (SELECT track_id, list_transform(range(len(h) // 2), lambda i: (CASE WHEN ('0x' || h[2*i+1:2*i+2])::INT > 127 THEN ('0x' || h[2*i+1:2*i+2])::INT - 256 ELSE ('0x' || h[2*i+1:2*i+2])::INT END * scale)::FLOAT::DOUBLE) AS x FROM h),
  e AS (SELECT track_id, list_transform(x, lambda v: struct_pack(v := v, e := CASE WHEN v = 0 THEN 0 ELSE floor(log2(abs(v)) + 1e-12)::INT END)) AS x FROM f),
  n AS (SELECT track_id, list_transform(x, lambda p: CASE WHEN p.v = 0 THEN 0 ELSE (CASE WHEN p.v < 0 THEN 2147483648 ELSE 0 END) + (p.e + 127) * 8388608 + round((abs(p.v) / pow(2, p.e) - 1) * 8388608)::BIGINT END) AS x FROM e)"""


@query(f"WITH {_F32} SELECT track_id, base64(unhex(array_to_string(list_transform(x, lambda b: printf('%02X%02X%02X%02X', (b & 255)::INT, ((b >> 8) & 255)::INT, ((b >> 16) & 255)::INT, ((b >> 24) & 255)::INT)), ''))) AS code FROM n")
def vector_export(spark, d):
    """Vectors as base64 of little-endian float32."""
    rows = _tracks(spark, d).filter("octet_length(embedding) > 0 AND scale > 0 AND scale < 1e30").select("track_id", "embedding", "scale")
    return C.export_f32(rows, "track_id", "embedding", "scale")


@query("SELECT a.track_id, CASE WHEN t.track_id IS NULL THEN 'new' ELSE 'known' END AS state FROM (SELECT DISTINCT track_id FROM arrivals) a LEFT JOIN tracks t USING (track_id)")
def arrivals_known(spark, d):
    new = table(spark, d, "arrivals").select("track_id").distinct()
    return new.join(_tracks(spark, d).select("track_id", F.lit("known").alias("state")), "track_id", "left").select("track_id", F.coalesce("state", F.lit("new")).alias("state"))


@query("""SELECT track_id FROM (SELECT a.track_id, row_number() OVER (PARTITION BY coalesce('k:' || a.dedupe_key, 'i:' || a.track_id) ORDER BY a.arrival_id) AS n FROM arrivals a
  WHERE NOT EXISTS (SELECT 1 FROM tracks t WHERE t.track_id = a.track_id AND t.analyzed_at IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.job_id = 'embed:' || a.track_id AND j.state = 'failed')
  AND (a.dedupe_key IS NULL OR NOT EXISTS (SELECT 1 FROM tracks t WHERE t.dedupe_key = a.dedupe_key AND t.duplicate_of IS NULL))) WHERE n = 1""")
def admission(spark, d):
    """Arrivals whose id is not analysed, whose analysis has not failed and whose key no live row has: three anti joins, in this order. Of those left
    the first of each key; what was filtered before claims no key."""
    a, t = table(spark, d, "arrivals").select("arrival_id", "track_id", "dedupe_key"), _tracks(spark, d)
    failed = table(spark, d, "jobs").filter("state = 'failed'").filter(F.startswith("job_id", F.lit("embed:"))).select(F.expr("substring(job_id, 7)").alias("track_id"))
    out = a.join(t.filter("analyzed_at IS NOT NULL").select("track_id"), "track_id", "left_anti").join(failed, "track_id", "left_anti")
    out = out.join(t.filter("duplicate_of IS NULL AND dedupe_key IS NOT NULL").select("dedupe_key"), "dedupe_key", "left_anti")
    claimed = F.coalesce(F.concat(F.lit("k:"), "dedupe_key"), F.concat(F.lit("i:"), "track_id"))
    return out.groupBy(claimed.alias("claimed")).agg(F.min_by("track_id", "arrival_id").alias("track_id")).select("track_id")


@query("""SELECT track_id FROM tracks EXCEPT SELECT track_id FROM arrivals""")
def ids_except(spark, d):
    return _tracks(spark, d).select("track_id").distinct().join(table(spark, d, "arrivals").select("track_id"), "track_id", "left_anti")


@query("SELECT track_id FROM tracks UNION SELECT track_id FROM arrivals UNION SELECT track_id FROM jobs WHERE track_id IS NOT NULL")
def ids_union(spark, d):
    return _tracks(spark, d).select("track_id").unionByName(table(spark, d, "arrivals").select("track_id")).unionByName(table(spark, d, "jobs").filter("track_id IS NOT NULL").select("track_id")).distinct()


@query("SELECT source, batch_no, count(*) AS n, count(DISTINCT artist) AS artists FROM arrivals GROUP BY ROLLUP (source, batch_no)")
def arrivals_rollup(spark, d):
    return table(spark, d, "arrivals").rollup("source", "batch_no").agg(F.count("*").alias("n"), F.count_distinct("artist").alias("artists"))


_FOLD = "trim(regexp_replace(regexp_replace(strip_accents(lower({0})), '[^\\x00-\\x7F]+', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_WORDS = "feat|feats|featuring|ft|with|remaster|remastered|remastering|live|mono|stereo|take|takes|version|versions|edit|edited|mix|mixes|demo|bonus|from|deluxe|anniversary"
_ARTIST = _FOLD.format("string_split_regex(coalesce(artist, ''), '(?i) feat| featuring| ft\\.| ft | & |, | with ')[1]")


@query(f"SELECT DISTINCT artist, {_ARTIST} AS lead FROM tracks WHERE artist IS NOT NULL")
def lead_artists(spark, d):
    return _tracks(spark, d).filter("artist IS NOT NULL").select("artist", normal_artist_column(F.col("artist")).alias("lead")).distinct()


_EDITION = f"(regexp_matches({{0}}, '\\b(19|20)[0-9]{{{{2}}}}\\b') OR list_has_any(string_split({_FOLD}, ' '), string_split('{_WORDS}', '|')))"
_NOGROUP = f"regexp_replace(lower(coalesce(title, '')), '\\([^()\\[\\]]*\\b({_WORDS}|(?:19|20)[0-9][0-9])\\b[^()\\[\\]]*\\)|\\[[^()\\[\\]]*\\b({_WORDS}|(?:19|20)[0-9][0-9])\\b[^()\\[\\]]*\\]', '', 'g')"


@query(f"""WITH t AS (SELECT DISTINCT title FROM tracks WHERE title IS NOT NULL), p AS (SELECT title, string_split({_NOGROUP}, ' - ') AS parts FROM t),
  k AS (SELECT title, parts, coalesce(list_max(list_filter(range(1, len(parts) + 1), lambda i: NOT {_EDITION.format('parts[i]')})), 1) AS keep FROM p)
  SELECT title, {_FOLD.format("array_to_string(parts[1:greatest(keep, 1)], ' - ')")} AS piece FROM k""")
def normal_titles(spark, d):
    return _tracks(spark, d).filter("title IS NOT NULL").select("title").distinct().select("title", normal_title_column(F.col("title")).alias("piece"))


@query(f"SELECT DISTINCT album, {_EDITION.format('album')} AS edition FROM tracks WHERE album IS NOT NULL")
def edition_albums(spark, d):
    return _tracks(spark, d).filter("album IS NOT NULL").select("album").distinct().select("album", names_edition_column(F.col("album")).alias("edition"))


@query(f"SELECT doc_id, {_FOLD.format('source')} AS folded FROM documents WHERE source IS NOT NULL")
def folded_sources(spark, d):
    return table(spark, d, "documents").filter("source IS NOT NULL").select("doc_id", fold_column(F.col("source")).alias("folded"))


def _keys(spark, d):
    return _tracks(spark, d).select("track_id", "analyzed_at", dedupe_key_column(F.col("title"), F.col("artist")).alias("key"))


@query(f"""WITH p AS (SELECT track_id, {_ARTIST} AS lead, string_split({_NOGROUP}, ' - ') AS parts FROM tracks),
  k AS (SELECT track_id, lead, parts, coalesce(list_max(list_filter(range(1, len(parts) + 1), lambda i: NOT {_EDITION.format('parts[i]')})), 1) AS keep FROM p)
  SELECT track_id, lead || '|' || {_FOLD.format("array_to_string(parts[1:greatest(keep, 1)], ' - ')")} AS key FROM k""")
def dedupe_keys(spark, d):
    return _keys(spark, d).select("track_id", "key")


@query("""SELECT dedupe_key, count(*) AS tracks FROM tracks WHERE dedupe_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY tracks DESC, dedupe_key LIMIT 20""")
def largest_groups(spark, d):
    return _tracks(spark, d).filter("dedupe_key IS NOT NULL").groupBy("dedupe_key").agg(F.count("*").alias("tracks")).filter("tracks > 1").orderBy(F.desc("tracks"), "dedupe_key").limit(20)


@query("""SELECT track_id, first_value(track_id) OVER w AS primary_id FROM tracks WHERE dedupe_key IS NOT NULL WINDOW w AS (PARTITION BY dedupe_key ORDER BY coalesce(analyzed_at, TIMESTAMP '1970-01-01'), track_id)
  QUALIFY primary_id <> track_id""")
def key_marks(spark, d):
    """The key pass: the earliest row of a key is primary, the others are marked. The primary is aggregated before its shuffle, then joined back."""
    rows = _tracks(spark, d).filter("dedupe_key IS NOT NULL").select("track_id", "dedupe_key", F.coalesce("analyzed_at", F.lit("1970-01-01").cast("timestamp_ntz")).alias("at"))
    first = rows.groupBy("dedupe_key").agg(F.min(F.struct("at", "track_id"))["track_id"].alias("primary_id"))
    return rows.join(first, "dedupe_key").filter("primary_id <> track_id").select("track_id", "primary_id")


@query("""SELECT round(100.0 * count(duplicate_of) / count(*), 4) AS percent, count(DISTINCT artist) AS artists FROM tracks""")
def duplicate_share(spark, d):
    return _tracks(spark, d).agg(F.round(100.0 * F.count("duplicate_of") / F.count("*"), 4).alias("percent"), F.count_distinct("artist").alias("artists"))


@query("SELECT kind, state, substr(error, 1, 20) AS error, count(*) AS jobs FROM jobs GROUP BY ALL")
def job_errors(spark, d):
    return table(spark, d, "jobs").groupBy("kind", "state", F.substring("error", 1, 20).alias("error")).agg(F.count("*").alias("jobs"))


@query("SELECT regexp_replace(coalesce(attribution.url, ''), '//[^/@]+', '//***') AS url, count(*) AS n FROM tracks GROUP BY 1")
def redacted_urls(spark, d):
    return _tracks(spark, d).groupBy(F.regexp_replace(F.coalesce("attribution.url", F.lit("")), "//[^/@]+", "//***").alias("url")).agg(F.count("*").alias("n"))


@query("""SELECT track_id, CASE WHEN n <= 5 THEN round(0.95 - 0.05 * (n - 1), 4)::DOUBLE END AS score FROM (SELECT track_id, row_number() OVER (ORDER BY track_id) AS n FROM tracks) WHERE n <= 5""")
def placeholder_scores(spark, d):
    top = _tracks(spark, d).select("track_id").orderBy("track_id").limit(5)
    return top.withColumn("n", F.row_number().over(Window.orderBy("track_id"))).select("track_id", F.round(0.95 - 0.05 * (F.col("n") - 1), 4).alias("score"))
