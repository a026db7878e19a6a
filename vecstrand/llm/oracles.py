"""SQL of the training-data queries, where SQL can state them."""

from __future__ import annotations

_LINKED = """
both_ways AS (SELECT u, v FROM links UNION SELECT v AS u, u AS v FROM links),
reached(a, b) AS (SELECT u, v FROM both_ways UNION SELECT r.a, e.v FROM reached r JOIN both_ways e ON r.b = e.u),
groups AS (SELECT a AS track_id, least(a, min(b)) AS group_id FROM reached GROUP BY a)
"""

_MARKS = """SELECT t.track_id AS u, t.duplicate_of AS v FROM tracks t JOIN tracks o ON o.track_id = t.duplicate_of WHERE t.track_id <> t.duplicate_of"""

_ALBUMS = "('', '-', '--', 'n/a', 'na', 'none', 'null', 'unknown', 'unknown album', '[no album]', 'no album', '[unknown]', 'untitled album', '?')"

_P1 = f"""
WITH RECURSIVE links AS ({_MARKS}), {_LINKED},
members AS (SELECT g.group_id, t.* FROM tracks t JOIN groups g USING (track_id)),
filled AS (
  SELECT group_id, track_id, features_version, analyzed_at, unnest(['album', 'artwork_url', 'attribution', 'embedding', 'feel', 'rhythm']) AS field,
    unnest([
      album IS NOT NULL AND lower(trim(album)) NOT IN {_ALBUMS},
      artwork_url IS NOT NULL AND trim(artwork_url) <> '' AND artwork_url NOT LIKE '%/cover//%',
      attribution IS NOT NULL AND (attribution.source IS NOT NULL OR attribution.url IS NOT NULL OR attribution.license IS NOT NULL),
      embedding IS NOT NULL AND regexp_matches(hex(embedding), '[^0]'),
      feel IS NOT NULL AND len(list_filter(feel, lambda x: x IS NOT NULL AND x <> 0)) > 0,
      rhythm IS NOT NULL AND (rhythm.tempo_bpm IS NOT NULL OR rhythm.beat_strength IS NOT NULL OR rhythm.loudness_lufs IS NOT NULL OR rhythm.loudness_range IS NOT NULL
        OR rhythm.key IS NOT NULL OR rhythm.mode IS NOT NULL OR rhythm.key_strength IS NOT NULL)
    ]) AS has
  FROM members),
ranked AS (SELECT group_id, field, track_id, row_number() OVER (PARTITION BY group_id, field ORDER BY features_version DESC NULLS LAST, analyzed_at DESC NULLS LAST, track_id) AS n FROM filled WHERE has)
"""

_P1_CONSISTENT = """, tied AS (SELECT * FROM filled WHERE has AND field IN ('embedding', 'feel', 'rhythm')),
firsts AS (SELECT * FROM tied QUALIFY row_number() OVER (PARTITION BY group_id, field, features_version ORDER BY analyzed_at DESC NULLS LAST, track_id) = 1),
placed AS (SELECT group_id, field, track_id, features_version AS v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY group_id, field) AS n FROM firsts
  WINDOW w AS (PARTITION BY group_id, field ORDER BY features_version DESC NULLS LAST, analyzed_at DESC NULLS LAST, track_id)),
choices AS (SELECT DISTINCT group_id, v FROM placed), fields AS (SELECT DISTINCT group_id, field, n FROM placed),
costs AS (SELECT c.group_id, c.v, f.field, coalesce(p.i, f.n) AS cost, p.track_id FROM choices c JOIN fields f USING (group_id) LEFT JOIN placed p ON p.group_id = c.group_id AND p.field = f.field AND p.v IS NOT DISTINCT FROM c.v),
sums AS (SELECT group_id, v, sum(cost) AS total, list(cost ORDER BY field) AS each FROM costs GROUP BY group_id, v),
won AS (SELECT group_id, v FROM sums QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY total, each) = 1)
SELECT group_id, field, track_id FROM ranked WHERE n = 1 AND field NOT IN ('embedding', 'feel', 'rhythm')
UNION ALL SELECT c.group_id, c.field, c.track_id FROM costs c JOIN won w ON w.group_id = c.group_id AND w.v IS NOT DISTINCT FROM c.v WHERE c.track_id IS NOT NULL
"""

_P2 = f"""
WITH RECURSIVE keyed AS (SELECT track_id, dedupe_key FROM tracks WHERE trim(split_part(dedupe_key, '|', 1)) <> '' AND strpos(dedupe_key, '|') > 0 AND trim(substr(dedupe_key, strpos(dedupe_key, '|') + 1)) <> ''),
links AS (
  {_MARKS}
  UNION SELECT k.track_id, m.v FROM keyed k JOIN (SELECT dedupe_key, min(track_id) AS v FROM keyed GROUP BY dedupe_key) m USING (dedupe_key) WHERE k.track_id <> m.v
  UNION SELECT p.left_id, p.right_id FROM match_pairs p JOIN tracks a ON a.track_id = p.left_id JOIN tracks b ON b.track_id = p.right_id WHERE p.verdict = 'same' AND p.left_id <> p.right_id),
{_LINKED}
"""

_P5 = """
WITH h AS (SELECT track_id, hex(embedding) AS h FROM tracks WHERE analyzed_at IS NOT NULL AND duplicate_of IS NULL AND features_version = 4 AND octet_length(embedding) = 64 AND scale > 0
  AND NOT isnan(scale) AND regexp_matches(hex(embedding), '[^0]')),
v AS (SELECT track_id, list_transform(range(64), lambda i: (CASE WHEN ('0x' || h[2*i+1:2*i+2])::INT > 127 THEN ('0x' || h[2*i+1:2*i+2])::INT - 256 ELSE ('0x' || h[2*i+1:2*i+2])::INT END)::DOUBLE) AS vec FROM h)
SELECT a.track_id, b.track_id AS neighbour_id FROM v a JOIN v b ON a.track_id <> b.track_id
QUALIFY row_number() OVER (PARTITION BY a.track_id ORDER BY round(list_cosine_similarity(a.vec, b.vec), 12) DESC, b.track_id) <= 5
"""

ORACLE_SQL = {
    "p1_found": _P1 + "SELECT group_id, field, track_id FROM ranked WHERE n = 1",
    "p1_consistent": _P1 + _P1_CONSISTENT,
    "p2_found": _P2 + "SELECT track_id, group_id FROM groups",
    "p2_sizes": _P2 + "SELECT members, count(*) AS groups FROM (SELECT group_id, count(*) AS members FROM groups GROUP BY group_id) GROUP BY members",
    "p5_found": _P5,
    "p6_round_trip": "SELECT doc_id, true AS same FROM documents",
}
