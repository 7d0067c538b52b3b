"""DuckDB SQL for the queries of this subpackage that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op4_exact_dedup"] = """
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents) d
JOIN (SELECT sha256(coalesce(text, '')) AS h, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1) g ON d.h = g.h
"""

ORACLES["op6_warc_normaliser"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT h, max(page_id) AS top FROM p GROUP BY h),
b AS (SELECT p.page_id, p.n, g.top, unhex(sha1(p.h)) AS d FROM p JOIN g ON p.h = g.h)
SELECT page_id, n AS payload_bytes, list_aggregate(l, 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM (SELECT page_id, n, top, list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + 16 * CAST(substr(s, CAST(i * 5 + 1 AS BIGINT), 1) AS INTEGER) + 8 * CAST(substr(s, CAST(i * 5 + 2 AS BIGINT), 1) AS INTEGER)
      + 4 * CAST(substr(s, CAST(i * 5 + 3 AS BIGINT), 1) AS INTEGER) + 2 * CAST(substr(s, CAST(i * 5 + 4 AS BIGINT), 1) AS INTEGER)
      + CAST(substr(s, CAST(i * 5 + 5 AS BIGINT), 1) AS INTEGER) AS BIGINT), 1)) AS l
  FROM (SELECT page_id, n, top, CAST(CAST(d AS BIT) AS VARCHAR) AS s FROM b) y) z
"""

ORACLES["op7_url_filter"] = r"""
WITH RECURSIVE p AS (
  SELECT page_id, html, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, html, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM p),
rules(verdict, h, pa) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
plain AS (SELECT host, path, host || tail AS a, regexp_replace(regexp_replace(html, '(?is)<!--.*?(-->|\z)|<script\b.*?(</script\b|\z)', ' ', 'g'), '\r', ' ', 'g') AS html FROM q),
tags AS (SELECT host, path, a, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM plain WHERE a <> ''),
links AS (SELECT host, path, a, string_split(replace(CASE
    WHEN regexp_matches(tag, '(?i)\brel\s*=\s*(?:canonical\b|"(?:[^">]*\s)?canonical[\s"]|''(?:[^''>]*\s)?canonical[\s''])') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?i)http-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>;]+)', 1) END, '&amp;', '&'), '#')[1] AS t FROM tags),
parsed AS (SELECT host, path, a, regexp_extract(t, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?]*))?([^?]*)(.*)$', ['scheme', 'host', 'path', 'query']) AS u,
  regexp_matches(t, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//') AS far FROM links WHERE t <> ''),
merged AS (SELECT a, CASE WHEN far THEN translate(u.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE host END AS h, u.query AS query,
    CASE WHEN far OR starts_with(u.path, '/') THEN u.path WHEN u.path = '' THEN path WHEN path = '' THEN '/' || u.path ELSE regexp_extract(path, '^.*/') || u.path END AS p,
    NOT far AND u.path = '' AS own, far OR u.path <> '' OR u.query <> '' AS named FROM parsed WHERE far OR u.scheme = ''),
steps AS (SELECT a, h, query, p, own, string_split(p, '/') AS l FROM merged WHERE named),
e AS (SELECT a, h || CASE WHEN own OR len(list_intersect(l, ['.', '..'])) = 0 THEN p ELSE
    list_reduce(list_prepend('', l[2:]), lambda x, y: CASE WHEN y = '.' THEN x WHEN y = '..' THEN regexp_replace(x, '/[^/]*$', '') ELSE x || '/' || y END)
    || CASE WHEN l[-1] IN ('.', '..') THEN '/' ELSE '' END END || query AS b FROM steps),
both_ways AS (SELECT a, b FROM e WHERE a <> '' AND b <> '' UNION SELECT b, a FROM e WHERE a <> '' AND b <> ''),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
nodes AS (SELECT DISTINCT b AS node, regexp_extract(b, '^[^/?#]*') AS host, regexp_extract(b, '^[^/?#]*([^?#]*)', 1) AS path FROM both_ways),
own AS (SELECT node, (SELECT verdict FROM rules WHERE (n.host = h OR ends_with(n.host, '.' || h)) AND starts_with(n.path, pa) ORDER BY length(h || pa) DESC LIMIT 1) AS v FROM nodes n),
said AS (SELECT r.a AS node, bool_or(o.v = 'block') AS blocks, bool_or(o.v = 'allow') AS allows FROM reach r JOIN own o ON o.node = r.b GROUP BY 1),
judged AS (SELECT q.page_id, q.host, q.path, q.host || q.tail AS node,
  (SELECT {'rule': h || pa, 'verdict': verdict} FROM rules WHERE (q.host = h OR ends_with(q.host, '.' || h)) AND starts_with(q.path, pa) ORDER BY length(h || pa) DESC LIMIT 1) AS f FROM q)
SELECT j.page_id, j.host, j.path, j.f.rule AS rule,
  coalesce(j.f.verdict, CASE WHEN s.blocks AND NOT coalesce(s.allows, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN said s ON s.node = j.node
"""

ORACLES["op11_hard_negatives"] = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id AS id, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
