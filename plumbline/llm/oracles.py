"""DuckDB SQL with the same result, for the queries that SQL can express.

The others rest on trained models, automata, a tokenizer's library or sketches; ``tests/llm`` holds
them against brute-force versions.
"""

REVISITS = r"""
WITH raw AS (
  SELECT page_id, url, digest, later, '"' || left(digest, 16) || '"' AS tag, '"' || left(later, 16) || '"' AS changed, length,
    page_id % 8 AS part, page_id * 600 AS t, 'day ' || (page_id % 7)::VARCHAR AS day,
    CASE WHEN page_id % 8 % 3 = 0 THEN url || '#again'
      WHEN page_id % 8 % 3 = 1 THEN url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_medium=feed'
      ELSE regexp_replace(url, '^http://', 'HTTPS://') END AS spelled
  FROM (SELECT page_id, url, md5(coalesce(html, '')) AS digest, md5(coalesce(html, '') || '#2') AS later,
    coalesce(strlen(html), 0)::VARCHAR AS length FROM pages)),
captures AS (
  SELECT page_id * 16 AS record_id, 'response' AS kind, url, t AS at, tag AS etag, day AS dated, digest, length, part FROM raw
  UNION ALL SELECT page_id * 16 + 1, 'response', url, t + 172800, changed, day || ' later', later, length, part FROM raw WHERE part % 2 = 0
  UNION ALL SELECT page_id * 16 + 2, 'response', url, t + 172800, '"twin"', day || ' later', later, length, part FROM raw WHERE part = 2
  UNION ALL SELECT page_id * 16 + 3, 'revisit', spelled, t + 259207,
    CASE part WHEN 0 THEN changed WHEN 1 THEN 'W/' || tag WHEN 2 THEN '"twin"' WHEN 6 THEN tag END,
    CASE WHEN part = 3 THEN day END, CASE WHEN part = 4 THEN digest END, length, part FROM raw
  UNION ALL SELECT page_id * 16 + 4, 'revisit', spelled, t - 3600, tag, NULL, NULL, length, part FROM raw WHERE part = 5
  UNION ALL SELECT page_id * 16 + 5, 'revisit', spelled, t + 60, tag, NULL, NULL, length, part FROM raw WHERE part % 4 = 1
  UNION ALL SELECT page_id * 16 + 6, 'revisit', spelled, t, tag, NULL, NULL, length, part FROM raw WHERE part = 6
  UNION ALL SELECT page_id * 16 + 7, 'response', 'http://www.portal.example/', t + 5, tag, day, digest, length, part FROM raw
  UNION ALL SELECT page_id * 16 + 8, 'revisit', 'https://portal.example/#top', t + 905, CASE WHEN part % 4 = 0 THEN tag END, NULL, NULL, length, part FROM raw),
bare AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS u FROM captures),
cut AS (SELECT *,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)),
      '^.*@', ''), '^www[0-9]*[.]', ''), ':(80|443)$', '') AS host,
    regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') AS rest FROM bare),
parts AS (SELECT *, regexp_replace(rest, '[?].*$', '') AS path,
    [p FOR p IN string_split(regexp_extract(rest, '[?](.*)$', 1), '&') IF p <> '' AND
      NOT regexp_matches(lower(p), '^(utm_[a-z]+|gclid|fbclid|phpsessid|jsessionid|sessionid)(=|$)')] AS kept FROM cut),
canon AS (SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END ||
    CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(kept), '&') ELSE '' END AS canonical_url FROM parts),
matched AS (
  SELECT r.*, f.record_id AS f_id, f.etag AS f_etag, f.dated AS f_dated, f.digest AS f_digest, f.length AS f_length
  FROM (SELECT * FROM canon WHERE kind = 'revisit') r
  ASOF LEFT JOIN (SELECT * FROM canon WHERE kind = 'response'
    QUALIFY row_number() OVER (PARTITION BY canonical_url, canon."at" ORDER BY record_id DESC) = 1) f ON r.canonical_url = f.canonical_url AND r.at > f.at),
judged AS (SELECT *, CASE WHEN f_id IS NULL THEN 'missing'
    WHEN coalesce(regexp_replace(etag, '^W/', '') <> f_etag, false) OR coalesce(dated <> f_dated, false) OR coalesce(digest <> f_digest, false) THEN 'mismatch'
    WHEN etag IS NOT NULL OR dated IS NOT NULL OR digest IS NOT NULL THEN 'resolved' ELSE 'unverified' END AS resolution FROM matched)
SELECT record_id, kind, canonical_url, 'full' AS resolution, NULL::BIGINT AS from_record_id,
  'content-length=' || length || ';content-type=text/html;etag=' || etag || ';last-modified=' || dated || ';server=one' AS header_lines,
  digest AS payload_digest
FROM canon WHERE kind = 'response'
UNION ALL
SELECT record_id, kind, canonical_url, resolution,
  CASE WHEN resolution IN ('resolved', 'unverified') THEN f_id END,
  'cache-control=max-age=' || part::VARCHAR || CASE WHEN resolution IN ('resolved', 'unverified') THEN
      ';content-length=' || f_length || ';content-type=text/html;etag=' || coalesce(etag, f_etag) || ';last-modified=' || coalesce(dated, f_dated) || ';server=one'
    ELSE ';content-length=0' || coalesce(';etag=' || etag, '') || coalesce(';last-modified=' || dated, '') END,
  CASE WHEN resolution IN ('resolved', 'unverified') THEN f_digest ELSE digest END
FROM judged
"""

FILTER_AUDIT = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT t.part,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM texts t LEFT JOIN marks m ON t.doc_id = m.doc_id),
masks AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM judged GROUP BY part, mask),
letters(c, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT p.c || q.c || r.c || s.c || t.c AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
  FROM letters p, letters q, letters r, letters s, letters t WHERE p.b + q.b + r.b + s.b + t.b = 31
    AND p.b | q.b | r.b | s.b | t.b = 31),
steps AS (
  SELECT filter_order, step::INTEGER AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS earlier
  FROM orders, unnest([1, 2, 3, 4, 5]) AS u(step)),
counted AS (
  SELECT part, filter_order, step, any_value(bit) AS bit,
    coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""

ORACLES = {"op10_revisits": REVISITS, "op13_filter_audit": FILTER_AUDIT}
