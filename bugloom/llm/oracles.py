"""DuckDB SQL for the queries that SQL can express, on the same tables."""

OP2_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages
), d AS (
  SELECT *, list_aggregate(list_transform(range(0, 40, 5), lambda i:
      list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr(
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST((CAST('0x' || substr(digest, i + 1, 5) AS INTEGER) >> s) & 31 AS INTEGER) + 1, 1)),
      'string_agg', '')), 'string_agg', '') AS base32,
    max(page_id) OVER (PARTITION BY digest) AS origin
  FROM p
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  base32 AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM origin THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM origin THEN origin END AS refers_to
FROM d
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight
  FROM d GROUP BY source
), k AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source) AS place,
    sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS caps,
    sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights,
    sum(source_size) OVER () AS total
  FROM s
), v AS (
  SELECT *, CAST(total - coalesce(caps, 0) AS DOUBLE) / CAST(weights AS DOUBLE) AS level FROM k
), f AS (
  SELECT level FROM v WHERE weight * level < 3 * source_size ORDER BY place LIMIT 1
), t AS (
  SELECT source, source_size,
    least(weight * coalesce((SELECT level FROM f), 1e300), CAST(3 * source_size AS DOUBLE)) AS target
  FROM s
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END
    AS whole FROM t
), o AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.whole,
    r.target - CAST(r.whole * r.source_size AS DOUBLE) AS need,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS FIRST, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN 2 * upto - size <= 2 * need THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o
"""

OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d
), x AS (
  SELECT rid, unnest(ws) AS a, unnest(range(1, len(ws) + 1)) AS k FROM w
), t AS (
  SELECT rid, k, a, lead(a, 1) OVER g AS b, lead(a, 2) OVER g AS c FROM x
  WINDOW g AS (PARTITION BY rid ORDER BY k)
), u AS (
  SELECT rid, k, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM t WHERE c IS NOT NULL
), r AS (
  SELECT rid, count(DISTINCT k + o) AS n_repeat_words
  FROM u, (VALUES (0), (1), (2)) AS v(o) WHERE n > 1 GROUP BY rid
), l AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS line,
    unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d
), m AS (
  SELECT rid, line, row_number() OVER (PARTITION BY rid, line ORDER BY i) > 1 AS dup,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
    length(regexp_replace(line, '[^\p{L}\p{N}]+', '', 'g')) AS letters,
    len(regexp_extract_all(line, '[#*$%&|<>!]')) AS marks,
    len(regexp_extract_all(line, '[|»›·•]')) + 1 AS items
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), j AS (
  SELECT rid, dup, chars,
    (marks >= 3 AND 2 * marks > n) OR 2 * letters < chars OR (items >= 4 AND n <= 3 * items)
    OR (n <= 20 AND regexp_matches(lower(line), 'all rights reserved|licensed under|released under the|terms of service|terms of use|privacy policy|cookie policy|we use cookies|accept cookies|subscribe to our newsletter|sign up for our|click here|share this|skip to content|javascript is disabled|enable javascript|log in to comment|back to top|powered by'))
    AS failed
  FROM m
), e AS (
  SELECT rid, count(*) FILTER (dup) AS n_dup_lines,
    coalesce(sum(chars) FILTER (failed), 0) AS lost_chars
  FROM j GROUP BY rid
), b AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars
  FROM w LEFT JOIN r USING (rid) LEFT JOIN e USING (rid)
)
SELECT *, n_words < 50 OR 2 * n_repeat_words > n_words AS base_failed,
  NOT (n_words < 50 OR 2 * n_repeat_words > n_words) AND 100 * lost_chars <= 30 * word_chars AS kept
FROM b
"""

OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), x AS (
  SELECT rid, len(ws) AS n, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS k FROM d
), g AS (
  SELECT rid, n, k, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' '
    || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS s
  FROM x WINDOW o AS (PARTITION BY rid ORDER BY k)
), s AS (
  SELECT DISTINCT rid, s FROM g WHERE s IS NOT NULL
  UNION ALL
  SELECT rid, 'short ' || array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4
), z AS (
  SELECT rid, count(*) AS n, string_agg(s, chr(10) ORDER BY s) AS whole FROM s GROUP BY rid
), c AS (
  SELECT rid, n, min(rid) OVER (PARTITION BY whole) AS rep FROM z
), r AS (
  SELECT s.rid, s.s, c.n FROM s JOIN c ON s.rid = c.rid AND c.rep = c.rid
), p AS (
  SELECT a.rid AS a, b.rid AS b FROM r AS a JOIN r AS b
    ON a.s = b.s AND a.rid < b.rid AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.rid, b.rid, a.n, b.n HAVING 180 * count(*) >= 80 * (a.n + b.n)
), e AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), t(node, reach) AS (
  SELECT rid, rid FROM c WHERE rep = rid
  UNION
  SELECT e.b, t.reach FROM t JOIN e ON t.node = e.a
), l AS (
  SELECT node, min(reach) AS label FROM t GROUP BY node
), m AS (
  SELECT c.rid, c.n, l.label FROM c JOIN l ON c.rep = l.node
), o AS (
  SELECT m.label, min(d.doc_id) AS low FROM m JOIN d USING (rid) GROUP BY m.label
)
SELECT d.doc_id, CAST(coalesce(m.n, 0) AS BIGINT) AS n_shingles,
  CASE WHEN m.rid IS NULL THEN d.doc_id ELSE o.low END AS component_id
FROM d LEFT JOIN m USING (rid) LEFT JOIN o ON m.label = o.label
"""

OP11_SQL = r"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other,
    CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r AS a JOIN r AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id
    ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
  s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
