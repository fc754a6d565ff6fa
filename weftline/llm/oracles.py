"""SQL for DuckDB of the queries that can be said in it on small tables."""

from __future__ import annotations

_WORDS = r"'[^\x20\x09-\x0D]+'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE32 = _UPPER + "234567"
_NIBBLES = ", ".join(f"'{k:04b}'" for k in range(16))
_FIVE = " + ".join(f"{1 << (4 - k)} * CAST(substr(b, 5 * i + {k + 1}, 1) AS INT)" for k in range(5))

OP1 = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS best, count(*) OVER (PARTITION BY x) AS copies,
    array_to_string(list_transform(range(1, 41), lambda i: ([{_NIBBLES}])[strpos('0123456789abcdef', substr(x, i, 1))]), '') AS b FROM p),
r AS (SELECT *, copies > 1 AND page_id IS DISTINCT FROM best AS again FROM q)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE32}', 1 + {_FIVE}, 1)), '') AS payload_digest,
    CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN best END AS refers_to, url,
    CAST(CASE WHEN again THEN 0 ELSE greatest(1, ceil(strlen(h) / 1048576.0)) END AS INT) AS n_chunks, true AS intact
FROM r"""

OP8 = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORDS}) AS w FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w),
e AS (SELECT rid, len(s) AS n, md5(unnest(s)) AS g FROM s),
i AS (SELECT a.rid AS a, b.rid AS b, count(*) AS same, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.g = b.g AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT a, b FROM i WHERE 100 * same >= 85 * (na + nb - same) UNION ALL SELECT b, a FROM i WHERE 100 * same >= 85 * (na + nb - same)),
c AS (SELECT rid, rid AS other FROM s UNION SELECT c.rid, l.b FROM c JOIN l ON c.other = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id
FROM s JOIN (SELECT c.rid, min(o.doc_id) AS component_id FROM c JOIN s o ON o.rid = c.other GROUP BY 1) m ON m.rid = s.rid"""

OP10 = f"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
x AS (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w),
g AS (SELECT rid, doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS g FROM x),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY 1),
t AS (SELECT rid, i FROM g JOIN f USING (g) WHERE f.first < g.doc_id),
p AS (SELECT rid, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w),
c AS (SELECT p.rid, p.i, p.word, max(CASE WHEN t.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.rid ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM p LEFT JOIN t ON t.rid = p.rid AND t.i = p.i),
k AS (SELECT rid, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.rid = w.rid"""

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_PATTERNS = (_ASSIGN, "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}", "[A-Za-z0-9_-]{24,}")
_FOUND = " UNION ALL ".join(f"SELECT rid, source, {k} AS kind, regexp_extract_all(t, '{p}') AS hits, regexp_split_to_array(t, '{p}') AS gaps FROM d" for k, p in enumerate(_PATTERNS))
_NAMES = "(['assign', 'access', 'hex', 'owned'])[kind + 1] || ':' || a || ':' || b"

OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
f AS ({_FOUND}),
h AS (SELECT rid, source, kind, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM f),
s AS (SELECT rid, source, kind, CAST(coalesce(list_sum(list_transform(list_slice(gaps, 1, i), lambda x: len(x))), 0) + coalesce(list_sum(list_transform(list_slice(hits, 1, i - 1), lambda x: len(x))), 0) AS BIGINT) AS a, hits[i] AS hit FROM h),
v AS (SELECT rid, source, kind, a, a + len(hit) AS b, CASE WHEN kind = 0 THEN regexp_extract(hit, '{_ASSIGN}', 2) ELSE hit END AS v FROM s),
k AS (SELECT * FROM v WHERE CASE kind WHEN 0 THEN len(v) >= 6 WHEN 3 THEN regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]') ELSE true END),
o AS (SELECT * FROM k WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM k x WHERE x.rid = k.rid AND x.kind < 3 AND x.a < k.b AND x.b > k.a)),
n AS (SELECT v, count(DISTINCT coalesce(source, chr(1))) AS owners FROM o GROUP BY 1),
j AS (SELECT o.*, owners, owners <= 2 AND (kind < 2 OR (len(list_distinct(string_split(o.v, ''))) >= 8 AND regexp_matches(o.v, '[0-9]') AND regexp_matches(o.v, '[A-Za-z]'))) AS live FROM o JOIN n ON n.v = o.v),
g AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg({_NAMES}, ',' ORDER BY a, kind) FILTER (kind < 3) AS base, string_agg({_NAMES}, ',' ORDER BY a, kind) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (owners > 2) AS n_example FROM j WHERE kind < 3 OR live GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g USING (rid)"""

ORACLE_SQL = {"op1_warc_chunks": OP1, "op8_jaccard_join": OP8, "op9_secrets": OP9, "op10_repeats": OP10}
