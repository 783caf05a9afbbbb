"""DuckDB SQL that gives the rows of the queries, written from the contracts and not from the Spark code."""

from __future__ import annotations

from kbspark.llm.quality_rules import STOP_WORDS

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP3 = f"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS host, i, line, trim(line, {_SPACE}) AS bare
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10))))) AS i
        FROM documents WHERE text IS NOT NULL)),
totals AS (SELECT coalesce(source, '') AS host, count(*) AS pages FROM documents GROUP BY 1),
flagged AS (
  SELECT host, bare FROM (SELECT host, bare, count(DISTINCT doc_id) AS n FROM lines WHERE bare <> '' GROUP BY 1, 2)
  JOIN totals USING (host) WHERE n >= 5 AND n > 0.1 * pages),
marked AS (SELECT l.*, f.bare IS NOT NULL AS cut FROM lines l LEFT JOIN flagged f ON l.host = f.host AND l.bare = f.bare),
done AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT cut), '') AS text,
                count(*) FILTER (bare <> '') AS n_lines, count(*) FILTER (cut) AS n_removed FROM marked GROUP BY 1)
SELECT d.doc_id, d.source, t.text, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN done t USING (doc_id)
"""

OP7 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
windows AS (SELECT doc_id, words[i:i+4] AS win, i FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (SELECT doc_id, win FROM windows GROUP BY 1, 2 HAVING count(*) >= 2),
spots AS (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS at FROM windows JOIN twice USING (doc_id, win)),
rep AS (SELECT doc_id, count(*) AS n FROM spots GROUP BY 1),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
c AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
             coalesce(n_dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
             len(list_filter(words, lambda x: lower(x) IN ({', '.join(f"'{s}'" for s in STOP_WORDS)}))) AS n_stop,
             len(list_filter(words, lambda x: suffix(x, '!!'))) AS n_shout
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 1.5 AND 25 AND n_symbols / n_words <= 0.25 AND n_shout / n_words <= 0.5
  AND (n_words < 60 OR n_stop / n_words >= 0.01) AND n_dup_lines / n_lines <= 0.6 AND n_repeat_words / n_words <= 0.2 AS kept
FROM b
"""

_TOK = """list_distinct(
    list_transform(list_filter([regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)], lambda x: x <> ''), lambda x: 's:' || x)
    || list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x)
    || list_transform(list_filter(string_split(regexp_replace(path, '[0-9]+', '0', 'g'), '/'), lambda x: x <> ''), lambda x: 'p:' || x)
    || list_transform(list_filter(list_transform(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: string_split(x, '=')[1]), lambda x: x <> ''), lambda x: 'q:' || x)
    || CASE WHEN contains(url, '#') THEN ['f:'] ELSE [] END)"""

OP8 = f"""
WITH h AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
fixed(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS says
         FROM h JOIN fixed ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1),
toks AS (SELECT page_id, url, {_TOK} AS toks FROM h WHERE url IS NOT NULL),
marks AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
train AS (SELECT t.page_id, toks, bad FROM toks t JOIN h USING (page_id) JOIN marks m ON try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]{{1,18}})', 1), '') AS BIGINT) = m.doc_id),
e AS (SELECT page_id, bad, unnest(toks) AS t FROM train),
sets AS (SELECT page_id, bad, [t] AS s FROM e
  UNION ALL SELECT a.page_id, a.bad, [a.t, b.t] FROM e a JOIN e b ON a.page_id = b.page_id AND a.t < b.t
  UNION ALL SELECT a.page_id, a.bad, [a.t, b.t, c.t] FROM e a JOIN e b ON a.page_id = b.page_id AND a.t < b.t JOIN e c ON b.page_id = c.page_id AND b.t < c.t),
n AS (SELECT count(*) AS n FROM train),
mined AS (SELECT s FROM (SELECT s, count(*) AS c, sum(bad) AS b FROM sets GROUP BY 1), n WHERE b >= ceil(greatest(0.002, 5.0 / n) * n) AND b >= 0.5 * c),
hit AS (SELECT DISTINCT url FROM toks, mined WHERE list_has_all(toks, s))
SELECT page_id, host, path, rule, hit.url IS NOT NULL AS mined, coalesce(says, CASE WHEN hit.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN best USING (page_id) LEFT JOIN hit ON h.url = hit.url
"""

OP10 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest, max(page_id) OVER (PARTITION BY body) AS best FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN best END AS refers_to
FROM q
"""

#: CRC-32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda acc, x: list_reduce([xor(acc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"""

OP11 = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
turns AS (
  SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.base WHERE pos <= h
  UNION ALL SELECT conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos > h),
numbered AS (
  SELECT conv_id, row_number() OVER w AS depth, list(role || chr(0) || text) OVER w AS path, length(text) AS chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)),
prefixes AS (
  SELECT conv_id, depth, path, chars FROM numbered
  UNION ALL SELECT conv_id, 0, [], 0 FROM c),
members AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM prefixes),
nodes AS (
  SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY path),
children AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
own AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * chars AS saved
  FROM nodes n LEFT JOIN children USING (path)),
above AS (SELECT path[1:k] AS path, saved, n_children FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM own)),
sums AS (SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY 1)
SELECT o.conv_id, CAST(o.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, o.ends_sha256
FROM own o JOIN sums s USING (path) LEFT JOIN nodes p ON o.depth > 0 AND p.path = o.path[1:o.depth - 1]
"""

ORACLES = {"op10_warc": OP10, "op11_prefix_trie": OP11, "op3_line_dedup": OP3, "op7_quality_rules": OP7, "op8_url_filter": OP8}
