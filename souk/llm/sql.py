"""The same results in SQL, for tables where every document id occurs once."""

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = rf"regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP4 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
 g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t FROM d, unnest(range(1, len(w) - 11)) AS r(i)),
 f AS (SELECT t, min(doc_id) AS first FROM g GROUP BY t),
 gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM g JOIN f USING (t), unnest(range(0, 13)) AS r(j) WHERE doc_id > first),
 x AS (SELECT doc_id, i AS pos, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS r(i)),
 k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM x ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP7 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {ALNUM} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS t FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (t) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT x, y FROM p JOIN n AS m ON m.doc_id = x JOIN n AS o ON o.doc_id = y WHERE 9 * c >= 4 * (m.n + o.n)),
 reach AS (SELECT x, y FROM l UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x)
SELECT doc_id, least(doc_id, coalesce((SELECT min(y) FROM reach WHERE x = doc_id), doc_id)) AS class_id,
 (SELECT count(*) FROM l WHERE x = doc_id) AS n_links FROM d
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, {ALNUM} AS w FROM documents),
 b AS (SELECT item_id, {ALNUM} AS w FROM benchmark),
 g AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS t
  FROM b, unnest(range(1, greatest(len(w) - 8, 2))) AS r(i) WHERE len(w) > 0),
 z AS (SELECT DISTINCT k FROM g),
 h AS (SELECT doc_id, i, z.k, array_to_string(w[i:i + z.k - 1], ' ') AS t FROM d, z, unnest(range(1, len(w) - z.k + 2)) AS r(i)),
 hit AS (SELECT DISTINCT doc_id, i, h.k, item_id FROM h JOIN g ON h.k = g.k AND h.t = g.t),
 c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM hit, unnest(range(0, k)) AS r(j) GROUP BY doc_id),
 m AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP5 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
 g AS (SELECT doc_id, i, md5(b[i:i + 399]) AS h FROM d, unnest(range(1, octet_length(b) - 398)) AS r(i)),
 c AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
 o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM g SEMI JOIN c USING (h)),
 p AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
 s AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS z FROM p GROUP BY doc_id, run),
 e AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS before FROM s),
 k AS (SELECT doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, max(z) AS z,
  string_agg(CASE WHEN a > before THEN hex(b[before:a - 1]) ELSE '' END, '' ORDER BY a) AS head FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
 sha256(CASE WHEN k.doc_id IS NULL THEN b WHEN z > octet_length(b) THEN unhex(head) ELSE unhex(head || hex(b[z:octet_length(b)])) END) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

#: Edits by a forward search: for each row and last role the cheapest, then least, way so far.
OP11 = r"""
WITH RECURSIVE p AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
 crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(name, ''), lambda x: ascii(x)::UBIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda k: k::UBIGINT)),
   lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)), 4294967295::UBIGINT) % 20 AS harm FROM p),
 d AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM crc, unnest(range(CASE WHEN harm = 3 THEN 2 ELSE 1 END)) AS r(copy) WHERE harm <> 0),
 o AS (SELECT *, row_number() OVER w AS i, lag(role[1]) OVER w AS before, count(*) OVER (PARTITION BY conv_id) AS n,
  regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS said
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))),
 f AS (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN said[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
 s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
 ins(state, k, later, letters, lines) AS (VALUES ('', 0, '', '', []::VARCHAR[]), ('s', 0, 's', '', []), ('u', 0, 'u', '', []), ('a', 0, 'a', '', []),
  ('', 1, 'u', 'I', ['user:']), ('s', 1, 'u', 'I', ['user:']), ('u', 1, 'a', 'I', ['assistant:']), ('a', 1, 'u', 'I', ['user:']),
  ('', 2, 'a', 'II', ['user:', 'assistant:']), ('s', 2, 'a', 'II', ['user:', 'assistant:'])),
 fit(state, next) AS (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
 best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '' AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines, n FROM f
  UNION ALL
  SELECT conv_id, i, state, pick.cost, pick.audit, pick.lines, n FROM (
   SELECT conv_id, i, state, n, min({'cost': cost, 'audit': audit, 'lines': lines}) AS pick FROM (
    SELECT b.conv_id, f.i, e.state, f.n, b.cost + 2 * x.k + e.cost AS cost, b.audit || x.letters || e.letter AS audit,
     list_concat(list_concat(b.lines, x.lines), e.line) AS lines
    FROM best b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1 JOIN ins x ON x.state = b.state,
    LATERAL (SELECT x.later AS state, 3 AS cost, 'D' AS letter, []::VARCHAR[] AS line
     UNION ALL SELECT next, (f.fault = 'truncated')::INT, 'K', [f.role || ':' || f.text] FROM fit WHERE fit.state = x.later AND next = f.role[1] AND f.fault NOT IN ('blank', 'duplicate')
     UNION ALL SELECT next, 2 + (f.fault = 'truncated')::INT, 'R', [CASE next WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text] FROM fit WHERE fit.state = x.later AND next <> 's' AND f.fault NOT IN ('blank', 'duplicate')) e
   ) GROUP BY conv_id, i, state, n)),
 ends AS (SELECT conv_id, min({'cost': cost + 2 * k, 'audit': audit || letters, 'lines': list_concat(b.lines, x.lines)}) AS pick
  FROM best b JOIN ins x ON x.state = b.state WHERE i = n AND x.later IN ('', 'a') GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
 coalesce(illegal, 0) AS illegal, coalesce(pick.cost, 0)::BIGINT AS cost, coalesce(pick.audit, '') AS audit,
 sha256(coalesce(array_to_string(pick.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM c.conv_id
"""
