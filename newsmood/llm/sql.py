"""DuckDB SQL for those queries of this package that SQL can express."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"

ORACLE: dict[str, str] = {}

ORACLE["op6_decontaminate"] = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{ALNUM}') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{ALNUM}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM win),
dg AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, lens WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, k, item_id FROM dg JOIN win USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::varchar)) AS ids FROM hit GROUP BY 1)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n, 0)::bigint AS n_hit, coalesce(len(ids), 0)::bigint AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE["op7_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, '')))::bigint AS n, sha1(coalesce(html, '')) AS d
  FROM pages),
r AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
FROM p LEFT JOIN r USING (d)
"""

ORACLE["op1_jaccard_join"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{SPACED}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT w.doc_id, coalesce(n, 0)::bigint AS n_shingles, component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""

ORACLE["op9_near_embeddings"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::double[] AS e FROM embeddings),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) >= 0.9 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))
    AND list_dot_product(a.e, a.e) > 0 AND list_dot_product(b.e, b.e) > 0),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY 1),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT v.vec_id, coalesce(n, 0)::bigint AS n_links, component_id, v.vec_id = component_id AS kept
FROM v LEFT JOIN n USING (vec_id) JOIN (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (vec_id)
"""

# Lengths of the markers before and after a text, and markers with any escapes in them.
_AROUND = "CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 20 + length(role) END"
_MARKERS = r"(<\\*<SYS>>|<\\*</SYS>>|\[\\*/?INST\]|<\\*/?s>|\[\\*/?ROLE\]|\[\\*/TURN\])"

ORACLE["op12_chat"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({_AROUND} + length(text) + len(regexp_extract_all(text, '{_MARKERS}')))::bigint AS formatted_chars
FROM t GROUP BY conv_id
"""

ORACLE["op11_phrases"] = f"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS p
    FROM documents)),
f AS (
  SELECT lang, k, g, count(*) AS a FROM (
    SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 6) t(k) WHERE len(w) >= k))
  GROUP BY 1, 2, 3),
total AS (SELECT lang, sum(a)::bigint AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, g, a, string_split(g, ' ') AS w FROM f WHERE k >= 2 AND a >= 100),
inner_ AS (
  SELECT DISTINCT lang, g FROM (
    SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g, a
    FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 5) t(m) WHERE m < k)) x
  JOIN (SELECT lang, g, a AS own FROM c) USING (lang, g) WHERE 100 * a >= 100 * own),
cuts AS (
  SELECT lang, k, g, a, j, array_to_string(list_slice(w, 1, j), ' ') AS g1, array_to_string(list_slice(w, j + 1, k), ' ') AS g2
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) WHERE (lang, g) NOT IN (SELECT (lang, g) FROM inner_)),
scores AS (
  SELECT x.lang, x.g, x.a, y.a AS l, z.a AS r, n, j, (1000::hugeint * x.a * n // (y.a::hugeint * z.a))::bigint AS score
  FROM cuts x JOIN f y ON y.lang = x.lang AND y.g = x.g1 JOIN f z ON z.lang = x.lang AND z.g = x.g2 JOIN total t ON t.lang = x.lang),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""
