"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"

#: The smallest vertex that each vertex of ``vertices(v)`` reaches over ``links(a, b)`` (both directions).
_REACH = """
  reach(v, c) AS (
    SELECT v, v FROM vertices
    UNION
    SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.v WHERE r.c < l.b
  ),
  component AS (SELECT v, min(c) AS component_id FROM reach GROUP BY v)
"""

_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

SQL = {
    "op3_tool_call_linking": """
WITH RECURSIVE c AS (
    SELECT conv_id, turn, conv_id || ':' || turn AS call_id, conv_id || ':' || (turn - 2) AS dep, coalesce(text, '') AS t, count(*) AS n_calls
    FROM conversations WHERE role = 'user' GROUP BY ALL
  ),
  r AS (
    SELECT conv_id, min(turn) AS turn, conv_id || ':' || (turn - 1) AS call_id, min(text) AS content, count(*) AS n_results
    FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn
  ),
  lv(call_id, level) AS (
    SELECT call_id, 0 FROM c WHERE dep NOT IN (SELECT call_id FROM c)
    UNION ALL
    SELECT c.call_id, level + 1 FROM lv JOIN c ON c.dep = lv.call_id
  )
SELECT c.conv_id, c.turn, c.call_id, n_calls, coalesce(n_results, 0) AS n_results,
  (dep NOT IN (SELECT call_id FROM c))::BIGINT AS n_missing, level::INTEGER AS level,
  CASE WHEN length(t) < 20 THEN 'invalid' WHEN n_results IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  CASE WHEN length(t) < 20 THEN '$.prompt: too short' ELSE '' END AS errors,
  '{"arguments":{"prompt":' || to_json(t)::VARCHAR || ',"turn":' || c.turn || '},"depends_on":["' || dep || '"],"id":"' || c.call_id
    || '","level":' || level || ',"name":"reply","result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS json
FROM c JOIN lv USING (call_id) LEFT JOIN r USING (call_id)
UNION ALL
SELECT conv_id, turn, call_id, 0, n_results, 0, NULL, 'orphan', '', NULL FROM r WHERE call_id NOT IN (SELECT call_id FROM c)
""",
    "op1_embedding_near_dedup": f"""
WITH RECURSIVE e AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  ),
  links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
    WHERE list_cosine_similarity(x.v, y.v) >= 0.9
  ),
  vertices AS (SELECT vec_id AS v FROM embeddings), {_REACH},
  n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v AS vec_id, coalesce(n, 0) AS n_links, component_id, v = component_id AS kept
FROM component LEFT JOIN n ON a = v
""",
    "op4_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
  b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
  p AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS m,
      unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS g
    FROM b WHERE len(w) > 0
  ),
  win AS (
    SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS s,
      unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS g
    FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m
  ),
  hit AS (SELECT doc_id, win.m, s, item_id FROM win JOIN p ON p.g = win.g AND p.m = win.m),
  gone AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(s, s + m)) AS i FROM hit) GROUP BY doc_id),
  named AS (
    SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id
  )
SELECT d.doc_id, len(w) AS n_words, coalesce(gone.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(gone.n, 0) > 0 AS contaminated
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op5_line_dedup": f"""
WITH RECURSIVE split AS (
    SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents
  ),
  l AS (SELECT * FROM split WHERE trim(regexp_replace(line, '[\\t\\r]', ' ', 'g')) <> ''),
  d AS (SELECT row_number() OVER (ORDER BY spot) AS v, line, spot FROM (SELECT line, min((doc_id, pos)) AS spot FROM l GROUP BY line)),
  g AS (
    SELECT v, unnest(list_distinct(list_transform(range(1, greatest(length(line) - 7, 1) + 1), lambda i: line[i:i + 7]))) AS g FROM d
  ),
  n AS (SELECT v, count(*) AS n FROM g GROUP BY v),
  shared AS (SELECT x.v AS a, y.v AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.v < y.v GROUP BY ALL),
  one AS (SELECT a, b FROM shared JOIN n p ON p.v = a JOIN n q ON q.v = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
  links AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
  vertices AS (SELECT v FROM d), {_REACH},
  keep AS (SELECT d.line, k.spot FROM d JOIN component USING (v) JOIN d k ON k.v = component_id),
  gone AS (SELECT doc_id, list(pos) AS spot, count(*) AS n FROM l JOIN keep USING (line) WHERE (doc_id, pos) <> spot GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines, coalesce(n, 0) AS n_removed,
  sha256(CASE WHEN n IS NULL THEN coalesce(text, '') ELSE coalesce(array_to_string(list_transform(
    list_filter(range(len(string_split(text, chr(10)))), lambda i: NOT list_contains(spot, i)), lambda i: string_split(text, chr(10))[i + 1]), chr(10)), '') END) AS kept_sha256
FROM documents LEFT JOIN gone USING (doc_id)
""",
    "op6_substring_dedup": f"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
  win AS (
    SELECT doc_id, unnest(range(1, len(w) - 18)) AS s,
      unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS g
    FROM t WHERE len(w) >= 20
  ),
  hit AS (
    SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM win) WHERE k > 1
  ),
  gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM hit),
  lost AS (SELECT doc_id, list(i) AS l, count(*) AS n FROM gone GROUP BY doc_id)
SELECT t.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ')
    ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(l, i)), lambda i: w[i]), ' '), '') END) AS kept_sha256
FROM t LEFT JOIN lost USING (doc_id)
""",
    "op8_minhash_near_dedup": f"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS w FROM documents
  ),
  s AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2
      THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s
    FROM w
  ),
  n AS (SELECT doc_id, len(s) AS n FROM s),
  g AS (SELECT doc_id, unnest(s) AS g FROM s),
  shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
    FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
  ),
  one AS (
    SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
    WHERE 100 * c >= 80 * (p.n + q.n - c)
  ),
  links AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
  vertices AS (SELECT doc_id AS v FROM n), {_REACH}
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
FROM n JOIN component ON v = doc_id
""",
}
