r"""DuckDB SQL with the rows of the n-gram join and of decontamination."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NGRAM_JOIN = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT w.doc_id, count(s) AS n FROM w LEFT JOIN sh USING (doc_id) GROUP BY w.doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b, c = x.n AND c = y.n AS same FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
arcs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM n
  UNION SELECT reach.doc_id, arcs.b FROM reach JOIN arcs ON arcs.a = reach.r)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, comp.component_id, coalesce(least(cls.class_id, n.doc_id), n.doc_id) AS class_id
FROM n JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) comp USING (doc_id)
LEFT JOIN (SELECT b AS doc_id, min(a) AS class_id FROM links WHERE same GROUP BY b) cls USING (doc_id)
"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""
WITH dw AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
iw AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, len(v) AS width, array_to_string(v, ' ') AS s
  FROM (SELECT item_id, ws[i : i + 12] AS v FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM iw WHERE len(ws) > 0))),
dwin AS (
  SELECT doc_id, width, i, array_to_string(ws[i : i + width - 1], ' ') AS s
  FROM (SELECT doc_id, ws, width, unnest(range(1, len(ws) - width + 2)) AS i FROM dw, (SELECT DISTINCT width FROM win) WHERE len(ws) >= width)),
hit AS (SELECT doc_id, item_id, i, width FROM dwin JOIN win USING (width, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN named USING (doc_id)
"""
