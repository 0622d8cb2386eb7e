"""DuckDB SQL for the operators on word sequences: the contracts taken
literally, by joins on whole windows and pairs."""

from __future__ import annotations

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


SUBSTRINGS = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_BLANK}) AS w FROM documents
), win AS (
  SELECT r, i AS start, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS key
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), twice AS (
  SELECT key FROM win GROUP BY key HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT r, unnest(range(start, start + 35)) AS pos FROM win SEMI JOIN twice USING (key)
), word AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY pos) AS text FROM word ANTI JOIN gone USING (r, pos) GROUP BY r
), lost AS (
  SELECT r, count(*) AS n FROM gone GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN lost USING (r)
"""

OVERLAPS = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLDED}, {_ALNUM}) AS w FROM documents
), b AS (
  SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, regexp_extract_all({_FOLDED}, {_ALNUM}) AS w FROM benchmark) WHERE len(w) > 0
), item AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS key
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)
), win AS (
  SELECT r, i AS start, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS key
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d JOIN (SELECT DISTINCT k FROM item) ON len(w) >= k)
), hit AS (
  SELECT DISTINCT r, start, win.k, item_id FROM win JOIN item ON win.k = item.k AND win.key = item.key
), covered AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(start, start + k)) AS pos FROM hit) GROUP BY r
), who AS (
  SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(who.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN who USING (r)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_FOLDED}, {_BLANK}) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS key
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.key = b.key AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach AS (
  SELECT a AS doc_id, a AS other FROM link UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
       coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""
