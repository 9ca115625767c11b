"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_OP2 = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, regexp_extract_all({_LOW.format("text")}, '{_WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS MATERIALIZED (SELECT DISTINCT item_id, CASE WHEN len(w) < 13 THEN len(w) ELSE 13 END AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS s
 FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0) q),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (SELECT k, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM (SELECT k, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, sizes) q WHERE i + n - 1 <= len(w)),
hit AS MATERIALIZED (SELECT k, spot.n, i, item_id FROM spot JOIN win ON spot.s = win.s AND spot.n = win.n),
words AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM hit) q GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS t FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS t FROM hit) q GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k)
"""

_OP6 = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0) q),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.doc_id WHERE reach.c < link.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""

ORACLES: dict[str, str] = {"op2_decontamination": _OP2, "op6_ngram_jaccard_join": _OP6}
